"""Token counts of whole texts, with huge documents encoded in overlapping chunks and spliced where they agree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .blocks import in_small_batches

MODEL = "piece_bpe_32k.model"
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
SPACE = "▁"


def model_path(name: str) -> str:
    """Where an executor finds a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Splicer:
    """Counts the tokens of a text through chunks, with the result of encoding it whole.

    ``encode(text)`` gives the token ends as character offsets, ``count(text)`` their number. The model writes a space as
    a mark and puts one before the text. If no piece has the mark behind another character, no token and no merge crosses
    from a character to a space after it: what stands left and right of that place is encoded alike with or without the
    other side. Such a place is a proven border, if both characters beside the space are others (the mark put before a
    chunk then stands for that space).
    """

    def __init__(self, encode: Callable[[str], list[int]], count: Callable[[str], int], proven: bool):
        self.encode, self.count, self.proven = encode, count, proven
        self.widened = 0

    @staticmethod
    def border(text: str, low: int, high: int) -> int:
        """The first place p in low..high with a lone space at p, or -1."""
        at = text.find(" ", max(low, 1), high)
        while at >= 0:
            if at + 1 < len(text) and text[at - 1] not in (" ", SPACE) and text[at + 1] not in (" ", SPACE):
                return at
            at = text.find(" ", at + 1, high)
        return -1

    def tokens(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        if not self.proven or len(text) <= chunk + overlap:
            return self.count(text)
        total, start, wide = 0, 0, overlap
        while True:
            end = min(len(text), start + chunk + wide)
            if end == len(text):
                return total + self.count(text[start:])
            left = np.asarray(self.encode(text[start:end])) + start
            cut = self.splice(text, left, start + chunk, end)
            if cut < 0:
                self.widened += 1
                wide *= 2  # no common border: the same chunk again, with a wider overlap
                continue
            total += int(np.searchsorted(left, cut, "right"))
            start, wide = cut + 1, overlap

    def splice(self, text: str, left: np.ndarray, low: int, high: int) -> int:
        """A proven border at which the tokens of the chunk and those of the overlap, encoded alone, both end."""
        begin = self.border(text, low, high)
        if begin < 0:
            return -1
        right = np.asarray(self.encode(text[begin + 1 : high])) + begin + 1
        common = set(left.tolist()) & set(right.tolist())
        at = self.border(text, begin + 1, high)
        while at >= 0:
            if at in common:
                return at
            at = self.border(text, at + 1, high)
        return -1


@lru_cache(maxsize=2)
def _splicer(model: str, path: str | None):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or model_path(model))
    proven = not any(SPACE in p.lstrip(SPACE) for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size())))

    def encode(text: str) -> list[int]:
        # offsets of the pieces are in bytes of UTF-8
        ends = np.fromiter((p.end for p in sp.encode(text, return_type="proto").pieces), np.int64)
        if text.isascii():
            return ends
        chars = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        return np.where(ends > 0, chars[ends - 1], 0)

    return sp, Splicer(encode, lambda text: len(sp.encode(text, return_type="numpy")), proven)


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    path: str | None = None,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): what the tokenizer gives for each whole text, without begin or end tokens.

    Texts longer than ``chunk`` + ``overlap`` characters are encoded in overlapping chunks; a text without a proven border
    in its overlaps ends up encoded whole. Null and empty texts have no bytes and no tokens. Rows with equal or null ids
    keep a row each; an empty table gives an empty table; other columns are ignored. ``path`` names the model file on the
    executors; without it they look ``model`` up among their public tokenizers.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, splicer = _splicer(model, path)
        for b in batches:
            texts = b.column("text")
            _, borders = A.utf8(texts)
            values = texts.to_pylist()
            short = [i for i, t in enumerate(values) if t and len(t) <= chunk + overlap]
            n = np.zeros(len(values), np.int64)
            for low in range(0, len(short), 256):
                part = short[low : low + 256]
                n[part] = [len(x) for x in sp.encode([values[i] for i in part], num_threads=1, return_type="numpy")]
            for i, t in enumerate(values):
                if t and len(t) > chunk + overlap:
                    n[i] = splicer.tokens(t, chunk, overlap)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": np.diff(borders), "n_tokens": n})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")

"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .blocks import in_small_batches

DOCS_PER_LANGUAGE = 300
PASSAGE_BYTES = 1024
DICTIONARY_BYTES = 65_536
SEGMENT_BYTES = 256
#: The last segment is also encoded in pieces of these sizes, so that short texts differ by more than a byte or two.
FINE_BYTES = (64, 24)
FINE_OVERLAP = 4
LEVEL = 6
MIN_MARGIN = 0.002
UNDECIDED = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def letters(text: str | None) -> bytes:
    """The words of letters in lower case, joined by one space."""
    return " ".join(_WORDS.findall((text or "").lower())).encode()


def _passage(text: str, doc_id: int, most: int) -> list[str]:
    """Whole lines of about ``most`` bytes from a place in the text that depends on the id alone."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return []
    start, out, size = zlib.crc32(str(doc_id).encode()) % len(lines), [], 0
    for line in lines[start:] + lines[:start]:
        words = letters(line)[: most - size].decode(errors="ignore")
        out.append(words)
        size += len(words) + 1
        if size >= most:
            break
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary per language, from rows that are not held out and have a language.

    The sample is bounded: per language the DOCS_PER_LANGUAGE rows that come first in the order of a hash of the id, and of
    each a passage of PASSAGE_BYTES. Lines that several sampled documents share (licences, notices) are left out, because
    they say nothing about the language of the rest.
    """
    known = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # of each language only rows with small hashes, about ten times as many as wanted, are ranked; the shares are a row per
    # language, far less than the dictionaries that every task holds, and without the broadcast all rows would move by language
    key = F.xxhash64("id")
    names = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"))
    share = names.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(10.0 * DOCS_PER_LANGUAGE) / F.count(F.lit(1))).alias("share"))
    few = names.join(F.broadcast(share), "lang").filter(key.cast("double") <= F.col("share") * 2.0**64 - 2.0**63)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(key, "id"))
    picked = few.withColumn("rank", rank).filter(F.col("rank") <= DOCS_PER_LANGUAGE).select("id", "lang")
    rows = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [_passage(t, i, PASSAGE_BYTES) for t, i in zip(b.column("text").to_pylist(), b.column("id").to_pylist())]
            yield pa.RecordBatch.from_pydict({"lang": b.column("lang"), "id": b.column("id").cast(pa.string()), "lines": pa.array(cut, pa.list_(pa.string()))})

    sample: dict[str, list] = {}
    used: dict[str, int] = {}
    for row in sorted(in_small_batches(rows).mapInArrow(passages, "lang string, id string, lines array<string>").collect()):
        sample.setdefault(row["lang"], []).append(row["lines"])
        for line in set(row["lines"]):
            used[line] = used.get(line, 0) + 1
    return {
        lang: " ".join(x for lines in found for x in lines if used[x] == 1 and x).encode()[-DICTIONARY_BYTES:]
        for lang, found in sorted(sample.items())
    }


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for lang, content in dictionaries:
        d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


def pieces(content: bytes) -> list[bytes]:
    """Segments that are encoded on their own, so that a long text can't learn from itself in place of the dictionary."""
    content = b" " + content + b" "  # a word at either end has its borders too
    out = [content[i : i + SEGMENT_BYTES] for i in range(0, len(content), SEGMENT_BYTES)]
    last = out[-1]
    for size in FINE_BYTES:
        out += [last[max(0, i - FINE_OVERLAP) : i + size] for i in range(0, len(last), size)]
    return out


def classify(text: str | None, compressors: dict[str, zstandard.ZstdCompressor]) -> tuple[str, float]:
    """The language and its margin: the share of bytes it saves against the second best."""
    content = letters(text)
    if not content or not compressors:
        return UNDECIDED, 0.0
    parts = pieces(content)
    sizes = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in compressors.items())
    best, lang = sizes[0]
    return lang, 1 - best / sizes[1][0] if len(sizes) > 1 else 1.0


def language_id(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    text_col: str = "text",
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """Add lang_pred, score (0 to 1) and accepted to every row; columns of these names are replaced.

    ``score`` is the margin: the share of bytes saved against the second-best language. ``accepted`` is false for texts
    without letters (null and empty ones too), which are ``und`` with score 0, and where the margin is below ``min_margin``.
    With no dictionary at all every text is ``und``. Ties go to the first language by name and are never accepted.
    """
    fixed = tuple(sorted(dictionaries.items()))

    @F.pandas_udf("lang_pred string, score double")
    def guessed(texts):
        import pandas as pd

        compressors = _compressors(fixed)
        return pd.DataFrame([classify(t, compressors) for t in texts], columns=["lang_pred", "score"])

    guess = guessed.asNondeterministic()  # else each use of its fields, and a filter on them, runs it again
    rows = in_small_batches(docs.drop("lang_pred", "score", "accepted", "__guess")).withColumn("__guess", guess(F.col(text_col)))
    out = rows.withColumns({"lang_pred": F.col("__guess.lang_pred"), "score": F.col("__guess.score")}).drop("__guess")
    return out.withColumn("accepted", (F.col("lang_pred") != UNDECIDED) & (F.col("score") >= min_margin))

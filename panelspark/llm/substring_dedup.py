"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .repeats import Scheme, Units, marked

WINDOW = 13
GRAM = 5
_LANE = np.uint64(0xD6E8FEB86659FD93)


def word_units(raw: np.ndarray, borders: np.ndarray) -> Units:
    start, end, rows = A.word_spans(raw, borders, A.NOT_SPACE)
    return Units(A.span_hashes(A.byte_codes()[raw], start, end), start, end, rows)


class ReferenceBlock:
    """One block of the reference: the distinct word windows of some triggers, each with the smallest document that has it."""

    def __init__(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray):
        order = np.lexsort((doc, two, one))
        a, b = one[order], two[order]
        head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.bool_)
        owner = np.cumsum(head) - 1
        self.first = np.empty(len(doc), np.int64)
        self.first[order] = doc[order][head][owner] if len(a) else doc

    def factors(self, doc: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy factors (first window, number of windows) of the parsed phrases against what smaller documents hold.

        A factor begins at the first window that the reference holds and is extended word by word while the window ending
        there is held as well. The next factor is sought from the window after, not from the word after: so the windows
        that lie across a factor's end are tested too, and none that the reference holds is missed.
        """
        held = self.first < doc
        edge = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else held
        begins = np.flatnonzero(held & (edge | ~np.concatenate([[False], held[:-1]])))
        last = np.concatenate([edge[1:], [True]]) if len(owner) else held
        ends = np.flatnonzero(held & (last | ~np.concatenate([held[1:], [False]])))
        return begins, ends - begins + 1


def parse(units: Units, windows: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int = WINDOW) -> np.ndarray:
    owner, at = A.spread(windows)
    first = units.borders[:-1][owner] + at
    n = len(units.codes) - window + 1
    one = np.zeros(max(n, 0), np.uint64)
    two = one.copy()
    for j in range(window):
        one = one * A.MULTIPLIER + units.codes[j : j + n]
        two = two * _LANE + A.mix(units.codes[j : j + n])
    index = ReferenceBlock(A.mix(one)[first], A.mix(two)[first], doc[owner])
    out = np.zeros(len(first), np.bool_)
    begin, size = index.factors(doc[owner], owner)
    which, step = A.spread(size)
    out[begin[which] + step] = True
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove every word that lies in a run of ``window`` words which a document with a smaller id has too.

    Returns (doc_id, n_words, n_removed, kept_text, spans): ``kept_text`` holds the kept words joined by one space, ``spans``
    the removed word ranges (from, to exclusive). Windows are judged on the input.

    The reference is the whole corpus, dealt into blocks by content: a window goes to the block of its trigger (see
    ``repeats``), so the block where an equal window could lie is known, and factoring a passage against that block is
    factoring it against all. Windows are compared by 128-bit hashes.

    Null or blank text: no words, nothing removed, empty text. A null id counts as larger than all others, and rows that
    share an id never remove each other's words. An empty table gives an empty table. Other columns are ignored.
    """

    def resolve(raw, units, windows, doc, place):
        return parse(units, windows, doc, place, window)

    def finish(table: pa.Table, raw, borders, words, covered) -> pa.Table:
        units = word_units_of(raw, borders)
        kept, spans, removed = [], [], []
        edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        for low, high in zip(words[:-1].tolist(), words[1:].tolist()):
            keep = ~covered[low:high]
            text = raw_bytes(raw, units, low, high, keep)
            kept.append(text)
            removed.append(high - low - int(keep.sum()))
            if removed[-1]:
                step = edge[low : high + 1].copy()
                step[0], step[-1] = not keep[0], -int(not keep[-1])
                spans.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())])
            else:
                spans.append([])
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(np.diff(words)),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    scheme = Scheme(window, min(GRAM, window), word_units, False, resolve)
    schema = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start: long, end: long>>"
    return marked(docs, id_col, text_col, scheme, finish, schema)


def word_units_of(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of all words of a block."""
    return A.word_spans(raw, borders, A.NOT_SPACE)[:2]


def raw_bytes(raw: np.ndarray, spans: tuple[np.ndarray, np.ndarray], low: int, high: int, keep: np.ndarray) -> bytes:
    """The kept words low..high joined by one space."""
    if low == high:
        return b""
    start, end = spans[0][low:high], spans[1][low:high]
    words = raw[start[0] : end[-1]].tobytes().split()
    if not keep.all():
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)

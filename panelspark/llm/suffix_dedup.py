"""Removal of repeated byte strings by prefix-free parsing and suffix arrays of the dictionary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .repeats import Scheme, Units, marked

LENGTH = 100
GRAM = 32


def byte_units(raw: np.ndarray, borders: np.ndarray) -> Units:
    at = np.arange(len(raw) + 1)
    return Units(A.byte_codes()[raw], at[:-1], at[1:], borders)


def prefix_ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """Rank of raw[i : i + length] among all positions i, by bytes: a suffix array cut off at ``length``, as its inverse.

    Prefix doubling: eight bytes are compared as one number, and ranks of length n give those of length 2n. Behind the end
    the text is filled up with zeros, which can only tie with what reaches beyond the end as well.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(length + 8, np.uint8)])
    wide = min(8, length)
    rank = np.zeros(n + length, np.uint64)
    for j in range(wide):
        rank = (rank << np.uint64(8)) | padded[j : j + n + length]
    done = wide
    while done < length:
        step = min(done, length - done)
        rank = _dense(rank)
        shifted = np.concatenate([rank[step:], np.zeros(step, np.uint64)])
        rank = (rank << np.uint64(32)) | shifted
        done += step
    return rank[:n]


def _dense(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    ordered = values[order]
    out = np.empty(len(values), np.uint64)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])).astype(np.uint64)
    return out


def corpus_order(raw: np.ndarray, units: Units, windows: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Flag the windows whose string begins earlier.

    The dictionary has each distinct phrase once, with its earliest place in the parse. Its suffix array orders the strings
    of the corpus, and the parse (document, then place) those that are equal. A later copy of a phrase begins earlier whole.
    """
    borders = units.borders
    data = raw.tobytes()
    order = np.lexsort((place, doc))
    known: dict[bytes, int] = {}
    entry = np.fromiter(
        (known.setdefault(data[a:b], i) for i, a, b in zip(order.tolist(), borders[order].tolist(), borders[order + 1].tolist())),
        np.int64,
        len(order),
    )
    first = np.sort(order[entry == order])
    text = A.gather(raw, borders[first], borders[first + 1])
    size = borders[first + 1] - borders[first]
    owner, at = A.spread(windows[first])
    rank = prefix_ranks(text, length)[(np.cumsum(size) - size)[owner] + at]
    by = np.lexsort((at + place[first][owner], doc[first][owner], rank))
    seen = np.zeros(len(by), np.bool_)
    seen[by[1:]] = rank[by[1:]] == rank[by[:-1]]
    out = np.ones(int(windows.sum()), np.bool_)
    begin = np.cumsum(windows) - windows
    out[begin[first][owner] + at] = seen
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Remove every byte that lies in a string of ``length`` bytes which begins earlier in the corpus.

    Earlier: in a document with a smaller id, or nearer to the start of the same document. Returns (doc_id, n_bytes,
    n_removed, n_spans, kept binary, spans): the bytes kept, and the removed byte ranges (from, to exclusive).

    Prefix-free parsing: rolling hashes of 32 bytes trigger the phrase borders, the distinct phrases are the dictionary, and
    the parse is the list of phrases with their places. Phrases overlap by ``length - 1`` bytes, so no string of that
    length crosses a phrase, and the dictionary's suffix array, cut off at ``length``, orders all strings of the corpus;
    the parse orders the equal ones. Strings are compared byte by byte, not by hashes.

    Null text is empty. A null id counts as larger than all others; rows that share an id count as one document, in the
    order of their texts, but no string crosses from one row to the next. Other columns are ignored.
    """

    def parse(raw, units, windows, doc, place):
        return corpus_order(raw, units, windows, doc, place, length)

    def finish(table: pa.Table, raw, borders, units, covered) -> pa.Table:
        kept, spans, removed = [], [], []
        for low, high in zip(units[:-1].tolist(), units[1:].tolist()):
            gone = covered[low:high]
            n = int(np.count_nonzero(gone))
            removed.append(n)
            kept.append((raw[low:high][~gone] if n else raw[low:high]).tobytes())
            if n:
                step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                spans.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())])
            else:
                spans.append([])
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_bytes": pa.array(np.diff(units)),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                "kept": pa.array(kept, pa.binary()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    scheme = Scheme(length, min(GRAM, length), byte_units, True, parse)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>"
    return marked(docs, id_col, text_col, scheme, finish, schema)


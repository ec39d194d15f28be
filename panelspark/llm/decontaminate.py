"""Benchmark decontamination with a stored positional inverted index of the training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..scale import checkpointed
from . import arrays as A
from .blocks import in_small_batches

WINDOW = 10
#: Postings of one index row: a block of documents is closed when it holds so many words.
BLOCK_WORDS = 1 << 19
#: Benchmark text that one pass over the index is given; a larger benchmark takes several passes.
PASS_BYTES = 8 << 20
#: Candidate positions that a block looks at together.
AT_ONCE = 1 << 20
_INDEX = [
    ("block", pa.string()),
    ("doc", pa.binary()),
    ("begin", pa.binary()),
    ("terms", pa.binary()),
    ("counts", pa.binary()),
    ("postings", pa.binary()),
]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term of every word, and the words before each row; A-Z in lower case."""
    raw, borders = A.utf8(texts)
    raw = A.lower(raw)
    terms, rows, base = [], [np.zeros(1, np.int64)], 0
    for low, high in A.slices(borders, 1 << 20):
        part = raw[borders[low] : borders[high]]
        start, end, before = A.word_spans(part, borders[low : high + 1] - borders[low], A.ALNUM)
        terms.append(A.span_hashes(A.byte_codes()[part], start, end))
        rows.append(before[1:] + base)
        base += len(start)
    return A.joined(terms, np.uint64), np.concatenate(rows)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: a row per block of documents.

    ``block``: its name. ``doc`` and ``begin``: the documents of the block and the position of each one's first word (and the end of the last).
    ``terms`` and ``counts``: the distinct terms in order and their postings. ``postings``: for each term the ascending
    positions, 32 bits each. Reading only ``terms`` and ``counts`` gives document frequencies without the postings.
    """
    schema = pa.schema(_INDEX)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            doc, texts = A.ids(b.column("doc_id")), b.column("text")
            _, borders = A.utf8(texts)
            for low, high in A.slices(borders, BLOCK_WORDS * 6):
                terms, begin = tokens(texts.slice(low, high - low))
                order = np.argsort(terms, kind="stable")
                distinct, first = np.unique(terms[order], return_index=True)
                counts = np.diff(np.append(first, len(terms))).astype(np.uint32)
                packed = (doc[low:high], begin, distinct, counts, order.astype(np.uint32))
                name, n = pa.array([f"{task}-{n}"]), n + 1
                yield pa.RecordBatch.from_arrays([name, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return checkpointed(in_small_batches(rows).mapInArrow(invert, ", ".join(f"{n} {t}" for n, t in _INDEX)))


class Windows:
    """The distinct windows of some benchmark items: a row of terms each, padded where an item is shorter than a window."""

    def __init__(self, items: list, texts: list[str | None], width: int):
        terms, rows = tokens(pa.array(texts, pa.string()))
        size = np.diff(rows)
        n = np.where(size >= width, size - width + 1, np.minimum(size, 1))
        owner, at = A.spread(n)
        place = rows[:-1][owner] + at
        self.width = np.minimum(size[owner], width)
        column = np.arange(width)
        inside = column < self.width[:, None]
        grid = np.where(inside, terms[np.minimum(place[:, None] + column, max(len(terms) - 1, 0))] if len(terms) else 0, 0)
        key = np.column_stack([grid, self.width.astype(np.uint64)])
        self.grid, index, inverse = np.unique(key, axis=0, return_index=True, return_inverse=True) if len(key) else (key, [], [])
        self.width = self.width[index] if len(key) else self.width
        self.grid = self.grid[:, :width]
        self.inside = column < self.width[:, None]
        self.items = np.array(items, np.int64)[owner]
        self.window_of = np.asarray(inverse, np.int64).reshape(-1)
        self.terms = np.unique(terms)

    def order_by(self, frequency: np.ndarray) -> np.ndarray:
        """The columns of each window from its rarest term to its commonest."""
        f = frequency[np.searchsorted(self.terms, self.grid)] if len(self.terms) else np.zeros(self.grid.shape, np.int64)
        return np.argsort(np.where(self.inside, f, np.iinfo(np.int64).max), axis=1, kind="stable")


class Block:
    """The postings of one index row, for the terms asked for."""

    def __init__(self, row: dict, wanted: np.ndarray):
        terms, counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.doc, self.begin = np.frombuffer(row["doc"], np.int64), np.frombuffer(row["begin"], np.int64)
        start = np.cumsum(counts) - counts
        at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
        have = terms[at] == wanted if len(terms) else np.zeros(len(wanted), np.bool_)
        self.count = np.where(have, counts[at] if len(terms) else 0, 0)
        self.start = np.where(have, start[at] if len(terms) else 0, 0)
        self.postings = np.frombuffer(row["postings"], np.uint32)

    def next_posting(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first posting of each term at or after a position, by binary search in the term's list; no more: 2^32."""
        low, end = self.start[term], self.start[term] + self.count[term]
        high = end
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            less = open_ & (self.postings[np.minimum(mid, len(self.postings) - 1)] < position)
            low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
        return np.where(low < end, self.postings[np.minimum(low, len(self.postings) - 1)].astype(np.int64), 1 << 32)

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its term."""
        return self.next_posting(term, position) == position

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, position, "right") - 1


def _possible(w: Windows, block: Block, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of which the block has every term, with the postings of their rarest term: (terms by column, window, posting)."""
    if len(w.terms) == 0 or len(block.postings) == 0:
        return
    term = np.minimum(np.searchsorted(w.terms, w.grid), len(w.terms) - 1)
    windows = np.flatnonzero(np.where(w.inside, block.count[term] > 0, True).all(axis=1))
    rarest = term[windows, order[windows, 0]]
    part = (np.cumsum(block.count[rarest]) - 1) // AT_ONCE
    for p in np.unique(part).tolist():
        some = part == p
        owner, at = A.spread(block.count[rarest[some]])
        yield term, windows[some][owner], block.postings[block.start[rarest[some]][owner] + at].astype(np.int64)


def phrase_matches(w: Windows, block: Block, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, first position) of every occurrence, by intersecting offset-adjusted lists from the rarest term on."""
    found = [(np.zeros(0, np.int64),) * 2]
    for term, window, posting in _possible(w, block, order):
        position = posting - order[window, 0]
        doc = block.doc_of(np.maximum(position, 0))
        fits = (position >= 0) & (position + w.width[window] <= block.begin[doc + 1])
        window, position = window[fits], position[fits]
        for step in range(1, w.grid.shape[1]):
            kept = w.width[window] <= step
            rest = np.flatnonzero(~kept)
            column = order[window[rest], step]
            kept[rest] = block.holds(term[window[rest], column], position[rest] + column)
            window, position = window[kept], position[kept]
        found.append((window, position))
    return tuple(np.concatenate(x) for x in zip(*found))


def proximity_matches(w: Windows, block: Block, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its rarest term) wherever every term of the window lies within ``slop`` words of that term, in
    any order and in the same document."""
    found = [(np.zeros(0, np.int64),) * 2]
    for term, window, position in _possible(w, block, order):
        for step in range(1, w.grid.shape[1]):
            kept = w.width[window] <= step
            rest = np.flatnonzero(~kept)
            doc = block.doc_of(position[rest])
            low, high = np.maximum(position[rest] - slop, block.begin[doc]), np.minimum(position[rest] + slop + 1, block.begin[doc + 1])
            near = block.next_posting(term[window[rest], order[window[rest], step]], low)
            kept[rest] = near < high
            window, position = window[kept], position[kept]
        found.append((window, position))
    return tuple(np.concatenate(x) for x in zip(*found))


def _passes(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[tuple[list, list]]:
    """The benchmark in parts of bounded size, read one after another."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    for row in rows.orderBy("i", "t").toLocalIterator():
        ids.append(A.NO_ID if row["i"] is None else row["i"])
        texts.append(row["t"])
        size += len(row["t"]) * 4
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _frequency(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Postings of each wanted term in the whole index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for terms, counts in zip(A.parts(b, "terms", np.uint64), A.parts(b, "counts", np.uint32)):
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    total += np.where(terms[at] == wanted, counts[at], 0)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(has, pa.int64()), "n": pa.array(total[has], pa.int64())})

    out = np.zeros(len(wanted), np.int64)
    for row in index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


def find_matches(
    index: DataFrame,
    benchmark: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW,
    slop: int | None = None,
) -> DataFrame:
    """(doc_id, row, kind, n_words, n_hit, items, spans) for every row of the index: exact phrase matches, and with ``slop`` proximity matches as well.

    One row per document and pass; a document's row has all its matches. ``spans`` are word ranges (from, to exclusive) that
    windows cover, ``items`` the item ids. The benchmark is read in passes of PASS_BYTES; each is sent to the tasks, which
    is bounded however large the benchmark is.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("kind", pa.string()), ("n_words", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    out = None
    for n, (ids, texts) in enumerate(_passes(benchmark, item_col, text_col, PASS_BYTES)):
        w = Windows(ids, texts, window)
        out_n = index.mapInArrow(_searcher(w, w.order_by(_frequency(index, w.terms)), slop, schema, n == 0), _DDL)
        out = out_n if out is None else out.unionByName(out_n)
    if out is None:
        w = Windows([], [], window)
        out = index.mapInArrow(_searcher(w, w.order_by(np.zeros(0, np.int64)), slop, schema, True), _DDL)
    return out


_DDL = "doc_id long, row string, kind string, n_words long, items array<long>, spans array<struct<start: long, end: long>>"


def _searcher(w: Windows, order: np.ndarray, slop: int | None, schema: pa.Schema, first: bool):
    """``first``: also a row for each document without a match."""
    by_window = np.argsort(w.window_of, kind="stable")
    items_low = np.searchsorted(w.window_of[by_window], np.arange(len(w.grid) + 1))

    def rows_of(block: Block, kind: str, window: np.ndarray, low: np.ndarray, high: np.ndarray, every: bool, name: str) -> list[tuple]:
        row = block.doc_of(low)
        by = np.lexsort((low, row))
        row, low, high, window = row[by], low[by], high[by], window[by]
        at = np.searchsorted(row, np.arange(len(block.doc) + 1))
        out = []
        for i in range(len(block.doc)) if every else np.unique(row).tolist():
            a, b = at[i], at[i + 1]
            items: set[int] = set()
            spans: list[dict] = []
            for k in range(a, b):
                items.update(w.items[by_window[items_low[window[k]] : items_low[window[k] + 1]]].tolist())
                s, e = int(low[k] - block.begin[i]), int(high[k] - block.begin[i])
                if spans and s <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], e)
                else:
                    spans.append({"start": s, "end": e})
            doc = int(block.doc[i])
            out.append((None if doc == A.NO_ID else doc, f"{name}:{i}", kind, int(block.begin[i + 1] - block.begin[i]), [None if x == A.NO_ID else x for x in sorted(items)], spans))
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, w.terms)
                name = row["block"]
                window, low = phrase_matches(w, block, order)
                rows = rows_of(block, "phrase", window, low, low + w.width[window], first, name)
                if slop is not None:
                    window, at = proximity_matches(w, block, order, slop)
                    rows += rows_of(block, "proximity", window, at, at + 1, False, name)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return search


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): the words of each document that lie in an occurrence of a benchmark window.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null texts
    have no words. Items without a text are not searched for; those without an id are, and ``items`` has one null for them. Rows with equal or null ids keep a row each. An
    empty benchmark hits nothing; an empty table gives an empty table. Other columns are ignored.
    """
    found = find_matches(build_index(docs, id_col, text_col), benchmark, item_col, item_text_col, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    if benchmark_passes(benchmark, item_col, item_text_col) <= 1:
        return found.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans")
    merged = found.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    # overlapping spans of several passes become one
    spans = F.aggregate(
        "spans",
        F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    merged = merged.withColumn("spans", spans)
    return merged.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans")


def benchmark_passes(benchmark: DataFrame, item_col: str, text_col: str) -> int:
    """How many passes the benchmark takes."""
    return sum(1 for _ in _passes(benchmark, item_col, text_col, PASS_BYTES))

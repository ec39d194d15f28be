"""Finding every repeated window of a fixed length, over all documents, with work that grows with the text.

A window of L units (words or bytes) picks the unit run of ``gram`` units with the least hash as its trigger. Equal windows
pick equal triggers, so only windows whose triggers agree can be equal. Neighbouring windows with one trigger form a
phrase; consecutive phrases overlap by L - 1 units, so every window lies whole in exactly one phrase.

1. Each block of documents sends its distinct trigger hashes; the ones seen once in the corpus are ruled out.
2. Each block sends its distinct phrases with a shared trigger, once each, with the earliest place it has them at.
3. A bucket of triggers holds all phrases of its triggers, finds each window's earliest place, and answers per phrase.
4. Each block marks the windows that begin earlier elsewhere, and those of its own later copies.

A passage that a third of all documents share is one phrase per block, and nothing is kept per pair of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .blocks import BLOCK_BYTES, in_blocks, size_class, text_bytes

SLICE_BYTES = 1 << 19


@dataclass(frozen=True)
class Units:
    """The units of some rows: a code per unit, its first byte and the byte after it, and the units before each row."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    borders: np.ndarray


@dataclass(frozen=True)
class Scheme:
    window: int
    gram: int
    units: Callable[[np.ndarray, np.ndarray], Units]
    #: keep only repeats of a document with a smaller id, or also those that begin earlier in the same document
    within: bool
    #: (bytes and units of the phrases, windows, document and place of each phrase) -> a flag for every window
    resolve: Callable[[np.ndarray, Units, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Phrases:
    """All phrases of a block, in corpus order. Units count from the block's first unit."""

    first: np.ndarray  # first unit, which is the start of the first window
    windows: np.ndarray
    trigger: np.ndarray
    doc: np.ndarray
    place: np.ndarray  # first unit, from the start of the document
    start: np.ndarray  # bytes
    end: np.ndarray
    borders: np.ndarray  # units before each row
    entry: np.ndarray  # the distinct phrase that each one is
    seen: np.ndarray  # of each distinct phrase, the earliest one


def cut(units: Units, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and trigger of each phrase."""
    none = np.zeros(0, np.int64)
    n = len(units.codes)
    if n < window:
        return none, none, np.zeros(0, np.uint64)
    hashes = A.grams(units.codes, gram)
    keys = (hashes ^ (hashes >> np.uint64(32))) * A.MULTIPLIER
    keys &= ~A.LOW
    keys |= np.arange(len(hashes), dtype=np.uint64)
    at = (A.sliding_min(keys, window - gram + 1) & A.LOW).astype(np.int64)
    # a phrase ends where the trigger changes or the row has no more windows
    rows = np.flatnonzero(np.diff(units.borders) >= window)
    last = units.borders[1:][rows] - window
    head = np.unique(np.concatenate([np.flatnonzero(at[1:] != at[:-1]) + 1, units.borders[rows]]))
    row = np.searchsorted(units.borders[rows], head, "right") - 1
    head, row = head[row >= 0], row[row >= 0]
    head, row = head[head <= last[row]], row[head <= last[row]]
    if len(head) == 0:
        return none, none, np.zeros(0, np.uint64)
    end = np.minimum(np.concatenate([head[1:], [n]]), last[row] + 1)
    return head, end - head, A.mix(hashes[at[head]])


def phrases(raw: np.ndarray, borders: np.ndarray, doc: np.ndarray, scheme: Scheme) -> Phrases:
    """The phrases of rows sorted by document id."""
    got: list[tuple] = []
    unit_borders, base = [np.zeros(1, np.int64)], 0
    for low, high in A.slices(borders, SLICE_BYTES):
        from_byte = borders[low]
        u = scheme.units(raw[from_byte : borders[high]], borders[low : high + 1] - from_byte)
        first, windows, trigger = cut(u, scheme.window, scheme.gram)
        end = first + windows + scheme.window - 1
        row = np.searchsorted(u.borders, first, "right") - 1
        content = A.span_hashes(u.codes, first, end) ^ trigger
        got.append((first + base, windows, trigger, row + low, u.start[first] + from_byte, u.end[end - 1] + from_byte, content))
        unit_borders.append(u.borders[1:] + base)
        base += int(u.borders[-1])
    kinds = (np.int64, np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64)
    first, windows, trigger, row, start, end, content = (A.joined([g[i] for g in got], k) for i, k in enumerate(kinds))
    unit_borders = np.concatenate(unit_borders)
    # rows of one id count as one document, one after the other
    _, head = np.unique(doc, return_index=True)
    opening = unit_borders[head[np.searchsorted(doc[head], doc[row])]] if len(row) else row
    _, seen, entry = np.unique(content, return_index=True, return_inverse=True)
    return Phrases(first, windows, trigger, doc[row], first - opening, start, end, unit_borders, entry, seen)


def _load(table: pa.Table, scheme: Scheme):
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    raw, borders = A.utf8(A.column(table, "text"))
    doc = A.ids(A.column(table, "doc_id"))
    return table, raw, borders, phrases(raw, borders, doc, scheme)


def _by_bucket(trigger: np.ndarray, buckets: int):
    """Order by trigger, and (bucket, low, high) for the buckets that are not empty."""
    bits = buckets.bit_length() - 1
    order = np.argsort(trigger, kind="stable")
    bucket = (trigger[order] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(order), np.int64)
    names, low = np.unique(bucket, return_index=True)
    return order, zip(names.tolist(), low.tolist(), [*low[1:].tolist(), len(order)])


TOLD = "bucket long, block long, hashes binary, twice binary"
_TOLD = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary())])
_SHARED = pa.schema([("block", pa.int64()), ("hashes", pa.binary())])


def told(block: int, hashes: np.ndarray, buckets: int) -> pa.Table:
    """The distinct hashes of a block by bucket, each with whether the block has it twice."""
    values, counts = np.unique(hashes, return_counts=True)
    rows = [
        (b, block, values[lo:hi].tobytes(), np.packbits(counts[lo:hi] > 1).tobytes())
        for b, lo, hi in _by_bucket(values, buckets)[1]
    ]
    return pa.table(dict(zip(_TOLD.names, map(list, zip(*rows)) if rows else ([],) * 4)), _TOLD)


def seen_twice(table: pa.Table) -> pa.Table:
    """For each block those of its hashes that the corpus has twice."""
    values = A.parts(table, "hashes", np.uint64)
    twice = [np.unpackbits(t, count=len(v)) for t, v in zip(A.parts(table, "twice", np.uint8), values)]
    merged, inverse = np.unique(np.concatenate(values), return_inverse=True)
    keep = (np.bincount(inverse, np.concatenate(twice) + np.ones(len(inverse)), len(merged)) > 1)[inverse]
    out, at = [], 0
    for block, v in zip(A.column(table, "block").to_pylist(), values):
        hit = v[keep[at : at + len(v)]]
        at += len(v)
        if len(hit):
            out.append((block, hit.tobytes()))
    return pa.table({"block": [x[0] for x in out], "hashes": [x[1] for x in out]}, _SHARED)


def is_known(shared: pa.Table, own: np.ndarray) -> np.ndarray:
    """Whether each hash is among those that came back to the block."""
    known = np.sort(A.joined(A.parts(shared, "hashes", np.uint64), np.uint64))
    if len(known) == 0:
        return np.zeros(len(own), np.bool_)
    return known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own


def _chosen(p: Phrases, shared: pa.Table) -> np.ndarray:
    """The distinct phrases whose trigger the corpus has twice."""
    return np.flatnonzero(is_known(shared, p.trigger[p.seen]))


def marked(docs: DataFrame, id_col: str, text_col: str, scheme: Scheme, finish: Callable, schema: str) -> DataFrame:
    """Apply ``finish(table, raw, borders, unit borders, covered)`` to each block; ``covered`` flags the units that lie
    in a window which the corpus has earlier. Rows are returned once each, in any order."""
    total = text_bytes(docs, text_col)
    blocks = buckets = size_class(total, BLOCK_BYTES)
    dealt = in_blocks(docs, id_col, text_col, blocks)

    def triggers(table: pa.Table) -> pa.Table:
        p = _load(table, scheme)[3]
        return told(table.column("block")[0].as_py(), p.trigger, buckets)

    fields = ("entry", "windows", "doc", "place", "sizes", "content")
    phrase_schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((f, pa.binary()) for f in fields)])

    def send(table: pa.Table, shared: pa.Table) -> pa.Table:
        if table.num_rows == 0 or shared.num_rows == 0:
            return phrase_schema.empty_table()
        block = table.column("block")[0].as_py()
        _, raw, _, p = _load(table, scheme)
        chosen = _chosen(p, shared)
        one = p.seen[chosen]
        order, groups = _by_bucket(p.trigger[one], buckets)
        rows = []
        for b, lo, hi in groups:
            i = one[order[lo:hi]]
            content = A.gather(raw, p.start[i], p.end[i])
            packed = (chosen[order[lo:hi]].astype(np.uint32), p.windows[i].astype(np.uint16), p.doc[i], p.place[i], (p.end[i] - p.start[i]).astype(np.uint32), content)
            rows.append((b, block, *(x.tobytes() for x in packed)))
        return pa.table(dict(zip(phrase_schema.names, map(list, zip(*rows)) if rows else ([],) * 8)), phrase_schema)

    answer_schema = pa.schema([("block", pa.int64()), ("entry", pa.binary()), ("hits", pa.binary())])

    def resolve(table: pa.Table) -> pa.Table:
        windows, doc, place, sizes, content = (
            A.joined(A.parts(table, f, k), k)
            for f, k in zip(fields[1:], (np.uint16, np.int64, np.int64, np.uint32, np.uint8))
        )
        borders = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        hits = scheme.resolve(content, scheme.units(content, borders), windows.astype(np.int64), doc, place)
        out, at, bit = [], 0, 0
        for block, entry in zip(A.column(table, "block").to_pylist(), A.parts(table, "entry", np.uint32)):
            n = windows[at : at + len(entry)].astype(np.int64)
            flags = hits[bit : bit + int(n.sum())]
            at, bit = at + len(entry), bit + len(flags)
            owner, _ = A.spread(n)
            some = np.bincount(owner, flags, len(n)) > 0
            if some.any():
                out.append((block, entry[some].tobytes(), np.packbits(flags[some[owner]]).tobytes()))
        return pa.table(dict(zip(answer_schema.names, map(list, zip(*out)) if out else ([],) * 3)), answer_schema)

    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, raw, borders, p = _load(table, scheme)
        step = np.zeros(int(p.borders[-1]) + 1, np.int32)
        earliest = p.seen[p.entry]
        # a later copy of a phrase within the block is removed whole
        copy = np.flatnonzero((p.doc != p.doc[earliest]) | (scheme.within & (earliest != np.arange(len(earliest)))))
        np.add.at(step, p.first[copy], 1)
        np.add.at(step, p.first[copy] + p.windows[copy] + scheme.window - 1, -1)
        entry = A.joined(A.parts(answers, "entry", np.uint32), np.uint32).astype(np.int64)
        if len(entry):
            n = p.windows[p.seen]
            flags = [np.unpackbits(h, count=int(n[e].sum())) for h, e in zip(A.parts(answers, "hits", np.uint8), A.parts(answers, "entry", np.uint32))]
            flag_of = np.zeros(len(n), np.int64)
            flag_of[entry] = np.cumsum(n[entry]) - n[entry]
            flags, known = np.concatenate(flags), np.zeros(len(n), np.bool_)
            known[entry] = True
            # the earliest copy has the bucket's answer, and so have its copies in the same document
            own = np.flatnonzero(known[p.entry] & (p.doc == p.doc[earliest]) & ((earliest == np.arange(len(earliest))) | (not scheme.within)))
            owner, place = A.spread(p.windows[own])
            hit = flags[flag_of[p.entry[own]][owner] + place] > 0
            begin = (p.first[own][owner] + place)[hit]
            np.add.at(step, begin, 1)
            np.add.at(step, begin + scheme.window, -1)
        covered = np.cumsum(step[:-1]) > 0
        return finish(table, raw, borders, p.borders, covered)

    whole = dealt.groupBy("block")
    shared = whole.applyInArrow(triggers, TOLD).groupBy("bucket").applyInArrow(seen_twice, "block long, hashes binary")
    sent = whole.cogroup(shared.groupBy("block")).applyInArrow(
        send, "bucket long, block long, " + ", ".join(f"{f} binary" for f in fields)
    )
    answers = sent.groupBy("bucket").applyInArrow(resolve, "block long, entry binary, hits binary")
    return whole.cogroup(answers.groupBy("block")).applyInArrow(mark, schema)

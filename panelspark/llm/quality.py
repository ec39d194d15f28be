"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import checkpointed
from . import arrays as A
from .blocks import in_small_batches

#: Words are counted in this many hashed rows of the vector table, so its size is fixed; words of one row share a vector.
BUCKETS = 1 << 14
DIMENSIONS = 32
#: Non-zero entries of a word's index vector, half of them +1 and half -1.
NONZERO = 4
#: Words on each side whose index vectors a word collects.
WINDOW = 2
#: Bound of the labelled rows that the network is fitted to (about so many, by a hash of the id).
TRAINING_ROWS = 40_000
HIDDEN = 32
EPOCHS = 40
MIN_SCORE = 0.3
_TOKENS = 1 << 16
_SLICE_BYTES = 4 << 20
_PARTS = 64

# shapes are words too, behind the hashed ones: lower case, first letter upper, all upper, mixed, number, sign, run of one sign, line end
_SHAPES = 8
ROWS = BUCKETS + _SHAPES
#: How alike a word's vector and those of the next words are is pooled too, for these distances.
AHEAD = (1, 2)
FEATURES = 2 * DIMENSIONS + 1 + len(AHEAD)

_KIND = np.arange(256, dtype=np.int16) + 3  # a sign forms runs with itself alone
_KIND[A.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = 1
_KIND[A.byte_class((0x30, 0x39))] = 2
_KIND[A.byte_class((0x20, 0x20), (0x09, 0x09), (0x0B, 0x0D))] = 0


def learnable(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, modulo 5, is not 0; never a row without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) != 0, F.lit(False))


def tokens(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token its row in the text list, its row in the vector table and that of its shape."""
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = _KIND[raw]
    cut = np.ones(len(raw), np.bool_)
    cut[1:] = kind[1:] != kind[:-1]
    cut[borders[:-1][borders[:-1] < len(raw)]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(raw))
    start, end = start[kind[start] > 0], end[kind[start] > 0]
    what, size = kind[start], end - start
    upper = np.concatenate([[0], np.cumsum((raw >= 0x41) & (raw <= 0x5A))])
    capitals, first = upper[end] - upper[start], (raw[start] >= 0x41) & (raw[start] <= 0x5A)
    letters = np.where(capitals == 0, 0, np.where(first & (capitals == 1), 1, np.where(capitals == size, 2, 3)))
    shape = np.where(what == 1, letters, np.where(what == 2, 4, np.where(raw[start] == 0x0A, 7, np.where(size > 1, 6, 5))))
    word = (A.span_hashes(A.byte_codes()[A.lower(raw)], start, end) % np.uint64(BUCKETS)).astype(np.int64)
    word = np.where(what == 2, BUCKETS + 4, word)  # a number is known by its shape alone
    return np.searchsorted(borders, start, "right") - 1, word, shape + BUCKETS


def index_vectors() -> np.ndarray:
    """The sparse ternary vector of every row of the table, from its number alone."""
    out = np.zeros((ROWS, DIMENSIONS), np.int8)
    rng = np.random.default_rng(1)
    places = np.argsort(rng.random((ROWS, DIMENSIONS)), axis=1)[:, :NONZERO]
    out[np.arange(ROWS)[:, None], places] = np.where(np.arange(NONZERO) % 2, -1, 1)
    return out


def _context_sums(owner: np.ndarray, word: np.ndarray, shape: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Add to every token's rows of ``total`` the index vectors of the WINDOW tokens on each side within its document."""
    for lo in range(0, len(word), _TOKENS):
        near = slice(max(0, lo - WINDOW), lo + _TOKENS + WINDOW)
        own, w, s = owner[near], word[near], shape[near]
        vectors = index[w] + index[s]
        got = np.zeros(vectors.shape, np.int32)
        for k in range(1, WINDOW + 1):
            same = (own[k:] == own[:-k])[:, None]
            got[k:] += vectors[:-k] * same
            got[:-k] += vectors[k:] * same
        mine = slice(lo - near.start, lo - near.start + _TOKENS)
        got = got[mine]
        for row in (w[mine], s[mine]):
            order = np.argsort(row, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]]))
            total[row[order[first]]] += np.add.reduceat(got[order], first, axis=0)


def learn_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word vectors of the whole corpus: per row of the table the sum of its contexts' index vectors over all texts, without
    the direction that all words share, at length 1. The table has ROWS x DIMENSIONS entries whatever the corpus's size."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((ROWS, DIMENSIONS), np.int64)
        for b in batches:
            raw, borders = A.utf8(b.column("text"))
            for lo, hi in A.slices(borders, _SLICE_BYTES):
                _context_sums(*tokens(raw[borders[lo] : borders[hi]], borders[lo : hi + 1] - borders[lo]), index, total)
        part = np.array_split(np.arange(ROWS), _PARTS)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(_PARTS), pa.int32()), "sums": [total[p].tobytes() for p in part]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, sums in zip(b.column("part").to_pylist(), A.parts(b, "sums", np.int64)):
                held[part] = held[part] + sums if part in held else sums
        yield pa.RecordBatch.from_pydict({"part": pa.array(held.keys(), pa.int32()), "sums": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    schema = "part int, sums binary"
    partial = in_small_batches(docs.select(F.col(text_col).alias("text"))).mapInArrow(summed, schema)
    found = {r["part"]: np.frombuffer(r["sums"], np.int64) for r in partial.repartition(_PARTS, "part").mapInArrow(added, schema).collect()}
    total = np.concatenate([found[p] for p in range(_PARTS)]) if found else np.zeros(ROWS * DIMENSIONS, np.int64)
    vectors = total.reshape(ROWS, DIMENSIONS).astype(np.float64)

    def unit(v: np.ndarray) -> np.ndarray:
        size = np.sqrt((v * v).sum(axis=-1, keepdims=True))
        return v / np.where(size > 0, size, 1)

    shared = unit(vectors.sum(axis=0))
    return unit(vectors - np.outer(vectors @ shared, shared)).astype(np.float32)


def _pooled(raw: np.ndarray, borders: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text the mean and the standard deviation of its tokens' vectors, the mean product of a word's vector with that of
    the word behind it and of the next but one (1 where a word is repeated), and the logarithm of the number of tokens."""
    owner, word, shape = tokens(raw, borders)
    n = np.bincount(owner, minlength=len(borders) - 1).astype(np.float64)
    sums, alike = np.zeros((2, len(n), DIMENSIONS)), np.zeros((len(AHEAD), len(n)))
    for lo in range(0, len(word), _TOKENS):
        v = vectors[word[lo : lo + _TOKENS]] + vectors[shape[lo : lo + _TOKENS]]
        own = owner[lo : lo + _TOKENS]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums[0][own[first]] += np.add.reduceat(v, first, axis=0, dtype=np.float64)
        sums[1][own[first]] += np.add.reduceat(v * v, first, axis=0, dtype=np.float64)
        for k, step in enumerate(AHEAD):
            other = word[lo + step : lo + _TOKENS + step]
            pair = np.einsum("ij,ij->i", vectors[word[lo : lo + len(other)]], vectors[other])
            pair = pair * (owner[lo + step : lo + _TOKENS + step] == own[: len(other)])
            alike[k] += np.bincount(own[: len(other)], pair, len(n))
    mean, square = sums / np.maximum(n, 1)[None, :, None]
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, spread, (alike / np.maximum(n, 1)).T, np.log1p(n)[:, None]]).astype(np.float32)


def document_vectors(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features): FEATURES floats of each whole text, packed; a text without tokens has zeros alone."""

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, borders = A.utf8(b.column("text"))
            got = [_pooled(raw[borders[lo] : borders[hi]], borders[lo : hi + 1] - borders[lo], vectors) for lo, hi in A.slices(borders, _SLICE_BYTES)]
            rows = np.vstack(got) if got else np.zeros((0, FEATURES), np.float32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "features"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(pooled, "doc_id long, features binary")


@dataclass(frozen=True)
class Network:
    """Centre and scale of the inputs, two layers, and the temperature that the logit is divided by."""

    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(z, -60, 60) / 2))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, calibration: np.ndarray, epochs: int = EPOCHS, hidden: int = HIDDEN) -> Network:
    """A tanh layer and a logistic one by Adam on the rows outside ``calibration``; the temperature by the least log loss of
    the rows inside. With rows of one label alone, every score is that label's share, smoothed by one row of each."""
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    flat = (np.zeros((x.shape[1], hidden)), np.zeros(hidden), np.zeros((hidden, 1)), np.array([prior]))
    fitted = ~calibration
    if len(set(y[fitted].tolist())) < 2:
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), flat, 1.0)
    centre, scale = x[fitted].mean(axis=0), x[fitted].std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    rng = np.random.default_rng(7)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), flat[0].shape), flat[1], rng.normal(0, 1 / np.sqrt(hidden), flat[2].shape), flat[3]]
    inputs, target = (x[fitted] - centre) / scale, y[fitted].astype(np.float64)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), 128):
            some = order[lo : lo + 128]
            inner = np.tanh(inputs[some] @ layers[0] + layers[1])
            error = ((_sigmoid((inner @ layers[2] + layers[3])[:, 0]) - target[some]) / len(some))[:, None]
            back = error @ layers[2].T * (1 - inner * inner)
            slopes = [inputs[some].T @ back + 1e-4 * layers[0], back.sum(axis=0), inner.T @ error + 1e-4 * layers[2], error.sum(axis=0)]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, (m, v), g in zip(layers, moments, slopes):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * m / (np.sqrt(v) + 1e-8)
    net = Network(centre, scale, tuple(layers), 1.0)
    if not calibration.any():
        return net
    z, known = net.logits(x[calibration]), y[calibration]
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    return Network(centre, scale, tuple(layers), float(min(choices, key=lambda t: _loss(z / t, known))))


def fit_quality(
    features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAINING_ROWS
) -> Network:
    """Fit to the labelled rows that may be learned (``learnable``), at most about ``rows`` of them by a hash of the id. Null
    labels are none; a repeated id counts as often as it is there; a fifth of the rows only sets the temperature."""
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("y"))
    known = known.filter(learnable())
    share = min(1.0, rows / max(1, known.count()))
    known = known.filter(F.xxhash64("doc_id").cast("double") <= share * 2.0**64 - 2.0**63)
    checksum = F.crc32(F.concat(F.lit("calibration:"), F.col("doc_id").cast("string")).cast("binary"))
    found = features.join(known, "doc_id").select("doc_id", "features", "y", (F.pmod(checksum, F.lit(5)) == 0).alias("held")).collect()
    found = sorted((r["doc_id"], bytes(r["features"]), r["y"], r["held"]) for r in found)
    x = np.array([np.frombuffer(r[1], np.float32) for r in found], np.float64).reshape(len(found), FEATURES)
    return fit_network(x, np.array([r[2] for r in found], np.int64), np.array([r[3] for r in found], np.bool_))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted (score >= MIN_SCORE) of every row.

    The word vectors count the contexts of all whole texts; labels come from ``labels``, only of rows that may be learned
    and never those of held-out rows. Null and empty texts have the vector of no words and are scored like any other;
    rows without an id are scored and not held out; repeated rows have equal scores; with no labels every score is 0.5.
    Columns besides the id and the text are not read.
    """
    features = checkpointed(document_vectors(docs, learn_vectors(docs, text_col), id_col, text_col))
    network = fit_quality(features, labels, id_col, label_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(A.parts(b, "features", np.float32), np.float64).reshape(b.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(network.scores(x), pa.float64())], ["doc_id", "score"])

    out = features.mapInArrow(scored, "doc_id long, score double")
    held = ~learnable() & F.col("doc_id").isNotNull()
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= MIN_SCORE).cast("int").alias("predicted"))

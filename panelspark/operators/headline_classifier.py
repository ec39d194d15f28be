"""A logistic classifier of headline words and word pairs, cross-validated over folds.

The texts become term numbers once, in a stored table, and those become blocks of texts in the order of their terms. Every pass
over the blocks gives loss and gradient of the models of all folds together, so the folds share their passes, and each
regularisation starts from the solution of the stronger one before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import checkpointed
from .training import assign_folds, class_weights, sample_weights

FEATURES = 1 << 18
REGULARISATION = (0.1, 0.01)
MAX_STEPS = 50
TOLERANCE = 1e-5
_MEMORY = 10
#: Bytes of the gradient that one task adds up.
_PART_BYTES = 2 << 20
#: Terms of one block of texts, about.
_BLOCK_TERMS = 1 << 19
_BLOCKS = "fold binary, y binary, w binary, share binary, terms binary, sizes binary, owner binary, tf binary"


def terms(title: str, features: int) -> Column:
    """Numbers of the words (0 to features - 1) and of the pairs of neighbouring words (features and up), repeats included."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(title), F.lit(""))), r"\W+", -1), lambda w: w != "")
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    # both sides are slices: an index into the words within the function would split the title again for every pair
    pairs = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.pmod(F.hash(a, b), F.lit(features)) + features)
    return F.concat(F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(features))), pairs).cast("array<int>")


@dataclass(frozen=True)
class Classifier:
    """The chosen regularisation, the mean F1 of every one tried, and per fold (and for all rows, -1) its coefficients."""

    features: int
    regularisation: float
    f1: dict[float, float]
    used: np.ndarray
    coefficients: np.ndarray
    folds: tuple[int, ...]

    def scored(self, df: DataFrame, fold: str | None = None, title: str = "title", numbers: str | None = None) -> DataFrame:
        """Add ``probability`` of relevance and ``prediction``, by the model of all rows or of the row's ``fold``.

        ``numbers`` is a column that has the ``terms`` of the titles already; it is dropped.
        """
        rows = df.withColumn("_terms", terms(title, self.features)) if numbers is None else df.withColumnRenamed(numbers, "_terms")
        rows = rows.withColumn("_model", F.col(fold) if fold else F.lit(-1))
        sent = df.sparkSession.sparkContext.broadcast((_places(self.used, self.features), self.coefficients, self.folds))

        @F.pandas_udf("double")
        def score(found, model):
            import pandas as pd

            place, beta, folds = sent.value
            column = np.array([folds.index(m) for m in model], np.int64)
            sizes = np.array([len(t) for t in found], np.int64)
            at = place[np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)]
            known = at >= 0
            owner = np.repeat(np.arange(len(sizes)), sizes)
            # the last coefficient is the constant
            z = beta[column, -1] + _share(sizes) * np.bincount(owner[known], beta[column[owner[known]], at[known]], len(sizes))
            return pd.Series(_sigmoid(z))

        rows = rows.withColumn("probability", score("_terms", "_model")).drop("_terms", "_model")
        return rows.withColumn("prediction", (F.col("probability") >= 0.5).cast("double"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(z, -500, 500) / 2))


def _share(sizes: np.ndarray) -> np.ndarray:
    """What a term counts in a text: long texts weigh no more than short ones."""
    return 1 / np.sqrt(np.maximum(sizes, 1))


def _places(used: np.ndarray, features: int) -> np.ndarray:
    """The place of each term number among those in use, -1 for the others."""
    place = np.full(2 * features, -1, np.int32)
    place[used] = np.arange(len(used))
    return place


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (fold, y, w, terms): a row per block of texts, as packed arrays. The terms of a block come once, in order, and for
    each its texts (owner) with how often they have it, so that a pass goes through its arrays in order."""
    for batch in batches:
        lengths = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        number = (np.cumsum(lengths) - lengths) // _BLOCK_TERMS
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if batch.num_rows else []
        for at, end in zip(starts, [*starts[1:], batch.num_rows]):
            part, held = batch.slice(at, end - at), lengths[at:end]
            each = part.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            pair, tf = np.unique(each << 32 | np.repeat(np.arange(end - at), held), return_counts=True)
            found, sizes = np.unique(pair >> 32, return_counts=True)
            fold, y, w = (part.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y", "w"))
            arrays = [fold.astype(np.int32), y.astype(np.int32), w.astype(float), _share(held), found.astype(np.int32), sizes.astype(np.int32)]
            arrays += [(pair & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], [c.split()[0] for c in _BLOCKS.split(", ")])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each block, with ``first``, where each term's texts begin."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = {c: np.frombuffer(batch.column(c)[i].as_buffer(), float if c in ("w", "share") else np.int32) for c in batch.schema.names}
            yield block | {"first": np.cumsum(block["sizes"], dtype=np.int64) - block["sizes"]}


def _linear(block: dict[str, np.ndarray], beta: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What a model (the constant last) gives each text of a block; ``value`` is what each term counts in each of its texts."""
    return beta[-1] + np.bincount(block["owner"], np.repeat(beta[at], block["sizes"]) * value, len(block["y"]))


class _Passes:
    """Loss and gradient of all models at given coefficients, by one pass over the stored blocks."""

    def __init__(self, blocks: DataFrame, place: np.ndarray, size: int, folds: tuple[int, ...], weights: np.ndarray):
        self.blocks, self.size, self.folds, self.weights, self.count = blocks, size, folds, weights, 0
        self.place = blocks.sparkSession.sparkContext.broadcast(place)

    def __call__(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted loss sums per model, and their gradient; a row per model, the constant last."""
        self.count += 1
        sent, place = self.blocks.sparkSession.sparkContext.broadcast(beta), self.place
        size, folds, class_weight = self.size, self.folds, self.weights
        parts = 1 + beta.nbytes // _PART_BYTES

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = sent.value
            sums = np.zeros((len(folds), size + 2))  # gradient, that of the constant, loss
            for block in _unpacked(batches):
                at, y, owner = place.value[block["terms"]], block["y"], block["owner"]
                value = block["tf"] * block["share"][owner]
                for k in range(len(folds)):
                    z = _linear(block, b[k], at, value)
                    weight = block["w"] * class_weight[k][y] * (block["fold"] != folds[k])
                    sums[k, -1] += np.sum(weight * (np.logaddexp(0, z) - y * z))
                    r = weight * (_sigmoid(z) - y)
                    if len(at):
                        sums[k, at] += np.add.reduceat(r[owner] * value, block["first"])
                    sums[k, -2] += r.sum()
            packed = [x.tobytes() for x in np.array_split(sums.ravel(), parts)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "sums": pa.array(packed, pa.binary())})

        held = self.blocks.mapInArrow(partial, "part int, sums binary").repartition(parts, "part").mapInArrow(_added, "part int, sums binary").collect()
        sent.destroy()
        found = {r["part"]: np.frombuffer(r["sums"]) for r in held}
        total = np.concatenate([found[p] for p in range(parts)]).reshape(len(folds), size + 2) if found else np.zeros((len(folds), size + 2))
        return total[:, -1], total[:, :-1]

    def f1(self, beta: np.ndarray) -> float:
        """The mean F1 of the folds' own rows, each predicted by the model of the other folds."""
        sent, place, folds = self.blocks.sparkSession.sparkContext.broadcast(beta), self.place, self.folds

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _unpacked(batches):
                at, yes = place.value[block["terms"]], block["y"] == 1
                value = block["tf"] * block["share"][block["owner"]]
                here = [k for k in range(len(folds)) if (block["fold"] == folds[k]).any()]
                up = [_sigmoid(_linear(block, sent.value[k], at, value)) >= 0.5 for k in here]
                own = [block["fold"] == folds[k] for k in here]
                hits = [[int((o & u & yes).sum()), int((o & (u != yes)).sum())] for o, u in zip(own, up)]
                yield pa.RecordBatch.from_pydict({"fold": pa.array([folds[k] for k in here], pa.int32()), **{c: pa.array([h[i] for h in hits], pa.int64()) for i, c in enumerate(("tp", "wrong"))}})

        each = self.blocks.mapInArrow(judged, "fold int, tp long, wrong long").groupBy("fold").agg(F.sum("tp").alias("tp"), F.sum("wrong").alias("wrong")).collect()
        sent.destroy()
        return float(np.mean([2 * r["tp"] / max(1, 2 * r["tp"] + r["wrong"]) for r in each])) if each else 0.0


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for part, sums in zip(b.column("part").to_pylist(), b.column("sums")):
            got = np.frombuffer(sums.as_buffer())
            held[part] = held[part] + got if part in held else got
    yield pa.RecordBatch.from_pydict({"part": pa.array(held.keys(), pa.int32()), "sums": pa.array([s.tobytes() for s in held.values()], pa.binary())})


def _minimised(passes: _Passes, scale: np.ndarray, mass: np.ndarray, reg: float, start: np.ndarray) -> np.ndarray:
    """L-BFGS on every row of ``start`` at once: mean weighted loss plus half the penalty on all but the constant.

    ``scale`` (idf, 1 for the constant) turns coefficients of scaled terms into those of term counts.
    """
    penalty = np.full(start.shape[1], reg)
    penalty[-1] = 0.0

    def at(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss, slope = passes(beta * scale)
        return loss / mass + 0.5 * (penalty * beta * beta).sum(axis=1), slope * scale / mass[:, None] + penalty * beta

    beta = start.copy()
    value, slope = at(beta)
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in beta]
    step, move, done = np.ones(len(past)), np.zeros_like(beta), np.zeros(len(past), bool)
    fresh = ~done
    for _ in range(MAX_STEPS):
        for k in np.flatnonzero(fresh & ~done):
            move[k] = _direction(slope[k], past[k])
            step[k] = 1.0 if past[k] else min(1.0, 1.0 / max(1e-12, float(np.abs(slope[k]).sum())))
        trial = beta + move * np.where(done, 0.0, step)[:, None]
        new_value, new_slope = at(trial)
        enough = new_value <= value + 1e-4 * step * (slope * move).sum(axis=1)
        for k in np.flatnonzero(~done):
            if enough[k]:
                s, g = trial[k] - beta[k], new_slope[k] - slope[k]
                if _dot(s, g) > 1e-12 * _dot(g, g):
                    past[k] = [*past[k], (s, g)][-_MEMORY:]
                done[k] = value[k] - new_value[k] <= TOLERANCE * max(abs(value[k]), 1e-12)
                beta[k], value[k], slope[k] = trial[k], new_value[k], new_slope[k]
            else:
                step[k] /= 4
                done[k] = step[k] < 1e-10
            fresh[k] = enough[k]
        if done.all():
            break
    return beta


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return float((a * b).sum())


def _direction(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, kept = slope.copy(), []
    for s, g in reversed(past):
        kept.append(_dot(s, q) / _dot(s, g))
        q -= kept[-1] * g
    if past:
        s, g = past[-1]
        q *= _dot(s, g) / _dot(g, g)
    for (s, g), a in zip(past, reversed(kept)):
        q += (a - _dot(g, q) / _dot(s, g)) * s
    return -q


def _idf(blocks: DataFrame, dealt: DataFrame, folds: tuple[int, ...], features: int) -> tuple[np.ndarray, np.ndarray]:
    """The term numbers in use and their idf among the rows outside each fold; at most two arrays of all features a fold."""
    in_fold = dealt.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["fold"]: r["n"] for r in in_fold}
    own = [f for f in folds if f >= 0]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many texts of each fold each term is, a row for those with any."""
        sums = np.zeros((len(own), 2 * features), np.int64)
        for block in _unpacked(batches):
            if len(block["terms"]):
                fold = block["fold"][block["owner"]]
                for k, f in enumerate(own):
                    sums[k, block["terms"]] += np.add.reduceat((fold == f).astype(np.int64), block["first"])
        for k, f in enumerate(own):
            t = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_pydict({"t": pa.array(t.astype(np.int32)), "fold": pa.array(np.full(len(t), f, np.int32)), "n": pa.array(sums[k][t])})

    counts = blocks.mapInArrow(counted, "t int, fold int, n long").groupBy("t", "fold").agg(F.sum("n").alias("n")).toArrow()
    t, fold, c = (counts.column(x).to_numpy() for x in ("t", "fold", "n"))
    used, at = np.unique(t, return_inverse=True)
    every = np.bincount(at, c, len(used))
    df = np.stack([every - np.bincount(at[fold == f], c[fold == f], len(used)) for f in folds])
    rest = np.array([sum(n.values()) - n.get(f, 0) for f in folds], float)
    return used.astype(np.int64), np.log((rest[:, None] + 1) / (df + 1))


def _fitted(df: DataFrame, folds: int, seed: int, features: int, reg: tuple[float, ...], title: str) -> tuple[Classifier, DataFrame]:
    """The classifier, and the labelled rows with their ``fold`` and ``_terms``."""
    known = df.filter(F.col("label").isin("relevant", "irrelevant"))
    # the titles are read and split here alone; folds are dealt by ids and labels
    rows = checkpointed(known.withColumns({"_row": F.monotonically_increasing_id(), "_terms": terms(title, features)}))
    heads = rows.select("_row", "id", "label", *[c for c in ("source",) if c in rows.columns])
    heads = sample_weights(heads) if "source" in rows.columns else heads.withColumn("sample_weight", F.lit(1.0))
    dealt = checkpointed(assign_folds(heads, folds, seed=seed))
    models = (*range(folds), -1)
    y = (F.col("label") == "relevant").cast("int").alias("y")
    judged = dealt.select("_row", "fold", y, F.col("sample_weight").alias("w"))
    table = rows.select("_row", F.col("_terms").alias("terms")).join(judged, "_row").select("fold", "y", "w", "terms")
    blocks = checkpointed(table.mapInArrow(_blocks, _BLOCKS))
    used, idf = _idf(blocks, dealt, models, features)
    weights = np.ones((folds + 1, 2))
    for k, f in enumerate(models):
        row = class_weights(dealt.filter(F.col("fold") != f)).first()
        weights[k] = [row["w_irrelevant"] or 1.0, row["w_relevant"] or 1.0]
    sums = {(r["fold"], r["y"]): r["w"] for r in judged.groupBy("fold", "y").agg(F.sum("w").alias("w")).collect()}
    mass = np.array([sum(w * weights[k][c] for (g, c), w in sums.items() if g != f) for k, f in enumerate(models)])
    mass = np.where(mass > 0, mass, 1.0)
    scale = np.hstack([idf, np.ones((folds + 1, 1))])
    passes = _Passes(blocks, _places(used, features), len(used), models, weights)
    beta, f1, found = np.zeros(scale.shape), {}, {}
    for strength in sorted(reg, reverse=True):
        beta = _minimised(passes, scale, mass, strength, beta)
        found[strength] = Classifier(features, strength, f1, used, beta * scale, models)
        f1[strength] = passes.f1(beta * scale)
    best = max(f1, key=lambda r: (f1[r], r))
    return found[best], rows.join(dealt.select("_row", "fold"), "_row").select(*df.columns, "fold", "_terms")


def fit_classifier(
    df: DataFrame, folds: int = 5, seed: int = 42, features: int = FEATURES, reg: tuple[float, ...] = REGULARISATION, title: str = "title"
) -> tuple[Classifier, DataFrame]:
    """The classifier, and the labelled rows with the ``fold`` they were dealt to.

    Each fold's model sees the other folds alone, idf and class weights included; a term counts idf divided by the root of the text's number of terms; the regularisation with the best mean F1
    of the folds' own rows is chosen. Rows weigh by source and class. Rows with another label than relevant or irrelevant
    are left out; a null title has no terms; with one label alone the model is a constant.
    """
    model, rows = _fitted(df, folds, seed, features, reg, title)
    return model, rows.drop("_terms")


def held_out_scores(
    df: DataFrame, folds: int = 5, seed: int = 42, features: int = FEATURES, reg: tuple[float, ...] = REGULARISATION, title: str = "title"
) -> DataFrame:
    """Every labelled row with the probability and prediction of the model fitted to the other folds alone."""
    model, rows = _fitted(df, folds, seed, features, reg, title)
    return model.scored(rows, "fold", title, "_terms").select(*df.columns, "probability", "prediction")

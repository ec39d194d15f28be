"""Sums of cross-products. Rows stay in Spark; only k-by-k matrices reach numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# up to this many columns every product is a JVM sum; beyond, generated code grows with k squared and Arrow batches win
NARROW = 8
# groups whose partial sums a task holds before it passes them on
_HELD_GROUPS = 4096


def gram(df: DataFrame, by: list[str], cols: list[Column | str]) -> DataFrame:
    """Per group: row count ``n`` and ``g``, the upper triangle of X'X row by row."""
    x = [F.col(c) if isinstance(c, str) else c for c in cols]
    k = len(x)
    names = [f"_x{i}" for i in range(k)]
    named = df.select(*by, *[c.cast("double").alias(n) for n, c in zip(names, x)])
    if k <= NARROW or not by:
        sums = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(k) for j in range(i, k)]
        return named.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("g"))
    upper = np.triu_indices(k)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields if f.name in by)
    schema = f"{head}, n long, g array<double>"

    def table(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*key, n, g[upper].tolist()) for key, (g, n) in held.items()], columns=[*by, "n", "g"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            m = pdf[names].to_numpy(dtype=float)
            for key, rows in pdf.groupby(by, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                g, n = held.get(key, (0.0, 0))
                held[key] = (g + m[rows].T @ m[rows], n + len(rows))
            if len(held) > _HELD_GROUPS:
                yield table(held)
                held = {}
        yield table(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Add the partial sums of one group, at most a few per input partition."""
        first = tuple(pdf[b].iloc[0] for b in by)
        return pd.DataFrame([(*first, int(pdf["n"].sum()), np.vstack(pdf["g"]).sum(axis=0).tolist())], columns=[*by, "n", "g"])

    return named.mapInPandas(partial, schema).groupBy(*by).applyInPandas(merge, schema)


def unpack(g, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = np.asarray(g, dtype=float)
    return m + m.T - np.diag(np.diag(m))


def total_gram(df: DataFrame, cols: list[Column | str]) -> tuple[int, np.ndarray]:
    """Row count and X'X over all rows of a few columns."""
    row = gram(df, [], cols).first()
    k = len(cols)
    return (row["n"], unpack(row["g"], k)) if row["n"] else (0, np.zeros((k, k)))


def moving_sums(df: DataFrame, by: list[str], pos: str, scores: list[str], lags: Column) -> DataFrame:
    """Sums of each score over positions t-lags..t, for t up to ``lags`` past the end.

    With Bartlett weights the long-run covariance is their Gram matrix divided by lags + 1, so no lagged products are
    needed and the sums may run over any stacked order.
    """
    spread = df.select(*by, F.explode(F.sequence(F.col(pos), F.col(pos) + lags)).alias("_t"), *scores)
    return spread.groupBy(*by, "_t").agg(*[F.sum(s).alias(s) for s in scores])

"""Registry of named queries: a Spark plan over ``Tables`` and, where SQL can say it, an equivalent statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..views import Tables, oracle_text

# Doubles are compared at six decimals. The shift moves values lying exactly half-way between two roundings, which
# engines that sum in different orders would otherwise round to different sides.
DIGITS = 6
SHIFT = 1.3e-8


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    oracle: str | None
    doubles: tuple[str, ...]

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(self.build(Tables(spark, sf_dir)))

    def sql(self) -> str | None:
        if self.oracle is None:
            return None
        text = oracle_text(self.oracle)
        if not self.doubles:
            return text
        rounded = ", ".join(f"round(CAST({c} AS DOUBLE) + {SHIFT!r}, {DIGITS}) + 0 AS {c}" for c in self.doubles)
        return f"SELECT * REPLACE ({rounded}) FROM ({text}) AS result"


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, doubles: str = ""):
    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, oracle, tuple(doubles.split()))
        return build

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles and widen small integers so that two engines show the same values."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c + SHIFT, DIGITS) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long").alias(f.name)
        cols.append(c)
    return df.select(*cols)

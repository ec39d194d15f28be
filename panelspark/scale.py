"""Building blocks that keep hot groups out of a single task.

Any key may hold a large share of all rows, so none of these helpers sorts or collects a whole group in one place.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one named by ``spark.checkpoint.dir``.

    Only a local session may go without it: it gets a folder of its own, which is removed when Python ends.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            own = tempfile.mkdtemp(prefix="panelspark-", dir="/tmp")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            sc.setCheckpointDir(own)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{sc.getCheckpointDir()}/{uuid.uuid4()}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Store the rows as a table in the shared folder and read them back.

    This cuts the lineage, pins values that must not change if a task runs again, survives lost executors, and, unlike a
    checkpointed RDD, keeps column pruning and the size that decides between broadcast and shuffle joins.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rank_in_group(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name`` = 1-based position within ``keys`` by ``order`` (a total order), for groups of any size.

    Rows are range-partitioned by (keys, order), so a large group spans many partitions. Positions come from each
    partition's own running id plus the number of rows of the group in earlier partitions.
    """
    exprs = [F.col(k) for k in keys] + list(order)
    rows = checkpointed(
        df.repartitionByRange(*exprs).sortWithinPartitions(*exprs).withColumn("__row", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__row", 33))
    starts = rows.groupBy(*keys, "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("_n"))
    # one row per (group, partition): the window holds at most as many rows as there are partitions
    earlier = F.sum("_n").over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("__part")) - F.col("_n")
    starts = starts.withColumn("__off", earlier - F.col("__first") + 1).drop("__first", "_n")
    out = rows.join(starts, [*keys, "__part"]).withColumn(name, F.col("__row") + F.col("__off"))
    return out.drop("__row", "__part", "__off")


def _in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in ranges of the order, with ``__row`` that grows along it and ``__part``, the range."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    return checkpointed(rows).withColumn("__part", F.shiftright("__row", 33))


def previous(df: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """Add ``name``, the value of the row before in one series of any length: within ranges of the order, and from the end of
    the range before at their borders (one row per range)."""
    rows = _in_ranges(df.withColumn("__v", value), order)
    ends = rows.groupBy("__part").agg(F.max_by("__v", "__row").alias("__end"))
    ends = ends.select("__part", F.lag("__end").over(W.orderBy("__part")).alias("__end"))
    own = W.partitionBy("__part").orderBy("__row")
    out = rows.join(ends, "__part").withColumn(name, F.when(F.row_number().over(own) == 1, F.col("__end")).otherwise(F.lag("__v").over(own)))
    return out.drop("__v", "__end", "__row", "__part")


def filled(df: DataFrame, cols: list[str], order: list[Column]) -> DataFrame:
    """Replace nulls by the last value before them in one series of any length, those before the first value by that value."""
    rows = _in_ranges(df, order)
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("__row"))
    ends = rows.groupBy("__part").agg(*[F.max_by(c, known(c)).alias("__end_" + c) for c in cols])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("__part", *[F.last("__end_" + c, ignorenulls=True).over(before).alias("__end_" + c) for c in cols])
    first = rows.agg(F.struct(*[F.min_by(c, known(c)).alias(c) for c in cols]).alias("s")).select("s").scalar()
    own = W.partitionBy("__part").orderBy("__row").rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(ends, "__part").withColumn("__first", first)
    out = out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(own), F.col("__end_" + c), F.col(f"__first.{c}")) for c in cols})
    return out.drop("__first", "__row", "__part", *["__end_" + c for c in cols])


def _magnitude_bucket(value: Column) -> Column:
    """A non-decreasing bucket number of a double: 256 buckets per power of two on each side of zero."""
    level = F.floor((F.log2(F.abs(value)) + 1100) * 256)
    return F.when(value == 0, F.lit(0)).when(value > 0, level).otherwise(-level).cast("long")


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    count_name: str | None = None,
    mean_name: str | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group without holding a group in one task.

    Values are first reduced to (group, bucket, value, count); bucket totals locate the bucket of every wanted rank,
    and only those buckets are ordered, in ranges that may cut them.
    """
    const = [] if keys else ["_all"]
    src = df.filter(F.col(value).isNotNull()) if keys else df.filter(F.col(value).isNotNull()).withColumn("_all", F.lit(1))
    keys = keys or const
    src = src.select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_b", _magnitude_bucket(F.col("_v")))
    # the join below implies these tests for one of its sides; stating them for both lets the two sides share one shuffle
    for c in [*keys, "_b"]:
        src = src.filter(F.col(c).isNotNull())
    counts = src.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"), F.sum(F.col("_v") * F.col("_n")).alias("_bs"))
    by_bucket = W.partitionBy(*keys).orderBy("_b")
    whole = W.partitionBy(*keys)
    totals = (
        totals.withColumn("_before", F.sum("_bn").over(by_bucket) - F.col("_bn"))
        .withColumn("_total", F.sum("_bn").over(whole))
        .withColumn("_mean", F.sum("_bs").over(whole) / F.col("_total"))
    )
    pos = {n: (F.col("_total") - 1) * F.lit(float(p)) for n, p in probs.items()}
    wanted = None
    for h in pos.values():
        for rank in (F.floor(h), F.ceil(h)):
            hit = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_bn"))
            wanted = hit if wanted is None else wanted | hit
    picked = totals.filter(wanted).drop("_bn", "_bs")
    # a bucket may hold most values of a group, so the running count goes through ranges of it
    rows = _in_ranges(counts.join(picked, [*keys, "_b"]), [F.col(c) for c in (*keys, "_b", "_v")])
    part = rows.groupBy(*keys, "_b", "__part").agg(F.sum("_n").alias("_pn"))
    earlier = F.sum("_pn").over(W.partitionBy(*keys, "_b").orderBy("__part")) - F.col("_pn")
    part = part.withColumn("_earlier", earlier).drop("_pn")
    run = F.sum("_n").over(W.partitionBy(*keys, "_b", "__part").orderBy("__row"))
    rows = rows.withColumn("_run", run).join(part, [*keys, "_b", "__part"]).withColumn("_cum", F.col("_before") + F.col("_earlier") + F.col("_run"))
    aggs = [F.max("_total").alias("_total"), F.max("_mean").alias("_mean")]
    for i, h in enumerate(pos.values()):
        aggs.append(F.min(F.when(F.col("_cum") > F.floor(h), F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("_cum") > F.ceil(h), F.col("_v"))).alias(f"_hi{i}"))
    out = rows.groupBy(*keys).agg(*aggs)
    cols = [F.col(k) for k in keys if k not in const]
    if count_name:
        cols.append(F.col("_total").alias(count_name))
    if mean_name:
        cols.append(F.col("_mean").alias(mean_name))
    for i, (n, h) in enumerate(pos.items()):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        cols.append((lo + (hi - lo) * (h - F.floor(h))).alias(n))
    return out.select(*cols)


def sampling_hash(id_col: str, seed: int) -> Column:
    """Deterministic pseudo-random key of a row: the hexadecimal SHA-256 of ``id:seed``, which any engine can compute."""
    return F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))), 256)


def unit_hash(id_col: str, seed: int) -> Column:
    """Deterministic value in (0, 1) from the first 13 hexadecimal digits of the key."""
    return (F.conv(F.substring(sampling_hash(id_col, seed), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)

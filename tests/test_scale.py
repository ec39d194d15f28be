"""Helpers that split hot groups, and the sampling operators built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import matrices, training
from panelspark.scale import checkpointed, group_quantiles, rank_in_group


def hot(spark, n=5000):
    """Most rows share one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5).alias("k"), "id", ((F.col("id") * 7919) % 1013 / 100 - 5).alias("v")
    )


def test_quantiles_equal_numpy(spark):
    df = hot(spark)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in group_quantiles(df, ["k"], "v", probs, "n", "m").collect()}
    pdf = df.toPandas()
    for k, part in pdf.groupby("k"):
        assert got[k]["n"] == len(part) and got[k]["m"] == pytest.approx(part.v.mean())
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(part.v, p))
    assert group_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(pdf.v.median())


def test_quantiles_of_repeated_and_null_values(spark):
    df = spark.createDataFrame([(1, 0.0)] * 5 + [(1, None), (2, -1.0), (2, 3.0)], "k int, v double")
    got = {r["k"]: r["m"] for r in group_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_ranks_equal_window(spark):
    df = hot(spark)
    got = rank_in_group(df.repartition(7), ["k"], [F.desc("v"), F.asc("id")], "rn").toPandas()
    want = df.toPandas().sort_values(["k", "v", "id"], ascending=[True, False, True])
    want["rn"] = want.groupby("k").cumcount() + 1
    both = got.merge(want, on="id")
    assert len(both) == 5000 and (both.rn_x == both.rn_y).all()


def test_hot_group_is_spread_over_partitions(spark):
    exprs = [F.col("k"), F.col("id")]
    parts = hot(spark, 20000).repartitionByRange(8, *exprs).withColumn("p", F.spark_partition_id())
    assert parts.filter("k = 0").select("p").distinct().count() > 4


def test_stored_rows_are_fixed(spark):
    df = checkpointed(spark.range(100).withColumn("r", F.rand()))
    assert df.agg(F.sum("r")).first() == df.agg(F.sum("r")).first()


def test_caps_and_samples(spark):
    df = hot(spark).withColumn("label", F.when(F.col("id") % 3 == 0, "relevant").otherwise("irrelevant"))
    assert training.sample_n(df, 50).count() == 50
    assert training.sample_n(df, 50).exceptAll(training.sample_n(df, 50)).isEmpty()
    assert not training.sample_n(df, 50).exceptAll(training.sample_n(df, 50, seed=1)).isEmpty()
    for n in (20, 2000):
        sizes = {r["k"]: r["count"] for r in training.cap_per_group(df, ["k"], n).groupBy("k").count().collect()}
        full = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
        assert sizes == {k: min(n, c) for k, c in full.items()}
    counts = training.cap_per_class(df, "k", 30).groupBy("k", "label").count().collect()
    assert all(r["count"] == (10 if r["label"] == "relevant" else 30) for r in counts)
    assert training.stratified_topup(df, "k", 300).count() == 300


def test_sample_has_the_smallest_keys(spark):
    import hashlib

    df = hot(spark)
    key = lambda i: (hashlib.sha256(f"{i}:42".encode()).hexdigest(), i)
    want = set(sorted((r["id"] for r in df.select("id").collect()), key=key)[:700])
    assert {r["id"] for r in training.sample_n(df, 700).collect()} == want


def test_weighted_sample_excludes_gold_and_has_minimum(spark):
    pool = hot(spark).withColumn("company_name", F.concat(F.lit("c"), F.col("k").cast("string")))
    gold = pool.filter("id < 500").withColumn("label", F.lit("relevant"))
    out = training.weighted_sample(pool, gold, 200)
    ids = [r["id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) == 200 and min(ids) >= 500
    floor = out.groupBy("company_name").count().agg(F.min("count")).first()[0]
    assert floor >= max(2, 200 // 15)


def test_folds_partition_each_class_evenly(spark):
    df = hot(spark).withColumn("label", F.when(F.col("id") % 4 == 0, "relevant").otherwise("irrelevant"))
    sizes = training.assign_folds(df.select("id", "label"), 5).groupBy("label", "fold").count().collect()
    assert len(sizes) == 10 and sum(r["count"] for r in sizes) == 5000
    for name in ("relevant", "irrelevant"):
        part = [r["count"] for r in sizes if r["label"] == name]
        assert max(part) - min(part) <= 1


def test_firm_selection(spark):
    rows = [("A", y, 4000) for y in range(2015, 2026)] + [("B", y, 3000 if y < 2018 else 3001) for y in range(2015, 2026)]
    rows += [("C", y, 9000) for y in range(2015, 2022)]
    counts = spark.createDataFrame(rows, "symbol string, year int, article_count long")
    got = {r["symbol"]: (r["faults"], r["status"]) for r in matrices.select_firms(counts, list(range(2015, 2026))).collect()}
    assert got == {"A": (0, "KEPT"), "B": (3, "KEPT"), "C": (4, "BOOTED")}


def test_one_series_over_many_ranges(spark):
    """Lag and fill along a series equal pandas, with nulls that span whole ranges."""
    import pandas as pd

    from panelspark import scale

    values = [None, None] + [float(i) if i % 7 == 0 or i < 20 else None for i in range(300)]
    values[60:200] = [None] * 140
    rows = [(i, v, float(i)) for i, v in enumerate(values)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "t long, v double, w double").repartition(5, "t")
        got = scale.filled(df, ["v", "w"], [F.col("t")]).orderBy("t").toPandas()
        lag = scale.previous(df, F.col("w") * 2, [F.col("t")], "before").orderBy("t").toPandas()
        assert scale._in_ranges(df, [F.col("t")]).select("__part").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = pd.Series(values, dtype=float).ffill().bfill()
    assert (got["v"] == want).all() and list(got.columns) == ["t", "v", "w"]
    assert lag["before"].isna()[0] and list(lag["before"][1:]) == [2.0 * i for i in range(len(values) - 1)]
    assert scale.filled(df.limit(0), ["v"], [F.col("t")]).count() == 0

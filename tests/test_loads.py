"""Versioned loads, declared reads, and what a stream takes for an empty store."""

import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.sql import functions as F

from panelspark.sources import sinks, tables
from panelspark.streaming import incremental


def test_a_failed_load_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert sinks.current_table(spark, path) is None
    assert sinks.replace_table(spark.range(10), path) == 1
    breaks = spark.range(1000).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("stopped midway"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="stopped midway"):
        sinks.replace_table(breaks, path)
    assert sinks.table_versions(spark, path) == [1] and sinks.current_table(spark, path).count() == 10
    assert sinks.replace_table(spark.range(20), path) == 2 and sinks.replace_table(spark.range(30), path) == 3
    assert sinks.table_versions(spark, path) == [2, 3] and sinks.current_table(spark, path).count() == 30
    assert sinks.replace_table(spark.range(5), path, dry_run=True) == 4 and sinks.table_versions(spark, path) == [2, 3]


def test_rows_that_do_not_fit_the_schema(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ticker,date,close\nA,2020-01-01,1.5\nB,never,2.5\nC,2020-01-02,x\n")
    rows = tables.read_table(spark, "stock_prices", str(tmp_path / "p.csv"), "csv", corrupt="bad").orderBy("ticker").collect()
    assert [(r["ticker"], r["close"], r["bad"]) for r in rows] == [("A", 1.5, None), ("B", 2.5, "B,never,2.5"), ("C", None, "C,2020-01-02,x")]


def test_jdbc_options_reach_the_reader(spark):
    with pytest.raises(Exception, match="Driver|driver"):
        tables.read_table(spark, "articles", "public.articles", "jdbc", url="jdbc:nosuch:x", partitionColumn="id", lowerBound="1", upperBound="9", numPartitions="2").count()


def test_only_a_missing_store_is_empty(spark, tmp_path):
    df = spark.range(1)
    assert incremental._stored(df, f"{tmp_path}/none") is None
    (tmp_path / "void").mkdir()
    assert incremental._stored(df, f"{tmp_path}/void") is None
    with pytest.raises(IllegalArgumentException):
        incremental._stored(df, "nosuchscheme.table://[")

"""Every stage on what the one before it kept, against brute force, and the registered query as a whole."""

import brute
import pytest
from pyspark.sql import functions as F
from rows import SMALL, empty, odd  # noqa: F401

import __spark_entry__ as contract
import corpus_pipeline as pipe
from panelspark.llm import queries as Q
from panelspark.scale import checkpointed


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in pipe.STAGES:
        docs = checkpointed(stage(spark, docs, SMALL))
        out.append((name, docs))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, steps):
    first = spark.read.parquet(f"{SMALL}/documents.parquet")
    lang, near, leaks, private, packed = (df for _, df in steps)
    assert all(df.columns == first.columns for df in (lang, near, leaks, private))
    assert lang.count() >= 0.97 * first.count()
    kept = {d for d, row in brute.near(pairs(lang), 5, 80).items() if row[2]}
    assert {r["doc_id"] for r in near.collect()} == kept
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {d for d, row in brute.leaks(pairs(near), items).items() if not row[-1]}
    assert {r["doc_id"] for r in leaks.collect()} == clean
    assert {r["doc_id"] for r in private.collect()} == clean
    assert not any(brute.private(t) for _, t in pairs(private))
    assert {r["doc_id"] for r in packed.collect()} == clean


def test_odd_rows_pass_every_stage(spark, odd):
    docs = odd
    for name, stage in pipe.STAGES:
        docs = checkpointed(stage(spark, docs, SMALL))
        if name != pipe.STAGES[-1][0]:
            assert docs.columns == odd.columns
    assert docs.count() > 0


def test_empty_table_passes_every_stage(spark, empty):
    docs = empty
    for _, stage in pipe.STAGES:
        docs = checkpointed(stage(spark, docs, SMALL))
    assert docs.count() == 0


def test_registered(spark):
    names = contract.queries()
    assert set(Q.QUERIES) | {"pipeline"} <= set(names) and 4 <= len(pipe.STAGES) <= 5
    assert set(Q.SQL) <= set(contract.oracle_sql())
    assert names["pipeline"](spark, SMALL).agg(F.max("length")).first()[0] <= 2048

"""Caps per group and class: rows are worked out once, and the right ones are kept."""

import hashlib

from pyspark.sql import functions as F

from panelspark.operators import training


def test_capped_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def label(i):
        seen.add(1)
        return "relevant" if i % 2 else "irrelevant"

    rows = spark.range(60).select("id", label.asNondeterministic()("id").alias("label"), (F.col("id") % 3).alias("firm"), F.lit("text").alias("title"))
    got = training.cap_per_class(rows, "firm", 6).collect()
    assert seen.value == 60
    key = lambda i: hashlib.sha256(f"{i}:42".encode()).hexdigest()
    want = set()
    for firm in range(3):
        for odd, n in ((0, 6), (1, 2)):
            want |= set(sorted((i for i in range(60) if i % 3 == firm and i % 2 == odd), key=key)[:n])
    assert {r["id"] for r in got} == want and len(got) == len(want)


def test_cap_keeps_repeated_ids_as_rows(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "z"), (3, None, "u"), (None, "b", "v")], "id long, firm string, title string")
    got = sorted((r["firm"], r["title"]) for r in training.cap_per_group(rows, ["firm"], 3).collect())
    assert got == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "v")]

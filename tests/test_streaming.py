"""File-source streams run to completion give the batch results."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators import relevance
from panelspark.operators.filters import mentions_company
from panelspark.streaming import incremental as I


def drain(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def source(spark, df, path):
    df.repartition(4).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_drops_repeats_and_keeps_matches(spark, small, tmp_path):
    cols = ["id", "company_id", "title", "url", "published_at"]
    rows = small.articles.select(*cols)
    again = rows.withColumn("id", F.col("id") + 10**6)
    src = source(spark, rows.unionByName(again), str(tmp_path / "in"))
    sink = str(tmp_path / "out")
    drain(I.ingest_stream(src, small.companies, sink, str(tmp_path / "c1")))
    got = spark.read.parquet(sink)
    want = mentions_company(rows, small.companies, "normalised")
    assert got.count() == got.select("company_id", "article_hash").distinct().count() == want.count()
    # a second stream over the same stories adds nothing
    drain(I.ingest_stream(src, small.companies, sink, str(tmp_path / "c2")))
    assert spark.read.parquet(sink).count() == want.count()


def test_ingest_keeps_every_first_headline(spark, tmp_path):
    """Years arrive out of order over several batches; blank titles and URLs are left out."""
    schema = "id long, company_id long, title string, url string, published_at timestamp"
    day = lambda y: dt.datetime(y, 6, 1)
    batches = [
        [(1, 1, "Acme wins", "u1", day(2024)), (2, 1, "Acme wins", "u1", day(2025)), (3, 1, " ", "u2", day(2024))],
        [(4, 1, "Acme is founded", "u3", day(2015)), (5, 1, "Acme wins", "u1", day(2014)), (6, 1, "Acme grows", "", day(2016))],
        [(7, 1, "ACME  grows", "u4", day(2016)), (8, 1, None, "u5", day(2016)), (9, 1, "acme grows", "U4", day(2017))],
    ]
    companies = spark.createDataFrame([(1, "ACM", "Acme")], "id long, symbol string, name string")
    folder = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b={n}")
    sink = str(tmp_path / "out")
    for n in range(len(batches)):  # one query per backfill run, all into one store
        src = spark.readStream.schema(schema).parquet(f"{folder}/b={n}")
        drain(I.ingest_stream(src, companies, sink, str(tmp_path / f"c{n}")))
    assert {r["id"] for r in spark.read.parquet(sink).collect()} == {1, 4, 7}


def test_daily_index_stream_equals_batch(spark, small, tmp_path):
    rows = small.articles.select("id", "company_id", "published_at", "pos_score", "neg_score")
    late = rows.limit(1).withColumn("published_at", F.lit(dt.datetime(1999, 1, 1)))
    src = source(spark, rows.unionByName(late), str(tmp_path / "in"))
    out = str(tmp_path / "out")
    drain(I.index_stream(src, out, str(tmp_path / "c")))
    got = {(r[0], r[1]): (r[2], round(r[3], 9)) for r in I.daily_totals(spark.read.parquet(out)).collect()}
    day = F.to_date("published_at")
    batch = rows.unionByName(late).groupBy("company_id", day.alias("d")).agg(F.count("*"), F.avg(F.col("pos_score") - F.col("neg_score")))
    assert got == {(r[0], r[1]): (r[2], round(r[3], 9)) for r in batch.collect()}


def _score(df):
    return relevance.score_batches(df, lambda pdf: (pdf["id"] % 100) / 100)


def test_scoring_resumes(spark, small, tmp_path):
    rows = small.headlines
    sink = str(tmp_path / "out")
    half = source(spark, rows.filter("id % 2 = 0"), str(tmp_path / "half"))
    drain(I.score_stream(half, _score, sink, str(tmp_path / "c0")))
    src = source(spark, rows, str(tmp_path / "in"))
    drain(I.score_stream(src, _score, sink, str(tmp_path / "c")))
    got = spark.read.parquet(sink)
    assert got.count() == rows.count() == got.select("id").distinct().count()
    assert got.select("id", "adj_prob").exceptAll(relevance.classify(rows, score=_score).select("id", "adj_prob")).isEmpty()


def test_upsert_stream_keeps_last_write(spark, tmp_path):
    rows = spark.range(200).select(
        (F.col("id") % 40).cast("int").alias("k"), F.col("id").alias("seq"), (F.col("id") * 2).alias("v"), (F.col("id") % 40 % 3).cast("int").alias("part")
    )
    src = source(spark, rows, str(tmp_path / "in"))
    sink = str(tmp_path / "out")
    drain(I.upsert_stream(src, sink, str(tmp_path / "c"), ["k"], "seq", "part"))
    got = {r["k"]: r["v"] for r in spark.read.parquet(sink).collect()}
    assert got == {k: 2 * (160 + k) for k in range(40)}


def test_stream_queries_read_a_table_of_several_files(spark, tmp_path):
    """A table may be a folder of files as well as one file; either is read whole."""
    from panelspark.plans.catalog import QUERIES

    spark.createDataFrame([(1, 0, "ALGERIA")], "n_nationkey int, n_regionkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    docs = spark.range(1, 81).select((F.col("id") * 25 - 24).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("web").alias("source"))
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["ingest_stream"].spark(spark, str(tmp_path)).distinct().count() == 60  # every fourth title lacks the name
    assert sorted(r["id"] for r in QUERIES["score_stream"].spark(spark, str(tmp_path)).collect()) == [25 * i - 24 for i in range(1, 81)]


def test_score_stream_of_a_table_without_rows(spark, tmp_path):
    """Nothing to score is no error."""
    from panelspark.plans.catalog import QUERIES

    spark.createDataFrame([(1, 0, "ALGERIA")], "n_nationkey int, n_regionkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["score_stream"].spark(spark, str(tmp_path))
    assert out.columns == ["id"] and out.collect() == []
    rows = spark.createDataFrame([(26, "text", "web")], "doc_id long, text string, source string")
    rows.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["score_stream"].spark(spark, str(tmp_path))
    assert out.columns == ["id"] and [tuple(r) for r in out.collect()] == [(26,)]

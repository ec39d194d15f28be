"""Headline rules, text helpers and gap edge cases on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.functions import dates, text
from panelspark.operators import dedup, filters, gaps, matrices, relevance, training
from panelspark.sources import sinks, tables

RULE_CASES = [
    ("Student visa backlog grows", "Visa Inc.", 0.9, 0.05, "G19:visa_contamination"),
    ("Visa raises price of service", "Visa Inc.", 0.9, 0.05, "G19:visa_contamination"),
    ("Student visa backlog grows", "Apple", 0.9, 0.9, ""),
    ("What to watch in Tesla earnings", "Tesla", 0.9, 0.5, "G12:analyst_preview"),
    ("What to watch in Tesla earnings", "Tesla", 0.2, 0.05, "G12:analyst_preview"),
    ("Foundation gives away $5 bikes", "Nike", 0.9, 0.5, "G13:philanthropy"),
    ("Foundation gives $5 after lawsuit", "Nike", 0.9, 0.9, ""),
    ("BRIEF-Nike says so", "Nike", 0.9, 0.55, "G15:brief_wire"),
    ("Nike appoints head of marketing", "Nike", 0.9, 0.55, "G15:midlevel_appointment"),
    ("Nike head of marketing leaves", "Nike", 0.9, 0.9, ""),
    ("Flipkart is the Amazon of India", "Amazon", 0.9, 0.5, "G17:brand_comparator"),
    ("Google's answer to the iPhone", "Apple", 0.9, 0.55, "G17:brand_comparator"),
    ("Competition with Uber heats up", "Uber", 0.9, 0.5, "G20:disruption_catalyst"),
    ("Taxi firms struggle in Paris", "Uber", 0.9, 0.55, "G20:disruption_catalyst"),
    ("Boeing considers selling unit", "Boeing", 0.9, 0.65, "G11:speculative"),
    ("Boeing mulls sale, sources say", "Boeing", 0.9, 0.65, "G11:speculative"),
    ("Ohio a big winner in Intel plan", "Intel", 0.9, 0.55, "G16:local_economic"),
    ("Ohio lands new jobs", "Intel", 0.9, 0.65, "G16:local_economic"),
    ("Walmart hit by $12 million lawsuit", "Walmart", 0.9, 0.6, "G18:small_lawsuit"),
    ("Walmart faces $3m lawsuit", "Walmart", 0.9, 0.6, "G18:small_lawsuit"),
    ("Walmart reports results", "Walmart", 0.9, 0.9, ""),
    (None, None, 0.4, 0.4, ""),
]


def test_rules_fire_in_order(spark):
    rows = [(i, t, c, p) for i, (t, c, p, _, _) in enumerate(RULE_CASES)]
    df = spark.createDataFrame(rows, "id int, title string, company_name string, ensemble_prob double")
    got = {r["id"]: r for r in relevance.adjust_scores(df).collect()}
    for i, (title, _, _, p, rule) in enumerate(RULE_CASES):
        assert got[i]["rule_fired"] == rule, title
        assert got[i]["adj_prob"] == pytest.approx(p), title
    strict = {r["id"]: r["rule_fired"] for r in relevance.adjust_scores(df, strict=True).collect()}
    assert strict[0] == "G19:visa_contamination" and strict[1] == ""


def test_hard_filter_cases(spark):
    cases = [
        ("Score tonight", "ESPN.com", "Nike", True), ("Save $ 20 today", "x.com", "Nike", True),
        ("Goldman Sachs upgrades Nike", "x.com", "Goldman Sachs", True), ("Goldman Sachs upgrades Nike", "x.com", "Nike", False),
        ("Military intel leaked", "x.com", "Intel", True), ("Intel earns more", "x.com", "Intel", False),
        ("Work visa rules", "x.com", "Visa Inc.", False),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "title string, source string, company_name string")
    assert [r[0] for r in df.select(relevance.hard_filter()).collect()] == [c[3] for c in cases]


def test_scoring_runs_on_survivors_only(spark, small):
    seen = spark.sparkContext.accumulator(0)

    def fn(pdf):
        seen.add(len(pdf))
        return pdf["id"] * 0.0 + 0.9

    out = relevance.classify(small.headlines, score=lambda d: relevance.score_batches(d, fn)).cache()
    total, hard = out.count(), out.filter("ensemble_prob IS NULL").count()
    assert 0 < hard < total and seen.value == total - hard
    assert out.filter("ensemble_prob IS NULL AND predicted_label <> 'irrelevant'").isEmpty()


def test_text_helpers(spark):
    df = spark.createDataFrame([("Shares of Acme Corp. rose sharply", "ACME Corp."), ("Acme", "Acme"), ("Nothing here", "Zed Inc"), ("a zed b", "Zed Inc")], "t string, n string")
    got = [tuple(r["s"]) for r in df.select(text.split_target(F.col("t"), F.col("n")).alias("s")).collect()]
    assert got[0] == ("Shares of", "Acme Corp.", "rose sharply")
    assert got[1] == ("Acme", "Acme", "Acme")
    assert got[2] == ("Nothing here", "Zed Inc", "Nothing here")
    assert got[3] == ("a zed b", "zed", "a zed b")
    one = spark.range(1).select(
        text.first_paragraph(F.lit("short\n\n" + "x" * 90 + "\n\nmore")).alias("p"),
        text.first_paragraph(F.lit("  just this ")).alias("q"),
        text.domain(F.lit("https://www.News.com:8080/a?b")).alias("d"),
        text.domain(F.lit("no url")).alias("e"),
        text.clean_name(F.lit("Acme Corporation, Inc.")).alias("c"),
    ).first()
    assert (one["p"], one["q"], one["d"], one["e"], one["c"]) == ("x" * 90, "just this", "news.com:8080", None, "Acme")


def test_week_labels(spark):
    days = [(dt.date(2024, 1, d),) for d in (1, 2, 7, 8)]
    df = spark.createDataFrame(days, "d date").select(dates.week_monday(F.col("d")).alias("a"), dates.week_monday(F.col("d"), "w_mon").alias("b"))
    got = [(r["a"].day, r["b"].day) for r in df.collect()]
    assert got == [(1, 1), (1, 8), (1, 8), (8, 8)]


def test_gap_edges(spark):
    start = dt.date(2015, 1, 5)
    have = [2, 3, 9, 10, 11]  # weeks 0-1 missing (A), 4-8 missing (B), 12-14 missing (B, trailing)
    weekly = spark.createDataFrame([("x", start + dt.timedelta(weeks=w), float(w), 1, 1) for w in have], "company_id string, week_monday date, simple_mean_stance double, n_articles long, n_days_covered long")
    grid = gaps.weekly_grid(weekly, "2015-01-01", str(start + dt.timedelta(weeks=14)))
    found = gaps.find_gaps(grid)
    assert sorted((r["gap_weeks"], r["gap_type"]) for r in found.collect()) == [(2, "A"), (3, "B"), (5, "B")]
    out, log = gaps.impute(grid, found)
    values = [r["simple_mean_stance"] for r in out.orderBy("week_monday").collect()]
    assert values == [None, None, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 11.0, 11.0, 11.0]
    assert log.count() == 10 and log.filter("imputed_value IS NULL").count() == 2


def test_ties_count_in_every_class_but_label_prefers_positive(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4)], "pos_score double, neg_score double, neutral_score double")
    row = matrices.stance_summary(df, []).first()
    assert (row["positive"], row["negative"], row["neutral"]) == (1, 2, 1)
    assert [r["stance"] for r in matrices.max_stance(df).collect()] == ["positive", "negative"]


def test_word_boundary_mode(spark):
    a = spark.createDataFrame([(1, 1, "Total wins", "2020-01-01"), (2, 1, "T wins", "2020-01-01")], "id long, company_id long, title string, d string").withColumn("published_at", F.to_timestamp("d"))
    c = spark.createDataFrame([(1, "T", "AT&T")], "id long, symbol string, name string")
    assert filters.mentions_company(a, c).count() == 2
    assert [r["id"] for r in filters.mentions_company(a, c, word_boundary=True).collect()] == [2]


def test_hash_dedup_and_sources(spark):
    rows = spark.createDataFrame([(1, 1, " A  b ", "u"), (2, 1, "a B", "U"), (3, 1, "c", "u")], "id long, company_id long, title string, url string")
    hashed = dedup.with_hash(rows)
    assert sorted(r["id"] for r in dedup.dedup_hash(hashed, hashed.limit(0)).collect()) == [1, 3]
    raw = spark.createDataFrame([("2020-01-02", "10", "x"), ("bad", "11", "2"), ("2020-01-03", None, "1")], "`Trade Date` string, Close string, `Adj_Close` string")
    out = tables.canonical_ohlcv(raw).collect()
    assert len(out) == 1 and out[0]["adj_close"] == 10.0 and out[0]["volume"] is None


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "t")
    assert sinks.write_table(df, path, dry_run=True) == 5
    sinks.write_table(df, path)
    sinks.write_table(df, path, "append")
    assert spark.read.parquet(path).count() == 10
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, 5, "b"), (1, 7, "c"), (2, 1, "d")], "k int, seq int, v string")
    out = sinks.upsert_latest(base, new, ["k"], "seq", F.lit("now")).collect()
    assert sorted((r["k"], r["v"], r["updated_at"]) for r in out) == [(1, "c", "now"), (2, "d", "now")]


def test_training_set_rules(spark):
    gold = spark.createDataFrame([("1", "t1", "Relevant ", "acme")], "id string, title string, label string, company_name string")
    rows = [("1", "x", "relevant", "acme", ""), ("2", "y", "relevant", "acme", "unclear"), ("3", "z 20% off", "relevant", "acme", ""), ("4", "w", "relevant", None, "")]
    rows += [(str(10 + i), f"n{i}", "irrelevant", "acme", "") for i in range(9)]
    annotated = spark.createDataFrame(rows, "id string, title string, label string, company_name string, reason string")
    out = {r["id"]: r for r in training.training_set(gold, annotated, 6).collect()}
    assert out["1"]["source"] == "gold_manual" and out["1"]["title"] == "t1"
    assert "2" not in out and "4" not in out
    assert sum(r["label"] == "irrelevant" for r in out.values()) == 6


def test_verdict_parsing(spark):
    bad = '[{"id": 7, "title": "say "x"", "verdict": "confirm"},'
    df = spark.createDataFrame([('ok [{"id": "1", "verdict": "REJECT"}, {"id": 2, "verdict": "CONFIRM"}]',), (bad + "]",), ("none",)], "response string")
    got = {(r["id"], r["verdict"]) for r in training.parse_verdicts(df).collect()}
    assert got == {("1", "REJECT"), ("2", "CONFIRM"), ("7", "CONFIRM")}


def test_first_of_two_columns_with_one_name_counts(spark):
    from panelspark.sources.tables import canonical_ohlcv

    df = spark.createDataFrame([("2020-01-02", 1.0, 9.0, 5)], "Date string, a double, b double, Volume int").toDF("Date", "Close", "close", "Volume")
    assert [(r["close"], r["volume"]) for r in canonical_ohlcv(df).collect()] == [(1.0, 5)]

"""Coverage inventories and the daily and weekly stance index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.dates import calendar, first_on_or_after, week_monday
from ..scale import group_quantiles
from ..session import ANALYSIS_END, ANALYSIS_START, SPARSE_PCT
from .filters import in_window, stance, top_score


def _weekday_share(days: Column) -> Column:
    """Approximate trading days in a span of calendar days."""
    return F.bround(days * 5 / 7).cast("long")


def panel_structure(
    articles: DataFrame, start: str = ANALYSIS_START, end: str = ANALYSIS_END, kept: Column | None = None
) -> DataFrame:
    """Per-firm article counts before and after a filter, dates, covered days and the sparse flag."""
    kept = F.lit(True) if kept is None else kept
    df = in_window(articles, "published_at", start, end, "company_id").withColumn("_d", F.to_date("published_at"))
    base = df.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total_before_filter"),
        F.count_if(kept).alias("total_after_filter"),
        F.min(F.when(kept, F.col("_d"))).alias("first_article_date"),
        F.max(F.when(kept, F.col("_d"))).alias("last_article_date"),
        F.countDistinct(F.when(kept, F.col("_d"))).alias("days_with_articles"),
    )
    window_days = (F.datediff("last_article_date", "first_article_date") + 1).cast("long")
    out = base.withColumn("window_calendar_days", window_days).withColumn(
        "approx_trading_days", _weekday_share(F.col("window_calendar_days"))
    )
    covered = F.try_divide(F.col("days_with_articles") * 100, F.col("approx_trading_days"))
    return (
        out.withColumn("days_zero_articles", F.greatest(F.col("approx_trading_days") - F.col("days_with_articles"), F.lit(0)))
        .withColumn("pct_trading_days_covered", covered)
        .withColumn("flag_sparse", F.col("pct_trading_days_covered") < SPARSE_PCT)
    )


def stock_inventory(prices: DataFrame, start: str, end: str) -> DataFrame:
    base = (
        prices.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy("ticker")
        .agg(F.min("date").alias("stock_start"), F.max("date").alias("stock_end"), F.count(F.lit(1)).alias("trading_day_rows"))
    )
    days = (F.datediff("stock_end", "stock_start") + 1).cast("long")
    out = base.withColumn("window_calendar_days", days).withColumn(
        "approx_trading_days", _weekday_share(F.col("window_calendar_days"))
    )
    gap = (1 - F.try_divide(F.col("trading_day_rows"), F.col("approx_trading_days"))) * 100
    return out.withColumn("gap_rate_pct", F.greatest(gap, F.lit(0.0)))


def articles_per_day(articles: DataFrame, start: str, end: str) -> DataFrame:
    df = in_window(articles, "published_at", start, end, "company_id")
    return df.groupBy("company_id", F.to_date("published_at").alias("article_date")).agg(
        F.count(F.lit(1)).alias("articles_on_day")
    )


def calendar_grid(entities: DataFrame, start: str, end: str, step: str = "week", week_mode: str = "monday") -> DataFrame:
    """One row per entity and calendar step. Weekly grids start on the first Monday on or after ``start``."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    name = "article_date"
    if step == "week":
        name = "week_monday"
        first = F.to_date(F.date_trunc("week", first)) if week_mode == "stub" else first_on_or_after(first, "Mon")
    return entities.withColumn(name, F.explode(calendar(first, last, step)))


def frequency_distribution(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Distribution of articles per day over the whole calendar, days without articles counting as zero."""
    grid = calendar_grid(daily.select("company_id").distinct(), start, end, "day")
    full = grid.join(daily, ["company_id", "article_date"], "left").select(
        "company_id", "article_date", F.coalesce("articles_on_day", F.lit(0)).alias("n")
    )
    # a firm has one row per calendar day, which bounds the exact percentile buffers below
    days = full.groupBy("company_id").agg(
        F.avg("n").alias("avg_articles_per_day"),
        F.percentile("n", F.lit(0.5)).alias("median_articles_per_day_all"),
        F.coalesce(F.percentile(F.when(F.col("n") > 0, F.col("n")), F.lit(0.5)), F.lit(0.0)).alias(
            "median_articles_per_day_nonzero"
        ),
        F.percentile("n", F.lit(0.25)).alias("p25_articles_per_day"),
        F.percentile("n", F.lit(0.75)).alias("p75_articles_per_day"),
        F.max("n").alias("max_articles_per_day"),
        F.count_if(F.col("n") == 0).alias("days_with_zero_articles"),
        (F.count_if(F.col("n") == 0) * 100 / F.count(F.lit(1))).alias("pct_zero_days"),
    )

    def mean_of_sums(key: Column, name: str) -> DataFrame:
        sums = full.groupBy("company_id", key.alias("_k")).agg(F.sum("n").alias("_s"))
        return sums.groupBy("company_id").agg(F.avg("_s").alias(name))

    weeks = mean_of_sums(week_monday(F.col("article_date")), "avg_articles_per_week")
    months = mean_of_sums(F.trunc("article_date", "month"), "avg_articles_per_month")
    return days.join(weeks, "company_id").join(months, "company_id")


def recommend_frequency(freq: DataFrame) -> DataFrame:
    """Weekly below a cross-firm median of 3 articles a day, else daily."""
    m = F.col("median_articles_per_day")
    return group_quantiles(freq, [], "median_articles_per_day_all", {"median_articles_per_day": 0.5}).withColumn(
        "recommendation",
        F.when(m < 1, "weekly").when(m < 3, "weekly").otherwise("daily"),
    )


def stance_scores(articles: DataFrame, start: str, end: str, tau: float = 0.0) -> DataFrame:
    """Scored articles in the window with stance and day."""
    df = in_window(articles, "published_at", start, end, "company_id")
    df = df.filter(F.col("pos_score").isNotNull() & F.col("neg_score").isNotNull())
    if tau > 0:
        df = df.filter(top_score() >= tau)
    return df.withColumn("stance_score", stance()).withColumn("article_date", F.to_date("published_at"))


def stance_distribution(scores: DataFrame, by: str = "company_id") -> DataFrame:
    s = F.col("stance_score")
    base = scores.groupBy(by).agg(
        F.count(s).alias("n_articles"),
        F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("std"),
        F.skewness(s).alias("skewness"),
        F.kurtosis(s).alias("kurtosis"),
        F.min(s).alias("min"),
        F.max(s).alias("max"),
        (F.count_if(F.abs(s) <= 0.05) * 100 / F.count(s)).alias("pct_near_zero"),
        (F.count_if(s == 0) * 100 / F.count(s)).alias("pct_exactly_zero"),
    )
    return base.join(group_quantiles(scores, [by], "stance_score", {"p25": 0.25, "median": 0.5, "p75": 0.75}), by)


def daily_index(scores: DataFrame, keys: tuple = ("company_id",)) -> DataFrame:
    """Count, mean and median stance per firm-day."""
    out = group_quantiles(
        scores, [*keys, "article_date"], "stance_score", {"median_stance": 0.5}, "n_articles", "mean_stance"
    )
    return out.withColumn("weighted_mean_stance", F.col("mean_stance"))


def daily_quality(daily: DataFrame, by: str = "company_id") -> DataFrame:
    """Per-firm diagnostics of the daily index. A firm has one row per day, which bounds the window."""
    prev = F.lag("mean_stance").over(W.partitionBy(by).orderBy("article_date"))
    d = daily.withColumn("_swing", F.abs(F.col("mean_stance") - prev))
    single = F.count_if(F.col("n_articles") == 1)
    return d.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_days"),
        single.alias("days_single_article"),
        (single * 100 / F.count(F.lit(1))).alias("pct_single_article"),
        F.count_if((F.col("mean_stance") < -1) | (F.col("mean_stance") > 1)).alias("out_of_range_days"),
        F.count_if(F.col("_swing") > 1.0).alias("big_swing_days"),
        F.avg("n_articles").alias("mean_daily_articles"),
        F.percentile("n_articles", F.lit(0.5)).cast("long").alias("median_daily_articles"),
    )


def weekly_index(daily: DataFrame, keys: tuple = ("company_id",)) -> DataFrame:
    """Firm-weeks (at most seven firm-days each): count-weighted, simple and median means."""
    week = week_monday(F.col("article_date"))
    return daily.groupBy(*keys, week.alias("week_monday")).agg(
        (F.sum(F.col("mean_stance") * F.col("n_articles")) / F.sum("n_articles")).alias("weighted_mean_stance"),
        F.avg("mean_stance").alias("simple_mean_stance"),
        F.percentile("median_stance", F.lit(0.5)).alias("median_stance"),
        F.sum("n_articles").alias("n_articles"),
        F.count(F.lit(1)).alias("n_days_covered"),
        F.min("article_date").alias("week_start"),
        F.max("article_date").alias("week_end"),
    )


def weekly_coverage(weekly: DataFrame, start: str, end: str, by: str = "company_id", end_day: str = "Sun") -> DataFrame:
    """Covered against possible weeks; the possible weeks are those whose ``end_day`` lies in the window."""
    first = first_on_or_after(F.lit(start).cast("date"), end_day)
    total = (F.floor(F.datediff(F.lit(end).cast("date"), first) / 7) + 1).cast("long")
    pct = F.count(F.lit(1)) * 100 / total
    return weekly.groupBy(by).agg(
        F.lit(total).alias("total_weeks_window"),
        F.count(F.lit(1)).alias("weeks_with_data"),
        (total - F.count(F.lit(1))).alias("weeks_empty"),
        pct.alias("pct_covered"),
        F.avg("n_articles").alias("mean_articles_per_week"),
        F.percentile("n_articles", F.lit(0.5)).cast("long").alias("median_articles_per_week"),
    )


def coverage_note(coverage: DataFrame) -> DataFrame:
    """Verdict on the median coverage across firms."""
    m = F.col("median_coverage")
    return group_quantiles(coverage, [], "pct_covered", {"median_coverage": 0.5}).withColumn(
        "note", F.when(m > 90, "excellent").when(m > 70, "good").otherwise("sparse")
    )

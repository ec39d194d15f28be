"""Firm-by-year matrices, firm selection, count distributions and ingest statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import group_quantiles, rank_in_group
from ..session import HIGH_CONFIDENCE
from .filters import stance, top_score


def firm_year_counts(articles: DataFrame, firm: str = "symbol") -> DataFrame:
    return articles.groupBy(firm, F.year("published_at").alias("year")).agg(F.count(F.lit(1)).alias("article_count"))


def firm_year_matrix(counts: DataFrame, years: list[int], firm: str = "symbol", top: int | None = None) -> DataFrame:
    """One column per year, a total per firm, and a grand-total row labelled Total."""
    cell = lambda y: F.sum(F.when(F.col("year") == y, F.col("article_count")).otherwise(0)).alias(f"y{y}")
    cells = [cell(y) for y in years] + [F.sum("article_count").alias("total")]
    if top is not None:
        rows = top_k(counts.groupBy(firm).agg(*cells), "total", top, firm)
        sums = rows.agg(*[F.sum(c).alias(c) for c in rows.columns if c != firm])
        return rows.unionByName(sums.withColumn(firm, F.lit("Total")))
    rolled = counts.rollup(firm).agg(F.grouping(firm).alias("_g"), *cells)
    return rolled.withColumn(firm, F.when(F.col("_g") == 1, "Total").otherwise(F.col(firm))).drop("_g")


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def select_firms(counts: DataFrame, years: list[int], firm: str = "symbol", min_n: int = 3000, max_faults: int = 3) -> DataFrame:
    """Faults = years with at most ``min_n`` articles, years without any included."""
    good = F.count_if(F.col("year").isin(*years) & (F.col("article_count") > min_n))
    return counts.groupBy(firm).agg((F.lit(len(years)) - good).alias("faults")).withColumn(
        "status", F.when(F.col("faults") <= max_faults, "KEPT").otherwise("BOOTED")
    )


def company_counts(articles: DataFrame, firm: str = "company_id") -> DataFrame:
    return articles.filter(F.col(firm).isNotNull()).groupBy(firm).agg(F.count(F.lit(1)).alias("article_count"))


def count_cdf(counts: DataFrame, firm: str = "company_id") -> DataFrame:
    """Firms ordered by count with their cumulative position."""
    return rank_in_group(counts, [], [F.col("article_count"), F.col(firm)], "cumulative_firms")


def count_distribution(counts: DataFrame) -> DataFrame:
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    # the quantiles' one row is a scalar, which needs no join
    q = group_quantiles(counts, [], "article_count", probs).select(F.struct(*probs)).scalar()
    n = F.col("article_count")
    base = counts.agg(
        F.count(F.lit(1)).alias("n_firms"),
        F.sum(n).alias("total_articles"),
        F.avg(n).alias("mean"),
        F.stddev_pop(n).alias("std"),
        F.min(n).alias("min"),
        F.max(n).alias("max"),
        F.count_if(n == 0).alias("zero_count"),
    )
    return base.withColumn("_q", q).select("*", *[F.col(f"_q.{p}").alias(p) for p in probs]).drop("_q")


def table_totals(before: DataFrame, after: DataFrame, firm: str = "company_id") -> DataFrame:
    """Rows and firms of two tables in one row."""
    both = before.select(firm, F.lit(0).alias("_t")).unionByName(after.select(firm, F.lit(1).alias("_t")))
    per_firm = both.groupBy("_t", firm).agg(F.count(F.lit(1)).alias("_n"))
    at = lambda t, c: F.coalesce(F.sum(F.when(F.col("_t") == t, c)), F.lit(0))
    firms = F.when(F.col(firm).isNotNull(), 1).otherwise(0)
    return per_firm.agg(
        at(0, F.col("_n")).alias("rows_before"),
        at(0, firms).alias("firms_before"),
        at(1, F.col("_n")).alias("rows_after"),
        at(1, firms).alias("firms_after"),
    )


def cell_stats(candidates: DataFrame, firm: str = "company_id") -> DataFrame:
    """Ingest counts per firm and year with roll-ups.

    Each row carries the flags ``is_existing``, ``title_ok`` and ``is_duplicate``.
    """
    new = ~F.col("is_existing")
    aggs = [
        F.count(F.lit(1)).alias("fetched"),
        F.count_if("is_existing").alias("existing"),
        F.count_if(new & ~F.col("title_ok")).alias("filtered_title"),
        F.count_if(new & F.col("title_ok") & F.col("is_duplicate")).alias("filtered_duplicates"),
        F.count_if(new & F.col("title_ok") & ~F.col("is_duplicate")).alias("inserted"),
        F.grouping_id().alias("level"),
    ]
    return candidates.rollup(firm, "year").agg(*aggs)


def stance_label() -> Column:
    """Largest of the three scores; ties go positive, then negative, then neutral."""
    pos, neg, neu = F.col("pos_score"), F.col("neg_score"), F.col("neutral_score")
    return (
        F.when((pos >= neu) & (pos >= neg), "positive")
        .when((neg >= pos) & (neg >= neu), "negative")
        .otherwise("neutral")
    )


def max_stance(df: DataFrame, tau: float = HIGH_CONFIDENCE) -> DataFrame:
    return df.withColumns(
        {"max_confidence": top_score(), "stance": stance_label(), "high_confidence": top_score() >= tau}
    )


def stance_summary(df: DataFrame, by: list[str], tau: float = HIGH_CONFIDENCE) -> DataFrame:
    """Counts by class (a tie counts in each class it ties for), high-confidence count and average scores."""
    pos, neg, neu = F.col("pos_score"), F.col("neg_score"), F.col("neutral_score")
    return df.filter(pos.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count_if(top_score() >= tau).alias("high_confidence"),
        F.count_if((pos >= neu) & (pos >= neg)).alias("positive"),
        F.count_if((neg >= pos) & (neg >= neu)).alias("negative"),
        F.count_if((neu >= pos) & (neu >= neg)).alias("neutral"),
        F.avg(pos).alias("avg_pos_score"),
        F.avg(neg).alias("avg_neg_score"),
        F.avg(neu).alias("avg_neutral_score"),
    )


def stance_pivot(df: DataFrame, firm: str, tau: float = HIGH_CONFIDENCE) -> DataFrame:
    high = df.filter(F.col("pos_score").isNotNull() & (top_score() >= tau)).withColumn("stance", stance_label())
    wide = high.groupBy(firm).pivot("stance", ["negative", "neutral", "positive"]).count().fillna(0)
    return wide.withColumn("total", F.col("negative") + F.col("neutral") + F.col("positive"))


def export_rows(df: DataFrame, tau: float = HIGH_CONFIDENCE) -> DataFrame:
    """Scored rows with probabilities rounded to six places for hand-over."""
    six = lambda c: F.bround(F.col(c), 6)
    return max_stance(df.filter(F.col("pos_score").isNotNull()), tau).select(
        F.col("id").alias("original_id"),
        "company_id",
        F.date_format("published_at", "yyyy-MM-dd").alias("published_at"),
        six("pos_score").alias("prob_positive"),
        six("neg_score").alias("prob_negative"),
        six("neutral_score").alias("prob_neutral"),
        six("max_confidence").alias("max_confidence"),
        "stance",
        "high_confidence",
    )

"""Weekly grid, runs of missing weeks, coverage rules and imputation.

Windows are per firm over its weekly grid, so they hold at most one row per calendar week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import GAP_BOUNDS, MAX_GAP_WEEKS, MIN_COVERAGE_PCT
from .index import calendar_grid


def weekly_grid(
    weekly: DataFrame, start: str, end: str, by: str = "company_id", value: str = "simple_mean_stance", week_mode: str = "monday"
) -> DataFrame:
    grid = calendar_grid(weekly.select(by).distinct(), start, end, "week", week_mode)
    obs = weekly.select(by, "week_monday", value, "n_articles", "n_days_covered")
    return grid.join(obs, [by, "week_monday"], "left").withColumn("has_data", F.col(value).isNotNull())


def gap_type(weeks: Column, bounds: tuple = GAP_BOUNDS) -> Column:
    return F.when(weeks <= bounds[0], "A").when(weeks <= bounds[1], "B").otherwise("C")


def find_gaps(grid: DataFrame, by: str = "company_id", bounds: tuple = GAP_BOUNDS) -> DataFrame:
    """Runs of missing weeks: week number minus position among missing weeks is constant inside a run."""
    weeks = F.datediff("week_monday", F.lit("1970-01-05").cast("date")) / 7
    run = weeks.cast("long") - F.row_number().over(W.partitionBy(by).orderBy("week_monday"))
    missing = grid.filter(~F.col("has_data")).withColumn("_run", run)
    gaps = missing.groupBy(by, "_run").agg(
        F.min("week_monday").alias("gap_start"), F.max("week_monday").alias("gap_end"), F.count(F.lit(1)).alias("gap_weeks")
    )
    return gaps.withColumn("gap_type", gap_type(F.col("gap_weeks"), bounds)).drop("_run")


def gap_summary(grid: DataFrame, gaps: DataFrame, by: str = "company_id") -> DataFrame:
    weeks = grid.groupBy(by).agg(F.count(F.lit(1)).alias("total_weeks"), F.count_if("has_data").alias("weeks_with_data"))
    counts = gaps.groupBy(by).agg(
        F.sum("gap_weeks").alias("weeks_missing"),
        *[F.count_if(F.col("gap_type") == t).alias(f"gaps_type_{t.lower()}") for t in "ABC"],
        F.max("gap_weeks").alias("longest_gap"),
    )
    zero = ["weeks_missing", "gaps_type_a", "gaps_type_b", "gaps_type_c", "longest_gap"]
    return weeks.join(counts, by, "left").fillna(0, zero).withColumn(
        "pct_covered", F.bround(F.col("weeks_with_data") * 100 / F.col("total_weeks"), 1)
    )


def coverage_threshold(
    summary: DataFrame, min_pct: float = MIN_COVERAGE_PCT, max_gap: int = MAX_GAP_WEEKS
) -> DataFrame:
    low, long = F.col("pct_covered") < min_pct, F.col("longest_gap") > max_gap
    why = F.concat_ws(
        "; ",
        F.when(low, F.concat(F.lit("Coverage "), F.format_string("%.1f", F.col("pct_covered")), F.lit(f"% < {min_pct}%"))),
        F.when(long, F.concat(F.lit("Longest gap "), F.col("longest_gap").cast("string"), F.lit(f" weeks > {max_gap}"))),
    )
    return summary.withColumn("passes", ~(low | long)).withColumn("reason", F.when(why == "", "OK").otherwise(why))


def impute(
    grid: DataFrame, gaps: DataFrame, by: str = "company_id", value: str = "simple_mean_stance"
) -> tuple[DataFrame, DataFrame]:
    """Fill short gaps forward (A) and medium gaps linearly (B); long gaps (C) stay null.

    A leading gap has nothing to fill from and stays null; a trailing B gap carries the last value. Both are logged.
    """
    past = W.partitionBy(by).orderBy("week_monday").rowsBetween(W.unboundedPreceding, 0)
    # looking ahead as a running frame over the reversed order stays linear in the rows
    future = W.partitionBy(by).orderBy(F.desc("week_monday")).rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.col("week_monday"))
    df = grid.withColumns(
        {
            "_pv": F.last(value, ignorenulls=True).over(past),
            "_pw": F.last(known, ignorenulls=True).over(past),
            "_nv": F.last(value, ignorenulls=True).over(future),
            "_nw": F.last(known, ignorenulls=True).over(future),
        }
    )
    # expanding each gap to its weeks turns the interval test into an equality join
    typed = gaps.select(by, "gap_type", F.explode(F.sequence("gap_start", "gap_end", F.expr("INTERVAL 7 DAYS"))).alias("week_monday"))
    df = df.join(typed, [by, "week_monday"], "left")
    share = F.datediff("week_monday", "_pw") / F.datediff("_nw", "_pw")
    linear = F.coalesce(F.col("_pv") + (F.col("_nv") - F.col("_pv")) * share, F.col("_pv"))
    filled = F.when(F.col("gap_type") == "A", F.col("_pv")).when(F.col("gap_type") == "B", linear)
    is_imputed = F.coalesce(F.col("gap_type").isin("A", "B"), F.lit(False))
    out = (
        df.withColumn("is_imputed", is_imputed)
        .withColumn(value, F.coalesce(F.col(value), filled))
        .withColumn("n_articles", F.when(is_imputed, F.lit(0)).otherwise(F.col("n_articles")))
    )
    log = out.filter("is_imputed").select(
        by,
        "week_monday",
        "gap_type",
        F.when(F.col("gap_type") == "A", "forward_fill").otherwise("linear_interpolation").alias("method"),
        F.col(value).alias("imputed_value"),
    )
    return out.drop("_pv", "_pw", "_nv", "_nw", "gap_type"), log


def observed_only(imputed: DataFrame) -> DataFrame:
    return imputed.filter(~F.col("is_imputed"))

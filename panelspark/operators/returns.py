"""Returns, weekly aggregation, control series and alignment with the index.

Price tables hold one row per ticker and day, so windows per ticker are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.dates import week_monday
from ..scale import filled, previous
from ..session import MIN_ALIGNED_WEEKS
from .filters import post_flag


def _before(df: DataFrame, value: Column, key: str | None, date: str, name: str) -> DataFrame:
    """Add the value of the day before: per ticker by a window, which the calendar bounds, or along one series in ranges."""
    if key is None:
        return previous(df, value, [F.col(date)], name)
    return df.withColumn(name, F.lag(value).over(W.partitionBy(key).orderBy(date)))


def log_returns(prices: DataFrame, key: str | None = "ticker", date: str = "date") -> DataFrame:
    """ln P_t - ln P_(t-1); the first row of a series is dropped."""
    rows = _before(prices, F.log("close"), key, date, "_before")
    return rows.withColumn("log_return", F.log("close") - F.col("_before")).drop("_before").filter(F.col("log_return").isNotNull())


def simple_returns(prices: DataFrame, key: str | None = "ticker", date: str = "date", name: str = "daily_return") -> DataFrame:
    rows = _before(prices, F.col("close"), key, date, "_before")
    return rows.withColumn(name, F.col("close") / F.col("_before") - 1).drop("_before").filter(F.col(name).isNotNull())


def fill_controls(df: DataFrame, cols: list[str], date: str = "date", key: str | None = None) -> DataFrame:
    """Carry each column forward, then back, along one series of dates, or along the series of each key."""
    if key is None:
        return filled(df, cols, [F.col(date)])
    ahead = W.partitionBy(key).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(key).orderBy(F.desc(date)).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(ahead), F.last(c, ignorenulls=True).over(back)) for c in cols}
    )


def weekly_returns(daily: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """Sum of log returns, days, first and last close per week, short and extreme flags."""
    out = daily.groupBy(key, week_monday(F.col(date)).alias("week_monday")).agg(
        F.sum("log_return").alias("weekly_log_return"),
        F.count(F.lit(1)).alias("n_trading_days"),
        F.min_by("close", date).alias("week_open"),
        F.max_by("close", date).alias("week_close"),
    )
    return out.withColumn("flag_short_week", F.col("n_trading_days") < 4).withColumn(
        "flag_extreme", F.abs("weekly_log_return") > 0.15
    )


def returns_quality(weekly: DataFrame, key: str = "ticker") -> DataFrame:
    r = F.col("weekly_log_return")
    return weekly.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.min("week_monday").alias("first_week"),
        F.max("week_monday").alias("last_week"),
        F.avg(r).alias("mean_return"),
        F.stddev_samp(r).alias("std_return"),
        F.min(r).alias("min_return"),
        F.max(r).alias("max_return"),
        F.count_if("flag_extreme").alias("n_extreme"),
        F.count_if("flag_short_week").alias("n_short_weeks"),
        (F.count_if(F.abs(r) < 1e-8) * 100 / F.count(F.lit(1))).alias("pct_zero_return"),
    )


def align(index: DataFrame, returns: DataFrame, keys: tuple = ("ticker", "week_monday")) -> DataFrame:
    """Full outer join with a ``side`` column: both, left_only or right_only."""
    left, right = index.withColumn("_l", F.lit(1)), returns.withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return left.join(right, list(keys), "full").withColumn("side", side).drop("_l", "_r")


def alignment(aligned: DataFrame, key: str = "ticker", minimum: int = MIN_ALIGNED_WEEKS) -> DataFrame:
    n = lambda *sides: F.count_if(F.col("side").isin(*sides))
    return aligned.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_weeks_union"),
        n("both", "left_only").alias("weeks_with_bias"),
        n("both", "right_only").alias("weeks_with_returns"),
        n("both").alias("weeks_both"),
        n("left_only").alias("weeks_bias_only"),
        n("right_only").alias("weeks_returns_only"),
        (n("both") >= minimum).alias("sufficient"),
    )


def weekly_market(market: DataFrame, vix: DataFrame, week_mode: str = "monday") -> DataFrame:
    """Weekly market return (sum of log returns) and last VIX level; ``w_mon`` labels weeks by the Monday ending them."""
    ret = log_returns(market, None).groupBy(week_monday(F.col("date"), week_mode).alias("week_monday")).agg(
        F.sum("log_return").alias("market_return")
    )
    level = vix.groupBy(week_monday(F.col("trade_date"), week_mode).alias("week_monday")).agg(
        F.max_by("close", "trade_date").alias("vix")
    )
    return ret.join(level, "week_monday", "full")


def priced_companies(companies: DataFrame, prices: DataFrame, symbol: str = "symbol", ticker: str = "ticker") -> DataFrame:
    """Companies with the prices of their symbol, a row per price; companies without a symbol or a price are left out."""
    return companies.join(prices, companies[symbol] == prices[ticker]).drop(prices[ticker])


def return_panel(
    universe: DataFrame, returns: DataFrame, market: DataFrame, vix: DataFrame, cutoff: str, key: str = "ticker"
) -> DataFrame:
    """Firm-day returns with market and VIX; controls are filled on the date series before the join."""
    dates = returns.select("date").distinct()
    controls = fill_controls(dates.join(market, "date", "left").join(vix, "date", "left"), ["sp500_return", "vix"])
    out = universe.join(returns, key).join(controls, "date", "left").withColumn("post", post_flag("date", cutoff))
    return out.dropna(subset=["daily_return", "sp500_return", "vix"])

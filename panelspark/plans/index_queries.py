"""Coverage, daily and weekly index, gaps, returns and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import week_monday
from ..operators import filters, gaps, index, matrices, returns
from ..views import Tables
from .registry import query

# window and cut-off of the order- and price-based views
START, END, CUT = "1995-01-01", "2001-12-31", "1998-01-01"

IN_WINDOW = f"published_at >= TIMESTAMP '{START}' AND published_at < TIMESTAMP '2002-01-01'"

SCORES = f"""scores AS (SELECT company_id, CAST(published_at AS DATE) AS article_date, pos_score - neg_score AS stance_score
  FROM {{scored_events}} WHERE {IN_WINDOW})"""
DAILY = f"""{SCORES}, daily AS (SELECT company_id, article_date, count(*) AS n_articles, avg(stance_score) AS mean_stance,
  median(stance_score) AS median_stance FROM scores GROUP BY company_id, article_date)"""
WEEKLY = f"""{DAILY}, weekly AS (SELECT company_id, CAST(date_trunc('week', article_date) AS DATE) AS week_monday,
  sum(mean_stance * n_articles) / sum(n_articles) AS weighted_mean_stance, avg(mean_stance) AS simple_mean_stance,
  median(median_stance) AS median_stance, CAST(sum(n_articles) AS BIGINT) AS n_articles, count(*) AS n_days_covered,
  min(article_date) AS week_start, max(article_date) AS week_end FROM daily GROUP BY 1, 2)"""
GRID = f"""{WEEKLY}, grid AS (SELECT f.company_id, f.week_monday, w.simple_mean_stance, w.n_articles, w.n_days_covered,
  w.simple_mean_stance IS NOT NULL AS has_data
  FROM (SELECT company_id, CAST(unnest(generate_series(DATE '1995-01-02', DATE '{END}', INTERVAL 7 DAY)) AS DATE) AS week_monday
        FROM (SELECT DISTINCT company_id FROM weekly)) f
  LEFT JOIN weekly w ON w.company_id = f.company_id AND w.week_monday = f.week_monday)"""
GAPS = f"""{GRID}, gaps AS (SELECT company_id, min(week_monday) AS gap_start, max(week_monday) AS gap_end, count(*) AS gap_weeks,
  CASE WHEN count(*) <= 2 THEN 'A' WHEN count(*) <= 8 THEN 'B' ELSE 'C' END AS gap_type
  FROM (SELECT *, week_monday - CAST(7 * row_number() OVER (PARTITION BY company_id ORDER BY week_monday) AS INTEGER) AS run
        FROM grid WHERE NOT has_data) GROUP BY company_id, run)"""
SUMMARY = f"""{GAPS}, summary AS (SELECT g.company_id, g.total_weeks, g.weeks_with_data,
  CAST(coalesce(p.weeks_missing, 0) AS BIGINT) AS weeks_missing, coalesce(p.a, 0) AS gaps_type_a, coalesce(p.b, 0) AS gaps_type_b,
  coalesce(p.c, 0) AS gaps_type_c, coalesce(p.longest_gap, 0) AS longest_gap,
  round_even(g.weeks_with_data * 100.0 / g.total_weeks, 1) AS pct_covered
  FROM (SELECT company_id, count(*) AS total_weeks, count(*) FILTER (has_data) AS weeks_with_data FROM grid GROUP BY 1) g
  LEFT JOIN (SELECT company_id, sum(gap_weeks) AS weeks_missing, count(*) FILTER (gap_type = 'A') AS a,
             count(*) FILTER (gap_type = 'B') AS b, count(*) FILTER (gap_type = 'C') AS c, max(gap_weeks) AS longest_gap
             FROM gaps GROUP BY 1) p ON p.company_id = g.company_id)"""
FILLED = f"""{GAPS}, around AS (SELECT grid.*, gaps.gap_type,
    last_value(simple_mean_stance IGNORE NULLS) OVER past AS pv,
    last_value(CASE WHEN has_data THEN grid.week_monday END IGNORE NULLS) OVER past AS pw,
    first_value(simple_mean_stance IGNORE NULLS) OVER ahead AS nv,
    first_value(CASE WHEN has_data THEN grid.week_monday END IGNORE NULLS) OVER ahead AS nw
  FROM grid LEFT JOIN gaps ON gaps.company_id = grid.company_id AND grid.week_monday BETWEEN gap_start AND gap_end
  WINDOW past AS (PARTITION BY grid.company_id ORDER BY grid.week_monday ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY grid.company_id ORDER BY grid.week_monday ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT company_id, week_monday, has_data, n_days_covered, gap_type, coalesce(gap_type IN ('A', 'B'), false) AS is_imputed,
    CASE WHEN coalesce(gap_type IN ('A', 'B'), false) THEN 0 ELSE n_articles END AS n_articles,
    CASE WHEN has_data THEN simple_mean_stance WHEN gap_type = 'A' THEN pv
         WHEN gap_type = 'B' THEN coalesce(pv + (nv - pv) * (week_monday - pw) / (nw - pw), pv) END AS simple_mean_stance
  FROM around)"""

RETURNS = """daily_ret AS (SELECT * FROM (SELECT ticker, date, close, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY date)
  AS log_return FROM {prices}) WHERE log_return IS NOT NULL),
weekly_ret AS (SELECT ticker, CAST(date_trunc('week', date) AS DATE) AS week_monday, sum(log_return) AS weekly_log_return,
  count(*) AS n_trading_days, arg_min(close, date) AS week_open, arg_max(close, date) AS week_close,
  count(*) < 4 AS flag_short_week, abs(sum(log_return)) > 0.15 AS flag_extreme FROM daily_ret GROUP BY 1, 2)"""


def scores(t: Tables):
    return index.stance_scores(t.scored_events, START, END)


def daily(t: Tables):
    return index.daily_index(scores(t))


def weekly(t: Tables):
    return index.weekly_index(daily(t))


def grid(t: Tables):
    return gaps.weekly_grid(weekly(t), START, END)


def filled(t: Tables):
    g = grid(t)
    return gaps.impute(g, gaps.find_gaps(g))


def weekly_rets(t: Tables):
    return returns.weekly_returns(returns.log_returns(t.prices))


def aligned(t: Tables):
    """Weekly index of the 16 dense firms against their weekly returns."""
    s = index.stance_scores(t.stance_days, START, END)
    idx = index.weekly_index(index.daily_index(s, ("ticker",)), ("ticker",))
    return returns.align(idx.select("ticker", "week_monday", "simple_mean_stance", "n_articles"), weekly_rets(t))


ALIGNED = f"""dense AS (SELECT ticker, CAST(date_trunc('week', d) AS DATE) AS week_monday, avg(m) AS simple_mean_stance,
  CAST(sum(n) AS BIGINT) AS n_articles
  FROM (SELECT ticker, CAST(published_at AS DATE) AS d, avg(pos_score - neg_score) AS m, count(*) AS n
        FROM {{stance_days}} WHERE {IN_WINDOW} GROUP BY 1, 2) GROUP BY 1, 2), {RETURNS},
aligned AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.week_monday, b.week_monday) AS week_monday,
  a.simple_mean_stance, a.n_articles, b.weekly_log_return, b.n_trading_days, b.flag_short_week, b.flag_extreme,
  CASE WHEN a.ticker IS NULL THEN 'right_only' WHEN b.ticker IS NULL THEN 'left_only' ELSE 'both' END AS side
  FROM dense a FULL JOIN weekly_ret b ON a.ticker = b.ticker AND a.week_monday = b.week_monday)"""


@query(
    "panel_structure",
    f"""WITH p AS (SELECT company_id, count(*) AS total_before_filter,
      count(*) FILTER (greatest(pos_score, neg_score, neutral_score) >= 0.5) AS total_after_filter,
      min(CAST(published_at AS DATE)) FILTER (greatest(pos_score, neg_score, neutral_score) >= 0.5) AS first_article_date,
      max(CAST(published_at AS DATE)) FILTER (greatest(pos_score, neg_score, neutral_score) >= 0.5) AS last_article_date,
      count(DISTINCT CAST(published_at AS DATE)) FILTER (greatest(pos_score, neg_score, neutral_score) >= 0.5) AS days_with_articles
      FROM {{scored_events}} WHERE {IN_WINDOW} GROUP BY 1),
    q AS (SELECT *, last_article_date - first_article_date + 1 AS window_calendar_days,
      CAST(round((last_article_date - first_article_date + 1) * 5.0 / 7) AS BIGINT) AS approx_trading_days FROM p)
    SELECT *, greatest(approx_trading_days - days_with_articles, 0) AS days_zero_articles,
      days_with_articles * 100.0 / nullif(approx_trading_days, 0) AS pct_trading_days_covered,
      days_with_articles * 100.0 / nullif(approx_trading_days, 0) < 30 AS flag_sparse FROM q""",
    "pct_trading_days_covered",
)
def _(t: Tables):
    return index.panel_structure(t.scored_events, START, END, filters.top_score() >= 0.5)


@query(
    "stock_inventory",
    f"""WITH p AS (SELECT ticker, min(date) AS stock_start, max(date) AS stock_end, count(*) AS trading_day_rows,
      max(date) - min(date) + 1 AS window_calendar_days FROM {{prices}} WHERE date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1),
    q AS (SELECT *, CAST(round(window_calendar_days * 5.0 / 7) AS BIGINT) AS approx_trading_days FROM p)
    SELECT *, greatest((1 - trading_day_rows / nullif(approx_trading_days, 0)) * 100, 0) AS gap_rate_pct FROM q""",
    "gap_rate_pct",
)
def _(t: Tables):
    return index.stock_inventory(t.prices, START, END)


@query(
    "articles_per_day",
    f"""SELECT company_id, CAST(published_at AS DATE) AS article_date, count(*) AS articles_on_day FROM {{scored_events}}
    WHERE {IN_WINDOW} GROUP BY 1, 2""",
)
def _(t: Tables):
    return index.articles_per_day(t.scored_events, START, END)


FREQ = f"""per_day AS (SELECT company_id, CAST(published_at AS DATE) AS article_date, count(*) AS n FROM {{scored_events}}
      WHERE {IN_WINDOW} GROUP BY 1, 2),
    cal AS (SELECT company_id, CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS article_date
      FROM (SELECT DISTINCT company_id FROM per_day)),
    whole AS (SELECT c.company_id, c.article_date, coalesce(p.n, 0) AS n FROM cal c LEFT JOIN per_day p
      ON p.company_id = c.company_id AND p.article_date = c.article_date),
    freq AS (SELECT company_id, avg(n) AS avg_articles_per_day, CAST(median(n) AS DOUBLE) AS median_articles_per_day_all,
      coalesce(CAST(median(n) FILTER (n > 0) AS DOUBLE), 0) AS median_articles_per_day_nonzero,
      CAST(quantile_cont(n, 0.25) AS DOUBLE) AS p25_articles_per_day, CAST(quantile_cont(n, 0.75) AS DOUBLE) AS p75_articles_per_day,
      max(n) AS max_articles_per_day, count(*) FILTER (n = 0) AS days_with_zero_articles,
      count(*) FILTER (n = 0) * 100.0 / count(*) AS pct_zero_days FROM whole GROUP BY 1)"""


@query(
    "daily_frequency_distribution",
    f"""WITH {FREQ} SELECT f.*, w.avg_articles_per_week, m.avg_articles_per_month FROM freq f
    JOIN (SELECT company_id, avg(s) AS avg_articles_per_week FROM (SELECT company_id, date_trunc('week', article_date) AS k, sum(n) AS s
          FROM whole GROUP BY 1, 2) GROUP BY 1) w ON w.company_id = f.company_id
    JOIN (SELECT company_id, avg(s) AS avg_articles_per_month FROM (SELECT company_id, date_trunc('month', article_date) AS k, sum(n) AS s
          FROM whole GROUP BY 1, 2) GROUP BY 1) m ON m.company_id = f.company_id""",
    "avg_articles_per_day median_articles_per_day_all median_articles_per_day_nonzero p25_articles_per_day "
    "p75_articles_per_day pct_zero_days avg_articles_per_week avg_articles_per_month",
)
def _(t: Tables):
    return index.frequency_distribution(index.articles_per_day(t.scored_events, START, END), START, END)


@query(
    "frequency_recommendation",
    f"""WITH {FREQ} SELECT median(median_articles_per_day_all) AS median_articles_per_day,
    CASE WHEN median(median_articles_per_day_all) < 3 THEN 'weekly' ELSE 'daily' END AS recommendation FROM freq""",
    "median_articles_per_day",
)
def _(t: Tables):
    per_day = index.articles_per_day(t.scored_events, START, END)
    return index.recommend_frequency(index.frequency_distribution(per_day, START, END))


@query(
    "stance_distribution",
    f"""WITH {SCORES}, c AS (SELECT s.company_id, stance_score AS x, stance_score - m AS d FROM scores s
      JOIN (SELECT company_id, avg(stance_score) AS m FROM scores GROUP BY 1) USING (company_id))
    SELECT company_id, count(*) AS n_articles, avg(x) AS mean, stddev_samp(x) AS std,
      avg(d * d * d) / pow(avg(d * d), 1.5) AS skewness, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS kurtosis,
      min(x) AS min, max(x) AS max, count(*) FILTER (abs(x) <= 0.05) * 100.0 / count(*) AS pct_near_zero,
      count(*) FILTER (x = 0) * 100.0 / count(*) AS pct_exactly_zero, quantile_cont(x, 0.25) AS p25, median(x) AS median,
      quantile_cont(x, 0.75) AS p75 FROM c GROUP BY 1""",
    "mean std skewness kurtosis min max pct_near_zero pct_exactly_zero p25 median p75",
)
def _(t: Tables):
    return index.stance_distribution(scores(t))


@query("daily_index", f"WITH {DAILY} SELECT *, mean_stance AS weighted_mean_stance FROM daily", "mean_stance median_stance weighted_mean_stance")
def _(t: Tables):
    return daily(t)


@query(
    "daily_quality",
    f"""WITH {DAILY} SELECT company_id, count(*) AS total_days, count(*) FILTER (n_articles = 1) AS days_single_article,
      count(*) FILTER (n_articles = 1) * 100.0 / count(*) AS pct_single_article,
      count(*) FILTER (mean_stance < -1 OR mean_stance > 1) AS out_of_range_days,
      count(*) FILTER (swing > 1.0) AS big_swing_days, avg(n_articles) AS mean_daily_articles,
      CAST(floor(median(n_articles)) AS BIGINT) AS median_daily_articles
    FROM (SELECT *, abs(mean_stance - lag(mean_stance) OVER (PARTITION BY company_id ORDER BY article_date)) AS swing FROM daily)
    GROUP BY 1""",
    "pct_single_article mean_daily_articles",
)
def _(t: Tables):
    return index.daily_quality(daily(t))


@query("weekly_stance_index", f"WITH {WEEKLY} SELECT * FROM weekly", "weighted_mean_stance simple_mean_stance median_stance")
def _(t: Tables):
    return weekly(t)


COVERAGE = """coverage AS (SELECT company_id, 366 AS total_weeks_window, count(*) AS weeks_with_data, 366 - count(*) AS weeks_empty,
      count(*) * 100.0 / 366 AS pct_covered, avg(n_articles) AS mean_articles_per_week,
      CAST(floor(median(n_articles)) AS BIGINT) AS median_articles_per_week FROM weekly GROUP BY 1)"""


@query("weekly_coverage", f"WITH {WEEKLY}, {COVERAGE} SELECT * FROM coverage", "pct_covered mean_articles_per_week")
def _(t: Tables):
    return index.weekly_coverage(weekly(t), START, END)


@query(
    "weekly_coverage_note",
    f"""WITH {WEEKLY}, {COVERAGE} SELECT median(pct_covered) AS median_coverage, CASE WHEN median(pct_covered) > 90 THEN 'excellent'
      WHEN median(pct_covered) > 70 THEN 'good' ELSE 'sparse' END AS note FROM coverage""",
    "median_coverage",
)
def _(t: Tables):
    return index.coverage_note(index.weekly_coverage(weekly(t), START, END))


@query("weekly_grid", f"WITH {GRID} SELECT * FROM grid", "simple_mean_stance")
def _(t: Tables):
    return grid(t)


@query("week_gaps", f"WITH {GAPS} SELECT * FROM gaps")
def _(t: Tables):
    return gaps.find_gaps(grid(t))


@query("gap_summary", f"WITH {SUMMARY} SELECT * FROM summary", "pct_covered")
def _(t: Tables):
    g = grid(t)
    return gaps.gap_summary(g, gaps.find_gaps(g))


@query(
    "coverage_threshold",
    f"""WITH {SUMMARY} SELECT *, NOT (pct_covered < 60 OR longest_gap > 8) AS passes,
      CASE WHEN pct_covered < 60 AND longest_gap > 8 THEN
             concat('Coverage ', printf('%.1f', pct_covered), '% < 60.0%; Longest gap ', longest_gap, ' weeks > 8')
           WHEN pct_covered < 60 THEN concat('Coverage ', printf('%.1f', pct_covered), '% < 60.0%')
           WHEN longest_gap > 8 THEN concat('Longest gap ', longest_gap, ' weeks > 8') ELSE 'OK' END AS reason FROM summary""",
    "pct_covered",
)
def _(t: Tables):
    g = grid(t)
    return gaps.coverage_threshold(gaps.gap_summary(g, gaps.find_gaps(g)))


@query(
    "gap_imputation",
    f"""WITH {FILLED} SELECT company_id, week_monday, simple_mean_stance, n_articles, n_days_covered, has_data, is_imputed FROM filled""",
    "simple_mean_stance",
)
def _(t: Tables):
    return filled(t)[0]


@query(
    "gap_imputation_log",
    f"""WITH {FILLED} SELECT company_id, week_monday, gap_type, CASE WHEN gap_type = 'A' THEN 'forward_fill'
      ELSE 'linear_interpolation' END AS method, simple_mean_stance AS imputed_value FROM filled WHERE is_imputed""",
    "imputed_value",
)
def _(t: Tables):
    return filled(t)[1]


@query(
    "observed_only_series",
    f"""WITH {FILLED} SELECT company_id, week_monday, simple_mean_stance, n_articles, n_days_covered, has_data, is_imputed
    FROM filled WHERE NOT is_imputed""",
    "simple_mean_stance",
)
def _(t: Tables):
    return gaps.observed_only(filled(t)[0])


@query("daily_log_returns", f"WITH {RETURNS} SELECT ticker, date, close, log_return FROM daily_ret", "close log_return")
def _(t: Tables):
    return returns.log_returns(t.prices)


@query(
    "daily_simple_returns",
    """SELECT * FROM (SELECT ticker, date, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS daily_return
    FROM {prices}) WHERE daily_return IS NOT NULL""",
    "close daily_return",
)
def _(t: Tables):
    return returns.simple_returns(t.prices)


@query("weekly_returns", f"WITH {RETURNS} SELECT * FROM weekly_ret", "weekly_log_return week_open week_close")
def _(t: Tables):
    return weekly_rets(t)


@query(
    "returns_quality",
    f"""WITH {RETURNS} SELECT ticker, count(*) AS n_weeks, min(week_monday) AS first_week, max(week_monday) AS last_week,
      avg(weekly_log_return) AS mean_return, stddev_samp(weekly_log_return) AS std_return, min(weekly_log_return) AS min_return,
      max(weekly_log_return) AS max_return, count(*) FILTER (flag_extreme) AS n_extreme, count(*) FILTER (flag_short_week) AS n_short_weeks,
      count(*) FILTER (abs(weekly_log_return) < 1e-8) * 100.0 / count(*) AS pct_zero_return FROM weekly_ret GROUP BY 1""",
    "mean_return std_return min_return max_return pct_zero_return",
)
def _(t: Tables):
    return returns.returns_quality(weekly_rets(t))


@query("index_return_alignment", f"WITH {ALIGNED} SELECT * FROM aligned", "simple_mean_stance weekly_log_return")
def _(t: Tables):
    return aligned(t).drop("week_open", "week_close")


@query(
    "alignment_counts",
    f"""WITH {ALIGNED} SELECT ticker, count(*) AS total_weeks_union, count(*) FILTER (side <> 'right_only') AS weeks_with_bias,
      count(*) FILTER (side <> 'left_only') AS weeks_with_returns, count(*) FILTER (side = 'both') AS weeks_both,
      count(*) FILTER (side = 'left_only') AS weeks_bias_only, count(*) FILTER (side = 'right_only') AS weeks_returns_only,
      count(*) FILTER (side = 'both') >= 100 AS sufficient FROM aligned GROUP BY 1""",
)
def _(t: Tables):
    return returns.alignment(aligned(t))


@query(
    "weekly_market_series",
    """SELECT coalesce(r.w, v.w) AS week_monday, market_return, vix FROM
      (SELECT CAST(date_trunc('week', date) AS DATE) AS w, sum(lr) AS market_return
       FROM (SELECT date, ln(close) - lag(ln(close)) OVER (ORDER BY date) AS lr FROM {market}) WHERE lr IS NOT NULL GROUP BY 1) r
      FULL JOIN (SELECT CAST(date_trunc('week', trade_date) AS DATE) AS w, arg_max(close, trade_date) AS vix FROM {vix} GROUP BY 1) v
      ON r.w = v.w""",
    "market_return vix",
)
def _(t: Tables):
    return returns.weekly_market(t.market, t.vix)


@query(
    "weekly_market_series_ending_monday",
    """SELECT coalesce(r.w, v.w) AS week_monday, market_return, vix FROM
      (SELECT CAST(date_trunc('week', date + 6) AS DATE) AS w, sum(lr) AS market_return
       FROM (SELECT date, ln(close) - lag(ln(close)) OVER (ORDER BY date) AS lr FROM {market}) WHERE lr IS NOT NULL GROUP BY 1) r
      FULL JOIN (SELECT CAST(date_trunc('week', trade_date + 6) AS DATE) AS w, arg_max(close, trade_date) AS vix FROM {vix} GROUP BY 1) v
      ON r.w = v.w""",
    "market_return vix",
)
def _(t: Tables):
    return returns.weekly_market(t.market, t.vix, "w_mon")


@query(
    "panel_with_weekly_market",
    f"""WITH {ALIGNED}, m AS (SELECT CAST(date_trunc('week', date) AS DATE) AS w, sum(lr) AS market_return
       FROM (SELECT date, ln(close) - lag(ln(close)) OVER (ORDER BY date) AS lr FROM {{market}}) WHERE lr IS NOT NULL GROUP BY 1)
    SELECT ticker, week_monday, simple_mean_stance, weekly_log_return, market_return FROM aligned LEFT JOIN m ON m.w = week_monday
    WHERE side = 'both'""",
    "simple_mean_stance weekly_log_return market_return",
)
def _(t: Tables):
    market = returns.weekly_market(t.market, t.vix).select("week_monday", "market_return")
    panel = aligned(t).filter("side = 'both'").select("ticker", "week_monday", "simple_mean_stance", "weekly_log_return")
    return panel.join(market, "week_monday", "left")


@query(
    "filled_controls",
    """WITH d AS (SELECT trade_date AS date, CASE WHEN dayofmonth(trade_date) % 3 <> 0 THEN close END AS vix FROM {vix})
    SELECT date, coalesce(last_value(vix IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(vix IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vix FROM d""",
    "vix",
)
def _(t: Tables):
    sparse = t.vix.select(
        F.col("trade_date").alias("date"), F.when(F.dayofmonth("trade_date") % 3 != 0, F.col("close")).alias("vix")
    )
    return returns.fill_controls(sparse, ["vix"])


@query(
    "calendar_keys",
    f"""SELECT id, CAST(year(published_at) AS BIGINT) AS y, CAST(month(published_at) AS BIGINT) AS m, CAST(isoyear(published_at) AS BIGINT) AS iso_y,
      CAST(week(published_at) AS BIGINT) AS iso_w, CAST(date_trunc('week', published_at) AS DATE) AS week_monday,
      CAST(date_trunc('month', published_at) AS DATE) AS month_start,
      CAST((year(published_at) - 1998) * 12 + month(published_at) - 1 AS BIGINT) AS event_month,
      CAST(CASE WHEN CAST(published_at AS DATE) >= DATE '{CUT}' THEN 1 ELSE 0 END AS BIGINT) AS post FROM {{scored_events}}""",
)
def _(t: Tables):
    d = F.to_date("published_at")
    return t.scored_events.select(
        "id",
        F.year(d).alias("y"),
        F.month(d).alias("m"),
        F.extract(F.lit("YEAROFWEEK"), d).alias("iso_y"),
        F.weekofyear(d).alias("iso_w"),
        week_monday(d).alias("week_monday"),
        F.trunc(d, "month").alias("month_start"),
        filters.month_index(d, 1998).alias("event_month"),
        (d >= F.lit(CUT).cast("date")).cast("int").alias("post"),
    )


@query(
    "event_month_dummies",
    """WITH e AS (SELECT id, CAST((year(published_at) - 1998) * 12 + month(published_at) - 1 AS BIGINT) AS event_month FROM {scored_events})
    SELECT id, event_month, """
    + ", ".join(
        f"CAST(CASE WHEN event_month = {m} THEN 1 ELSE 0 END AS BIGINT) AS event_{filters.month_label(m)}"
        for m in range(-24, 25)
        if m != -1
    )
    + " FROM e WHERE event_month BETWEEN -24 AND 24",
)
def _(t: Tables):
    return filters.event_dummies(t.scored_events.select("id", "published_at"), "published_at", -24, 24, -1, 1998).drop("published_at")


@query(
    "stance_summary_overall",
    """SELECT count(*) AS total_articles, count(*) FILTER (greatest(pos_score, neg_score, neutral_score) >= 0.6) AS high_confidence,
      count(*) FILTER (pos_score >= neutral_score AND pos_score >= neg_score) AS positive,
      count(*) FILTER (neg_score >= pos_score AND neg_score >= neutral_score) AS negative,
      count(*) FILTER (neutral_score >= pos_score AND neutral_score >= neg_score) AS neutral,
      avg(pos_score) AS avg_pos_score, avg(neg_score) AS avg_neg_score, avg(neutral_score) AS avg_neutral_score
    FROM {articles} WHERE pos_score IS NOT NULL""",
    "avg_pos_score avg_neg_score avg_neutral_score",
)
def _(t: Tables):
    return matrices.stance_summary(t.articles, [], 0.6)


@query(
    "stance_summary_by_firm",
    """SELECT c.symbol, c.name, count(*) AS total_articles,
      count(*) FILTER (greatest(pos_score, neg_score, neutral_score) >= 0.6) AS high_confidence,
      count(*) FILTER (pos_score >= neutral_score AND pos_score >= neg_score) AS positive,
      count(*) FILTER (neg_score >= pos_score AND neg_score >= neutral_score) AS negative,
      count(*) FILTER (neutral_score >= pos_score AND neutral_score >= neg_score) AS neutral,
      avg(pos_score) AS avg_pos_score, avg(neg_score) AS avg_neg_score, avg(neutral_score) AS avg_neutral_score
    FROM {articles} a JOIN {companies} c ON c.id = a.company_id WHERE pos_score IS NOT NULL GROUP BY 1, 2""",
    "avg_pos_score avg_neg_score avg_neutral_score",
)
def _(t: Tables):
    firms = t.companies.select(F.col("id").alias("company_id"), "symbol", "name")
    # aggregated by key first, so that the join sees one row per firm
    per_firm = matrices.stance_summary(t.articles, ["company_id"], 0.6)
    return per_firm.join(firms, "company_id").drop("company_id")


@query(
    "stance_pivot",
    """WITH s AS (SELECT company_id, CASE WHEN pos_score >= neutral_score AND pos_score >= neg_score THEN 'positive'
        WHEN neg_score >= pos_score AND neg_score >= neutral_score THEN 'negative' ELSE 'neutral' END AS stance
      FROM {articles} WHERE greatest(pos_score, neg_score, neutral_score) >= 0.6)
    SELECT company_id, count(*) FILTER (stance = 'negative') AS negative, count(*) FILTER (stance = 'neutral') AS neutral,
      count(*) FILTER (stance = 'positive') AS positive, count(*) AS total FROM s GROUP BY 1""",
)
def _(t: Tables):
    return matrices.stance_pivot(t.articles, "company_id", 0.6)


@query(
    "stance_classes",
    """SELECT id, greatest(pos_score, neg_score, neutral_score) AS max_confidence,
      CASE WHEN pos_score >= neutral_score AND pos_score >= neg_score THEN 'positive'
        WHEN neg_score >= pos_score AND neg_score >= neutral_score THEN 'negative' ELSE 'neutral' END AS stance,
      greatest(pos_score, neg_score, neutral_score) >= 0.9 AS high_confidence FROM {articles}""",
    "max_confidence",
)
def _(t: Tables):
    return matrices.max_stance(t.articles).select("id", "max_confidence", "stance", "high_confidence")


@query(
    "stance_export",
    """SELECT id AS original_id, company_id, strftime(published_at, '%Y-%m-%d') AS published_at, round_even(pos_score, 6) AS prob_positive,
      round_even(neg_score, 6) AS prob_negative, round_even(neutral_score, 6) AS prob_neutral,
      round_even(greatest(pos_score, neg_score, neutral_score), 6) AS max_confidence,
      CASE WHEN pos_score >= neutral_score AND pos_score >= neg_score THEN 'positive'
        WHEN neg_score >= pos_score AND neg_score >= neutral_score THEN 'negative' ELSE 'neutral' END AS stance,
      greatest(pos_score, neg_score, neutral_score) >= 0.9 AS high_confidence FROM {articles} WHERE pos_score IS NOT NULL""",
    "prob_positive prob_negative prob_neutral max_confidence",
)
def _(t: Tables):
    return matrices.export_rows(t.articles)

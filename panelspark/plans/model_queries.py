"""Panel regressions, diagnostics, time-series tests, similarity and synthetic control."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import filters, regression, returns
from ..operators import timeseries as ts
from ..scale import checkpointed
from ..sources import tables
from ..views import Tables
from .index_queries import ALIGNED, CUT, END, IN_WINDOW, START, aligned
from .registry import query
from .solver_sql import CLUSTER_DOUBLES, FRAME_DOUBLES, absorbed, frame, least_squares, synthetic_effects

PANEL = f"""panel AS (SELECT company_id, CAST(published_at AS DATE) AS date, avg(pos_score - neg_score) AS daily_stance,
  count(*) AS article_volume, CASE WHEN CAST(published_at AS DATE) >= DATE '{CUT}' THEN 1 ELSE 0 END AS post
  FROM {{scored_events}} WHERE {IN_WINDOW} GROUP BY 1, 2)"""


def panel(t: Tables):
    rows = filters.scored_only(filters.in_window(t.scored_events, "published_at", START, END, "company_id"))
    return regression.firm_day_panel(rows, CUT)


def return_panel(t: Tables):
    daily = returns.simple_returns(t.prices).select("ticker", "date", "daily_return")
    market = tables.benchmark_return(t.market, start=START, end=END)
    universe = t.prices.select("ticker").distinct()
    return returns.return_panel(universe, daily, market, tables.vix_levels(t.vix), CUT)


RETURN_PANEL = f"""rp AS (SELECT r.ticker, r.date, r.daily_return, m.sp500_return, v.close AS vix,
    CASE WHEN r.date >= DATE '{CUT}' THEN 1 ELSE 0 END AS post
  FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS daily_return FROM {{prices}}) r
  LEFT JOIN (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS sp500_return FROM {{market}}) m ON m.date = r.date
  LEFT JOIN {{vix}} v ON v.trade_date = r.date WHERE r.daily_return IS NOT NULL),
filled AS (SELECT ticker, date, daily_return, post, coalesce(sp500_return, (SELECT arg_min(sp500_return, date) FROM rp
    WHERE sp500_return IS NOT NULL)) AS sp500_return, vix FROM rp)"""


@query("firm_day_panel", f"WITH {PANEL} SELECT company_id, date, daily_stance, article_volume, CAST(post AS BIGINT) AS post FROM panel", "daily_stance")
def _(t: Tables):
    return regression.require_both_periods(panel(t))


@query(
    "filter_diagnostics",
    f"""SELECT count(*) AS total_rows_date_window, count(company_id) AS rows_with_company, count(pos_score) AS rows_with_all_scores,
      count(pos_score) AS rows_company_and_scores, count(*) FILTER (greatest(pos_score, neg_score, neutral_score) >= 0.5) AS rows_after_threshold,
      count(DISTINCT company_id) FILTER (greatest(pos_score, neg_score, neutral_score) >= 0.5) AS firms_after_threshold
    FROM {{scored_events}} WHERE {IN_WINDOW}""",
)
def _(t: Tables):
    return regression.filter_diagnostics(t.scored_events, START, END, 0.5)


@query(
    "pre_period_spread",
    f"""WITH {PANEL}, m AS (SELECT avg(daily_stance) AS m FROM panel WHERE post = 0 GROUP BY company_id)
    SELECT count(*) AS n_firms, min(m) AS min, max(m) AS max, max(m) - min(m) AS range, stddev_samp(m) AS std,
      max(m) - min(m) <= 0.02 AS means_equal, max(m) - min(m) > 0.02 AS trigger_scdid FROM m""",
    "min max range std",
)
def _(t: Tables):
    return regression.pre_period_spread(panel(t), "daily_stance", 0.02)


@query(
    "panel_summary",
    f"""WITH {PANEL}, s AS (SELECT 'all' AS split, * FROM panel UNION ALL SELECT CASE WHEN post = 1 THEN 'post' ELSE 'pre' END, * FROM panel)
    SELECT split, count(*) AS firm_days, count(DISTINCT company_id) AS firms, count(DISTINCT date) AS days, min(date) AS first_day,
      max(date) AS last_day, avg(daily_stance) AS mean_stance, CAST(sum(article_volume) AS BIGINT) AS articles, avg(article_volume) AS mean_volume,
      min(article_volume) AS min_volume, max(article_volume) AS max_volume,
      count(*) / (count(DISTINCT company_id) * count(DISTINCT date)) AS density, median(article_volume) AS median_volume FROM s GROUP BY 1""",
    "mean_stance mean_volume density median_volume",
)
def _(t: Tables):
    return regression.panel_summary(panel(t))


@query(
    "firm_universe",
    f"""SELECT DISTINCT c.id AS company_id, symbol, name, exposure FROM {{companies}} c JOIN {{scored_events}} e ON e.company_id = c.id
    WHERE {IN_WINDOW} AND symbol IS NOT NULL""",
    "exposure",
)
def _(t: Tables):
    return regression.firm_universe(t.scored_events, t.companies, START, END)


@query(
    "return_panel",
    f"WITH {RETURN_PANEL} SELECT ticker, date, daily_return, CAST(post AS BIGINT) AS post, sp500_return, vix FROM filled",
    "daily_return sp500_return vix",
)
def _(t: Tables):
    return return_panel(t)


# within transforms in SQL: entity effects only, and the one-pass two-way form
WITHIN = f"""{PANEL}, w AS (SELECT company_id, date, daily_stance - avg(daily_stance) OVER e AS y, post - avg(post) OVER e AS x1,
    article_volume - avg(article_volume) OVER e AS x2 FROM panel WINDOW e AS (PARTITION BY company_id))"""
TWO_WAY = f"""{PANEL}, w AS (SELECT company_id, date,
    daily_stance - avg(daily_stance) OVER e - (avg(daily_stance) OVER d - avg(daily_stance) OVER ()) AS y,
    post - avg(post) OVER e - (avg(post) OVER d - avg(post) OVER ()) AS x1,
    article_volume - avg(article_volume) OVER e - (avg(article_volume) OVER d - avg(article_volume) OVER ()) AS x2
  FROM panel WINDOW e AS (PARTITION BY company_id), d AS (PARTITION BY date))"""
# least squares on two regressors with HC1 and day-clustered errors in closed form
SOLVED = """m AS (SELECT count(*) AS n, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS p, sum(x2 * y) AS q,
    sum(y * y) - sum(y) * sum(y) / count(*) AS sst FROM w),
  beta AS (SELECT *, a * c - b * b AS det, (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2 FROM m),
  u AS (SELECT company_id, date, x1, x2, y - b1 * x1 - b2 * x2 AS u FROM w, beta),
  meat AS (SELECT sum(u * u * x1 * x1) AS s11, sum(u * u * x1 * x2) AS s12, sum(u * u * x2 * x2) AS s22, sum(u * u) AS sse FROM u),
  cl AS (SELECT count(*) AS g, sum(s1 * s1) AS k11, sum(s1 * s2) AS k12, sum(s2 * s2) AS k22
    FROM (SELECT sum(u * x1) AS s1, sum(u * x2) AS s2 FROM u GROUP BY date)),
  solved AS (SELECT *, sqrt(n / (n - 2.0) * (c * c * s11 - 2 * b * c * s12 + b * b * s22)) / det AS se1,
    sqrt(n / (n - 2.0) * (b * b * s11 - 2 * a * b * s12 + a * a * s22)) / det AS se2,
    sqrt(g / (g - 1.0) * (n - 1.0) / (n - 2.0) * (c * c * k11 - 2 * b * c * k12 + b * b * k22)) / det AS cse1,
    sqrt(g / (g - 1.0) * (n - 1.0) / (n - 2.0) * (b * b * k11 - 2 * a * b * k12 + a * a * k22)) / det AS cse2
    FROM beta, meat, cl)"""
COEFS = """SELECT 'post' AS variable, b1 AS coef, se1 AS se, b1 / se1 AS t_stat, b1 - 1.96 * se1 AS ci95_low, b1 + 1.96 * se1 AS ci95_high,
    cse1 AS se_cluster, n AS n_obs, CAST(2 AS BIGINT) AS n_regressors, 1 - sse / sst AS r2_within FROM solved UNION ALL
  SELECT 'article_volume', b2, se2, b2 / se2, b2 - 1.96 * se2, b2 + 1.96 * se2, cse2, n, CAST(2 AS BIGINT), 1 - sse / sst FROM solved"""
_COEF_COLS = "variable coef se t_stat ci95_low ci95_high se_cluster n_obs n_regressors r2_within".split()
_COEF_DOUBLES = "coef se t_stat ci95_low ci95_high se_cluster r2_within"


@query("within_transform", f"WITH {TWO_WAY} SELECT company_id, date, y AS daily_stance, x1 AS post, x2 AS article_volume FROM w", "daily_stance post article_volume")
def _(t: Tables):
    return regression.within(panel(t), "daily_stance", ["post", "article_volume"], "company_id", "date").select(
        "company_id", "date", "daily_stance", "post", "article_volume"
    )


@query("stance_model_firm_effects", f"WITH {WITHIN}, {SOLVED} {COEFS}", _COEF_DOUBLES)
def _(t: Tables):
    return regression.stance_model(panel(t)).frame().select(*_COEF_COLS)


@query("stance_model_two_way", f"WITH {TWO_WAY}, {SOLVED} {COEFS}", _COEF_DOUBLES)
def _(t: Tables):
    return regression.stance_model(panel(t), time_fe=True).frame().select(*_COEF_COLS)


@query(
    "stance_model_log_volume",
    f"WITH {WITHIN.replace('article_volume - avg(article_volume) OVER e', 'ln(1 + article_volume) - avg(ln(1 + article_volume)) OVER e')}, {SOLVED} "
    + COEFS.replace("'article_volume'", "'log_volume'"),
    _COEF_DOUBLES,
)
def _(t: Tables):
    return regression.stance_model(panel(t), log_volume=True).frame().select(*_COEF_COLS)


@query(
    "stance_model_inference",
    f"""WITH RECURSIVE {WITHIN.replace('w AS (SELECT', 'v AS (SELECT')}, w AS (SELECT date, y, [x1, x2] AS x FROM v), {least_squares(2, cluster="date")}
    {frame(["post", "article_volume"], True)}""",
    CLUSTER_DOUBLES,
)
def _(t: Tables):
    return regression.stance_model(panel(t)).frame()


@query(
    "time_effect_test",
    f"""WITH {WITHIN}, {SOLVED}, d AS (SELECT sum(s * s / k) AS explained, count(*) AS days FROM (SELECT sum(u) AS s, count(*) AS k FROM u GROUP BY date))
    SELECT (explained / (days - 1)) / ((sse - explained) / (n - 2 - (days - 1))) AS f_stat, days - 1 AS df1, n - 2 - (days - 1) AS df2
    FROM solved, d""",
    "f_stat",
)
def _(t: Tables):
    return regression.time_effect_test(panel(t), "daily_stance", ["post", "article_volume"], "company_id", "date").select("f_stat", "df1", "df2")


_MONTHS = [m for m in range(-24, 25) if m != -1]
_EVENT = [f"event_{filters.month_label(m)}" for m in _MONTHS] + ["article_volume"]


@query(
    "event_study",
    f"""WITH RECURSIVE {PANEL}, e AS (SELECT company_id, date, daily_stance, article_volume, (year(date) - 1998) * 12 + month(date) - 1 AS em FROM panel),
    r AS (SELECT company_id, date, daily_stance AS y, list_append([CASE WHEN em = m THEN 1.0 ELSE 0.0 END FOR m IN {_MONTHS}], CAST(article_volume AS DOUBLE)) AS x
      FROM e WHERE em BETWEEN -24 AND 24),
    mean_i AS (SELECT company_id, list(v ORDER BY i) AS mx FROM (SELECT company_id, i, avg(x[i]) AS v FROM r, range(1, {len(_EVENT) + 1}) a(i) GROUP BY 1, 2) GROUP BY 1),
    w AS (SELECT date, y - avg(y) OVER (PARTITION BY company_id) AS y, list_transform(x, lambda v, i: v - mx[i]) AS x FROM r JOIN mean_i USING (company_id)),
    {least_squares(len(_EVENT), cluster="date")}
    SELECT *, regexp_replace(variable, '^event_', '') AS month_label FROM ({frame(_EVENT, True)})""",
    CLUSTER_DOUBLES,
)
def _(t: Tables):
    return regression.event_study(panel(t), -24, 24, -1, 1998)


_RETURN_ROWS = "full_rows AS (SELECT * FROM filled WHERE daily_return IS NOT NULL AND sp500_return IS NOT NULL AND vix IS NOT NULL)"
_RETURN_X = ["post", "sp500_return", "vix"]


def _return_model(two_way: bool) -> str:
    """The within form of the return model in SQL, with its fit."""

    def net(c: str) -> str:
        return f"{c} - avg({c}) OVER e" + (f" - (avg({c}) OVER d - avg({c}) OVER ())" if two_way else "")

    xs = ", ".join(net(c) for c in _RETURN_X)
    days = ", d AS (PARTITION BY date)" if two_way else ""
    return f"""WITH RECURSIVE {RETURN_PANEL}, {_RETURN_ROWS},
    w AS (SELECT {net("daily_return")} AS y, [{xs}] AS x FROM full_rows WINDOW e AS (PARTITION BY ticker){days}),
    {least_squares(3)} {frame(_RETURN_X)}"""


@query("return_model_firm_effects", _return_model(False), FRAME_DOUBLES)
def _(t: Tables):
    return regression.return_model(return_panel(t)).frame()


@query("return_model_two_way", _return_model(True), FRAME_DOUBLES)
def _(t: Tables):
    return regression.return_model(return_panel(t), time_fe=True).frame()


@query(
    "did_stance_absorbed",
    f"""WITH RECURSIVE d AS (SELECT a.company_id, a.media_outlet_id, strftime(published_at, '%Y-%m') AS year_month,
      coalesce(pos_score, 0) - coalesce(neg_score, 0) AS bias_score, CASE WHEN year(published_at) >= 2020 THEN exposure ELSE 0 END AS post_x_exposure
      FROM {{articles}} a JOIN {{companies}} c ON c.id = a.company_id),
    {absorbed("d", "bias_score", "post_x_exposure", ["company_id", "media_outlet_id"], "year_month")}, {least_squares(1, "hc0")} {frame(["post_x_exposure"])}""",
    FRAME_DOUBLES,
)
def _(t: Tables):
    c = t.companies.select(F.col("id").alias("company_id"), "exposure")
    rows = filters.did_features(t.articles.join(c, "company_id"))
    return regression.continuous_did(rows, "bias_score", "post_x_exposure", ["company_id", "media_outlet_id", "year_month"]).frame()


@query(
    "did_returns_absorbed",
    f"""WITH RECURSIVE {RETURN_PANEL}, d AS (SELECT ticker, date, daily_return, post * ((CAST(substr(ticker, 2) AS INTEGER) % 5 + 1) / 5.0) AS px FROM filled),
    {absorbed("d", "daily_return", "px", ["ticker"], "date")}, {least_squares(1, "hc0")} {frame(["post_x_exposure"])}""",
    FRAME_DOUBLES,
)
def _(t: Tables):
    rows = return_panel(t).withColumn("exposure", (F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % 5 + 1) / 5)
    rows = rows.withColumn("post_x_exposure", F.col("post") * F.col("exposure"))
    return regression.continuous_did(rows, "daily_return", "post_x_exposure", ["ticker", "date"]).frame()


@query(
    "residual_diagnostics",
    f"""WITH {WITHIN}, {SOLVED}, z AS (SELECT avg(u) AS m, stddev_samp(u) AS sd, count(*) AS n FROM u),
    h AS (SELECT avg(pow(u - m, 2)) AS m2, avg(pow(u - m, 3)) AS m3, avg(pow(u - m, 4)) AS m4 FROM u, z),
    s AS (SELECT sum(d * d) AS ss FROM (SELECT u - lag(u) OVER (ORDER BY company_id, date) AS d FROM u))
    SELECT n AS n_obs, m AS residual_mean, sd AS residual_std, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurtosis,
      n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jarque_bera, ss / (SELECT sse FROM meat) AS durbin_watson
    FROM z, h, s""",
    "residual_mean residual_std skew kurtosis jarque_bera durbin_watson",
)
def _(t: Tables):
    out = regression.assumption_checks(panel(t), "daily_stance", ["post", "article_volume"], "company_id", "date")
    return out.select("n_obs", "residual_mean", "residual_std", "skew", "kurtosis", "jarque_bera", "durbin_watson")


@query("regression_assumption_checks")
def _(t: Tables):
    return regression.assumption_checks(return_panel(t), "daily_return", ["post", "sp500_return", "vix"], "ticker", "date")


_SYNTHETIC = f"WITH RECURSIVE {RETURN_PANEL}, {_RETURN_ROWS}, {synthetic_effects('full_rows')}"


@query("synthetic_control_effects", f"{_SYNTHETIC} SELECT firm, effect FROM effects", "effect")
def _(t: Tables):
    return regression.synthetic_effects(return_panel(t))


@query(
    "synthetic_control_did",
    f"""{_SYNTHETIC}, s AS (SELECT count(effect) AS n, avg(effect) AS m, stddev_samp(effect) / sqrt(count(effect)) AS se FROM effects)
    SELECT n AS n_firms_used, m AS avg_post_effect, se AS se_across_firms, m - 1.96 * se AS ci95_low, m + 1.96 * se AS ci95_high FROM s""",
    "avg_post_effect se_across_firms ci95_low ci95_high",
)
def _(t: Tables):
    return regression.synthetic_did(return_panel(t))


# --- time series ---------------------------------------------------------------------------------------------------

BIAS, RET = "simple_mean_stance", "weekly_log_return"
# the aligned weekly panel of the dense firms
WEEKS = f"{ALIGNED}, weeks AS (SELECT ticker, week_monday, simple_mean_stance, n_articles, weekly_log_return FROM aligned WHERE side = 'both')"


def weeks(t: Tables):
    return aligned(t).filter("side = 'both'").select("ticker", "week_monday", BIAS, "n_articles", RET)


def week_panel(t: Tables):
    """Winsorised, differenced and break-flagged weekly panel; stored once because every test reads it several times."""
    clipped, _ = ts.winsorise(checkpointed(weeks(t)), RET, exclude=("F0",))
    panel = ts.difference(clipped, [BIAS, RET])
    breaks = ts.break_table(panel, BIAS, RET)
    return checkpointed(ts.flag_post(panel, breaks))


@query(
    "weekly_lags",
    f"""WITH {WEEKS} SELECT ticker, week_monday, lag(simple_mean_stance, 1) OVER w AS simple_mean_stance_l1,
      lag(simple_mean_stance, 2) OVER w AS simple_mean_stance_l2 FROM weeks WINDOW w AS (PARTITION BY ticker ORDER BY week_monday)""",
    "simple_mean_stance_l1 simple_mean_stance_l2",
)
def _(t: Tables):
    out = ts.lags(weeks(t), [BIAS], 2)
    return out.select("ticker", "week_monday", *[F.col(f"{BIAS}_L{i}").alias(f"{BIAS}_l{i}") for i in (1, 2)])


@query(
    "weekly_differences",
    f"""WITH {WEEKS} SELECT ticker, week_monday, simple_mean_stance - lag(simple_mean_stance) OVER w AS d_simple_mean_stance,
      weekly_log_return - lag(weekly_log_return) OVER w AS d_weekly_log_return FROM weeks WINDOW w AS (PARTITION BY ticker ORDER BY week_monday)""",
    "d_simple_mean_stance d_weekly_log_return",
)
def _(t: Tables):
    return ts.difference(weeks(t), [BIAS, RET]).select("ticker", "week_monday", f"d_{BIAS}", f"d_{RET}")


WINSOR = f"""{WEEKS}, bounds AS (SELECT ticker, avg(weekly_log_return) AS m, stddev_samp(weekly_log_return) AS s FROM weeks GROUP BY 1),
  clipped AS (SELECT w.ticker, week_monday, weekly_log_return AS raw, CASE WHEN w.ticker = 'F0' THEN weekly_log_return
    ELSE greatest(least(weekly_log_return, m + 2 * s), m - 2 * s) END AS weekly_log_return FROM weeks w JOIN bounds b ON b.ticker = w.ticker)"""


@query("winsorised_returns", f"WITH {WINSOR} SELECT ticker, week_monday, weekly_log_return FROM clipped", "weekly_log_return")
def _(t: Tables):
    return ts.winsorise(weeks(t), RET, 2.0, ("F0",))[0].select("ticker", "week_monday", RET)


@query(
    "winsor_counts",
    f"""WITH {WINSOR} SELECT ticker, stddev_samp(raw) AS raw_std, count(*) FILTER (raw <> weekly_log_return) AS winsor_count,
      CASE WHEN ticker = 'F0' THEN 'skipped' WHEN count(*) FILTER (raw <> weekly_log_return) > 0 THEN 'winsorised' ELSE 'no outliers' END AS status
    FROM clipped GROUP BY 1""",
    "raw_std",
)
def _(t: Tables):
    return ts.winsorise(weeks(t), RET, 2.0, ("F0",))[1]


@query(
    "helmert_differences",
    f"""WITH {WEEKS} SELECT ticker, week_monday, sqrt(k / (k + 1.0)) * (simple_mean_stance - m1) AS simple_mean_stance,
      sqrt(k / (k + 1.0)) * (weekly_log_return - m2) AS weekly_log_return FROM
      (SELECT *, count(*) OVER f AS k, avg(simple_mean_stance) OVER f AS m1, avg(weekly_log_return) OVER f AS m2 FROM weeks
       WINDOW f AS (PARTITION BY ticker ORDER BY week_monday ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""",
    "simple_mean_stance weekly_log_return",
)
def _(t: Tables):
    return ts.helmert(weeks(t), [BIAS, RET]).select("ticker", "week_monday", BIAS, RET)


BREAKS = f"""{WEEKS}, pre AS (SELECT ticker, week_monday, row_number() OVER w - 1 AS k, count(*) OVER f AS n,
    sum(simple_mean_stance) OVER w - simple_mean_stance AS s, sum(simple_mean_stance) OVER f AS st,
    sum(simple_mean_stance * simple_mean_stance) OVER f AS q FROM weeks
  WINDOW w AS (PARTITION BY ticker ORDER BY week_monday), f AS (PARTITION BY ticker)),
cost AS (SELECT *, q - s * s / k - (st - s) * (st - s) / (n - k) AS sse FROM pre WHERE k >= 52 AND n - k >= 52),
brk AS (SELECT ticker, arg_min(k, sse) AS break_index, arg_min(week_monday, sse) AS break_date, arg_min(n, sse) AS n, min(sse) AS sse
  FROM cost GROUP BY 1)"""


@query(
    "mean_break",
    f"WITH {BREAKS} SELECT ticker, break_index, break_date, break_index AS pre_obs, n - break_index AS post_obs, sse FROM brk",
    "sse",
)
def _(t: Tables):
    return ts.mean_break(weeks(t), BIAS)


@query(
    "post_break_flags",
    f"""WITH {BREAKS} SELECT w.ticker, w.week_monday, coalesce(w.week_monday >= break_date, false) AS is_post_break FROM weeks w
    LEFT JOIN brk ON brk.ticker = w.ticker""",
)
def _(t: Tables):
    w = checkpointed(weeks(t))
    return ts.flag_post(w, ts.break_table(w, BIAS, RET)).select("ticker", "week_monday", "is_post_break")


@query(
    "break_table",
    f"""WITH {BREAKS}, {BREAKS[len(WEEKS) + 2:].replace('simple_mean_stance', 'weekly_log_return').replace('pre AS', 'pre2 AS').replace('FROM pre ', 'FROM pre2 ').replace('cost AS', 'cost2 AS').replace('FROM cost', 'FROM cost2').replace('brk AS', 'brk2 AS')},
    c AS (SELECT ticker, count(*) AS weeks FROM weeks GROUP BY 1)
    SELECT c.ticker, coalesce(b.break_index, weeks) AS pre_obs, coalesce(b.n - b.break_index, 0) AS post_obs, b.break_date AS bias_break_date,
      r.break_date AS return_break_date, coalesce(b.break_index, weeks) >= 60 AND coalesce(b.n - b.break_index, 0) >= 60 AS is_valid_split
    FROM c LEFT JOIN brk b ON b.ticker = c.ticker LEFT JOIN brk2 r ON r.ticker = c.ticker""",
)
def _(t: Tables):
    return ts.break_table(checkpointed(weeks(t)), BIAS, RET)


@query("adf_tests")
def _(t: Tables):
    return ts.adf(ts.long_series(week_panel(t), [BIAS, RET, f"d_{BIAS}", f"d_{RET}"]))


# the series of the tests: stance and returns clipped at five deviations, and their differences, as one list each
SERIES = f"""{WINSOR.replace('m + 2 * s', 'm + 5 * s').replace('m - 2 * s', 'm - 5 * s')},
  paired AS (SELECT w.ticker, w.week_monday, w.simple_mean_stance AS a, c.weekly_log_return AS b FROM weeks w JOIN clipped c USING (ticker, week_monday)),
  steps AS (SELECT *, a - lag(a) OVER o AS da, b - lag(b) OVER o AS db FROM paired WINDOW o AS (PARTITION BY ticker ORDER BY week_monday)),
  tall AS (SELECT ticker, week_monday, unnest(['{BIAS}', '{RET}', 'd_{BIAS}', 'd_{RET}']) AS variable, unnest([a, b, da, db]) AS y FROM steps),
  series AS (SELECT ticker, variable, list(y ORDER BY week_monday) AS y, count(*) AS n FROM tall WHERE y IS NOT NULL GROUP BY 1, 2)"""


def _interpolated(x: str, xs: list[float], ys: list[float]) -> str:
    """Linear interpolation between fixed points, level beyond them."""
    inner = " ".join(f"WHEN {x} <= {b} THEN {p} + ({q} - {p}) * ({x} - {a}) / ({b} - {a})" for a, b, p, q in zip(xs, xs[1:], ys, ys[1:]))
    return f"CASE WHEN {x} <= {xs[0]} THEN {ys[0]} {inner} ELSE {ys[-1]} END"


@query(
    "kpss_tests",
    f"""WITH {SERIES}, slope AS (SELECT *, list_avg(y) AS my, list_sum([(i - (n + 1) / 2.0) * y[i] FOR i IN range(1, n + 1)])
        / list_sum([(i - (n + 1) / 2.0) * (i - (n + 1) / 2.0) FOR i IN range(1, n + 1)]) AS b FROM series),
    rest AS (SELECT ticker, variable, n, 'c' AS spec, [v - my FOR v IN y] AS e FROM slope
      UNION ALL SELECT ticker, variable, n, 'ct', [y[i] - my - b * (i - (n + 1) / 2.0) FOR i IN range(1, n + 1)] FROM slope),
    moved AS (SELECT *, list_sum([e[i] * e[i + l] FOR i IN range(1, n - l + 1)]) AS c FROM (SELECT *, unnest(range(0, n)) AS l FROM rest)),
    level AS (SELECT ticker, variable, spec, any_value(n) AS n, any_value(e) AS e, sum(c) FILTER (l = 0) AS g0,
      sum(c) FILTER (l = 0) / any_value(n) + sum(c / (n / 2.0)) FILTER (l BETWEEN 1 AND greatest(floor(pow(n, 2 / 9.0)), 1)) AS s0,
      sum(l * c / (n / 2.0)) FILTER (l BETWEEN 1 AND greatest(floor(pow(n, 2 / 9.0)), 1)) AS s1 FROM moved GROUP BY 1, 2, 3),
    chosen AS (SELECT *, least(CAST(floor(1.1447 * pow(pow(s1 / s0, 2), 1 / 3.0) * pow(n, 1 / 3.0)) AS BIGINT), n - 1) AS lags FROM level),
    tested AS (SELECT chosen.ticker, chosen.variable, chosen.spec, any_value(chosen.n) AS n_obs, any_value(lags) AS lags,
      list_sum(any_value([pow(list_sum(chosen.e[1:t]), 2) FOR t IN range(1, chosen.n + 1)])) / any_value(chosen.n)
        / (any_value(g0) + coalesce(2 * sum(c * (1 - l / (lags + 1.0))) FILTER (l BETWEEN 1 AND lags), 0)) AS stat
      FROM chosen JOIN moved ON moved.ticker = chosen.ticker AND moved.variable = chosen.variable AND moved.spec = chosen.spec GROUP BY 1, 2, 3)
    SELECT ticker, variable, spec, stat, CASE WHEN spec = 'c' THEN {_interpolated("stat", fv.KPSS_POINTS["c"], fv.KPSS_P)}
      ELSE {_interpolated("stat", fv.KPSS_POINTS["ct"], fv.KPSS_P)} END AS p_value, lags, n_obs FROM tested""",
    "stat p_value",
)
def _(t: Tables):
    return ts.kpss(ts.long_series(week_panel(t), [BIAS, RET, f"d_{BIAS}", f"d_{RET}"]))


def _verdicts(t: Tables):
    series = ts.long_series(week_panel(t), [BIAS, RET, f"d_{BIAS}", f"d_{RET}"])
    return ts.stationarity_verdict(ts.adf(series), ts.kpss(series))


@query("stationarity_verdicts")
def _(t: Tables):
    return _verdicts(t)


@query("integration_orders")
def _(t: Tables):
    return ts.integration_order(_verdicts(t))


@query("johansen_tests")
def _(t: Tables):
    return ts.johansen(week_panel(t), BIAS, RET)


@query("var_lag_orders")
def _(t: Tables):
    return ts.var_order(week_panel(t), BIAS, RET)


@query("var_stability")
def _(t: Tables):
    panel = week_panel(t)
    return ts.var_fit(panel, ts.var_order(panel, BIAS, RET), BIAS, RET).drop("coef_a", "coef_b")


@query("var_diagnostics")
def _(t: Tables):
    panel = week_panel(t)
    fit = checkpointed(ts.var_fit(panel, ts.var_order(panel, BIAS, RET), BIAS, RET))
    return ts.var_diagnostics(panel, fit, BIAS, RET)


def _granger(t: Tables):
    panel = week_panel(t)
    return ts.granger(panel, BIAS, RET, checkpointed(ts.var_order(panel, BIAS, RET)))


@query("granger_tests")
def _(t: Tables):
    return _granger(t)


@query("granger_table")
def _(t: Tables):
    return ts.granger_table(_granger(t))


@query("panel_granger_tests")
def _(t: Tables):
    panel = week_panel(t).join(checkpointed(returns.weekly_market(t.market, t.vix)), "week_monday", "left")
    panel = panel.withColumn("is_post", F.col("is_post_break").cast("double"))
    return ts.panel_granger(panel, f"d_{BIAS}", RET, ["is_post", "vix", "market_return", "n_articles"])

"""Stationarity, breaks, VAR and Granger tests over many firms at once.

Series are sorted rows per firm with one row per week, so windows per firm are bounded by the calendar. Rows stay in
Spark; each test reduces them to cross-product sums per firm, and only those sums are solved in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..fixed_values import JOHANSEN_TRACE_95
from ..functions.distributions import chi2_sf, f_sf, kpss_p, mackinnon_5pct, mackinnon_p
from ..functions.text import stars
from ..moments import gram, moving_sums, unpack
from ..scale import rank_in_group
from ..session import BREAK_MIN_SIZE, MAX_VAR_LAGS, MIN_SUBSAMPLE, PANEL_LAGS, WINSOR_SDS


def _ordered(by: list[str], time: str):
    return W.partitionBy(*by).orderBy(time)


# --- transformations -----------------------------------------------------------------------------------------------


def lags(df: DataFrame, cols: list[str], p: int, by: str = "ticker", time: str = "week_monday") -> DataFrame:
    """Columns ``<col>_L1`` .. ``<col>_Lp``, by row inside each firm."""
    w = _ordered([by], time)
    return df.withColumns({f"{c}_L{i}": F.lag(c, i).over(w) for c in cols for i in range(1, p + 1)})


def difference(df: DataFrame, cols: list[str], by: str = "ticker", time: str = "week_monday") -> DataFrame:
    w = _ordered([by], time)
    return df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in cols})


def winsorise(
    df: DataFrame, col: str, k: float = WINSOR_SDS, exclude: tuple = (), by: str = "ticker"
) -> tuple[DataFrame, DataFrame]:
    """Clip at mean +/- k standard deviations per firm; also the number of clipped rows per firm."""
    stats = df.groupBy(by).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    skipped = F.col(by).isin(*exclude) if exclude else F.lit(False)
    open_ = skipped | F.col("_s").isNull() | (F.col("_s") == 0)
    lo, hi, x = F.col("_m") - k * F.col("_s"), F.col("_m") + k * F.col("_s"), F.col(col)
    out = df.join(stats, by).withColumn(f"{col}_raw", x).withColumn("_out", ~open_ & ((x < lo) | (x > hi)))
    counts = out.groupBy(by).agg(
        F.max("_s").alias("raw_std"),
        F.count_if("_out").alias("winsor_count"),
        F.when(F.max(skipped), "skipped").when(F.count_if("_out") > 0, "winsorised").otherwise("no outliers").alias("status"),
    )
    clipped = F.when(open_ | x.isNull(), x).otherwise(F.greatest(F.least(x, hi), lo))
    return out.withColumn(col, clipped).drop("_m", "_s", "_out"), counts


def _helmert(cols: list[str], by: list[str], time: str) -> dict[str, Column]:
    """Forward mean-differenced columns; the mean of the later rows is the total less the running sum."""
    w, whole = _ordered(by, time), W.partitionBy(*by)
    left = F.count(F.lit(1)).over(whole) - F.row_number().over(w)
    ahead = lambda c: (F.sum(c).over(whole) - F.sum(c).over(w)) / left
    return {c: F.when(left > 0, F.sqrt(left / (left + 1)) * (F.col(c) - ahead(c))) for c in cols}


def helmert(df: DataFrame, cols: list[str], by: str = "ticker", time: str = "week_monday") -> DataFrame:
    """Forward mean-differencing; rows with a null must be dropped before, the last row of a firm becomes null."""
    return df.withColumns(_helmert(cols, [by], time))


def mean_break(
    df: DataFrame, col: str, min_size: int = BREAK_MIN_SIZE, by: str = "ticker", time: str = "week_monday"
) -> DataFrame:
    """Single change in mean minimising the squared error; no row for firms shorter than two segments."""
    w, all_ = _ordered([by], time), W.partitionBy(by)
    x = F.col(col)
    rows = df.select(
        by, time, F.row_number().over(w).alias("_i"), F.count(F.lit(1)).over(all_).alias("_n"),
        (F.sum(x).over(w) - x).alias("_s"), F.sum(x).over(all_).alias("_total"), F.sum(x * x).over(all_).alias("_squares"),
    )
    k = F.col("_i") - 1  # rows before this one, so this row would open the second regime
    cost = F.col("_squares") - F.col("_s") * F.col("_s") / k - (F.col("_total") - F.col("_s")) ** 2 / (F.col("_n") - k)
    rows = rows.filter((k >= min_size) & (F.col("_n") - k >= min_size)).withColumn("_k", k).withColumn("_c", cost)
    best = rows.groupBy(by).agg(F.min(F.struct("_c", "_k", time, "_n")).alias("b"))
    return best.select(
        by,
        F.col("b._k").cast("long").alias("break_index"),
        F.col(f"b.{time}").alias("break_date"),
        F.col("b._k").cast("long").alias("pre_obs"),
        (F.col("b._n") - F.col("b._k")).alias("post_obs"),
        F.col("b._c").alias("sse"),
    )


def break_table(
    df: DataFrame, bias: str, ret: str, min_size: int = BREAK_MIN_SIZE, minimum: int = MIN_SUBSAMPLE, by: str = "ticker", time: str = "week_monday"
) -> DataFrame:
    """Break dates of both series; the first one is the primary break and decides whether the split is valid."""
    base = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    b = mean_break(df, bias, min_size, by, time).select(by, F.col("break_date").alias("bias_break_date"), "pre_obs", "post_obs")
    r = mean_break(df, ret, min_size, by, time).select(by, F.col("break_date").alias("return_break_date"))
    out = base.join(b, by, "left").join(r, by, "left")
    out = out.withColumn("pre_obs", F.coalesce("pre_obs", "_n")).withColumn("post_obs", F.coalesce("post_obs", F.lit(0))).drop("_n")
    return out.withColumn("is_valid_split", (F.col("pre_obs") >= minimum) & (F.col("post_obs") >= minimum))


def flag_post(df: DataFrame, breaks: DataFrame, date: str = "bias_break_date", by: str = "ticker", time: str = "week_monday") -> DataFrame:
    cut = breaks.select(by, F.col(date).alias("_cut"))
    return df.join(cut, by, "left").withColumn("is_post_break", F.coalesce(F.col(time) >= F.col("_cut"), F.lit(False))).drop("_cut")


def long_series(df: DataFrame, cols: list[str], by: str = "ticker", time: str = "week_monday") -> DataFrame:
    """(firm, variable, pos, y): the non-null values of several columns with their position in time."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("y")) for c in cols]))
    rows = df.select(by, time, parts.alias("_p")).select(by, time, "_p.*").filter(F.col("y").isNotNull())
    return rows.withColumn("pos", F.row_number().over(_ordered([by, "variable"], time))).drop(time)


# --- small solves --------------------------------------------------------------------------------------------------


def _solved(fn: Callable, x, width: int) -> list[tuple]:
    """fn's rows; one row of nulls where a firm's numbers allow no result, so that the other firms have theirs."""
    try:
        with np.errstate(all="ignore"):
            rows = list(fn(x))
    except (np.linalg.LinAlgError, ZeroDivisionError, OverflowError):
        rows = [(None,) * width]
    return [tuple(None if isinstance(v, (float, np.floating)) and not np.isfinite(v) else v for v in r) for r in rows]


def _full_rank(m: np.ndarray) -> bool:
    """Whether no column behind the moments is constant, or a combination of the others."""
    size = np.sqrt(np.clip(np.diag(m), 0, None))
    if not np.isfinite(m).all() or (size <= 0).any():
        return False
    return bool(np.linalg.eigvalsh(m / np.outer(size, size)).min() > 1e-12)


def _per_row(df: DataFrame, keys: list[str], fn: Callable, out: str) -> DataFrame:
    """Apply fn(row) -> iterable of tuples to every aggregated row."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    names = keys + [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*[getattr(r, k) for k in keys], *t) for r in pdf.itertuples(index=False) for t in _solved(fn, r, len(names) - len(keys))]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, f"{types}, {out}")


def _per_group(df: DataFrame, keys: list[str], fn: Callable, out: str) -> DataFrame:
    """Apply fn(frame) to the few aggregated rows of each group."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    names = keys + [c.split()[0] for c in out.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = tuple(pdf[k].iloc[0] for k in keys)
        return pd.DataFrame([(*head, *t) for t in _solved(fn, pdf, len(names) - len(keys))], columns=names)

    return df.groupBy(*keys).applyInPandas(run, f"{types}, {out}")


def _partial(m: np.ndarray, on: list[int], of: list[int]) -> np.ndarray:
    """Moments of ``of`` after regressing them on ``on``."""
    a, b = m[np.ix_(on, on)], m[np.ix_(on, of)]
    return m[np.ix_(of, of)] - b.T @ np.linalg.pinv(a) @ b


# --- unit roots ----------------------------------------------------------------------------------------------------


def adf(series: DataFrame, maxlag: int = 12, by: str = "ticker") -> DataFrame:
    """Augmented Dickey-Fuller tests without constant (n), with constant (c) and with trend (ct); lag by AIC.

    ``series`` is the output of ``long_series``. Sums are kept per number of available lags, so that the common sample
    of the lag search and the longest sample of the final fit come from the same pass.
    """
    keys = [by, "variable"]
    w = _ordered(keys, "pos")
    d = series.withColumn("_d", F.col("y") - F.lag("y").over(w)).withColumn("_l", F.lag("y").over(w))
    d = d.withColumns({f"_d{i}": F.lag("_d", i).over(w) for i in range(1, maxlag + 1)}).filter(F.col("pos") > 1)
    d = d.withColumn("_have", F.least(F.col("pos") - 2, F.lit(maxlag)))
    zero = [F.coalesce(f"_d{i}", F.lit(0.0)) for i in range(1, maxlag + 1)]
    cols = [F.lit(1.0), F.col("pos") / 100, F.col("_l"), *zero, F.col("_d")]
    sums = gram(d, [*keys, "_have"], cols)

    def solve(pdf: pd.DataFrame):
        k = maxlag + 4
        parts = {int(h): (n, unpack(g, k)) for h, n, g in zip(pdf["_have"], pdf["n"], pdf["g"])}

        def sample(p: int):
            picked = [v for h, v in parts.items() if h >= p]
            return sum(n for n, _ in picked), sum((m for _, m in picked), np.zeros((k, k)))

        for trend, det in (("n", []), ("c", [0]), ("ct", [0, 1])):
            n, m = sample(maxlag)
            if n <= len(det) + maxlag + 2:
                yield trend, None, None, None, None, None
                continue
            scores = []
            for p in range(maxlag + 1):
                use = det + [2] + list(range(3, 3 + p))
                sse = _partial(m, use, [k - 1])[0, 0]
                scores.append(n * np.log(sse / n) + 2 * len(use) if sse > 0 else np.inf)
            p = int(np.argmin(scores))
            n, m = sample(p)
            use = det + [2] + list(range(3, 3 + p))
            inv = np.linalg.pinv(m[np.ix_(use, use)])
            beta = inv @ m[use, k - 1]
            sse = m[k - 1, k - 1] - beta @ m[use, k - 1]
            at = len(det)
            if not sse > 1e-20 * m[k - 1, k - 1] or not _full_rank(m[np.ix_(use, use)]):
                yield trend, None, None, None, None, None
                continue
            stat = float(beta[at] / np.sqrt(sse / (n - len(use)) * inv[at, at]))
            yield trend, stat, mackinnon_p(stat, trend), p, int(n), mackinnon_5pct(trend, int(n))

    return _per_group(sums, keys, solve, "spec string, stat double, p_value double, lags long, n_obs long, crit_5pct double")


def kpss(series: DataFrame, by: str = "ticker") -> DataFrame:
    """KPSS tests around a level (c) and a trend (ct) with the data-dependent lag of Hobijn and others (1998).

    One pass: a series has one value per position, as many as the calendar has weeks, and is read as one array.
    """
    keys = [by, "variable"]
    rows = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("y").cast("double").alias("y")))).alias("s"))

    def solve(r):
        pos, y = np.array([v["pos"] for v in r.s], float), np.array([v["y"] for v in r.s], float)
        n, centred = len(y), pos - pos.mean()
        level = y - y.mean()
        slope = (centred @ level) / (centred @ centred) if n > 1 else 0.0
        for spec, e in (("c", level), ("ct", level - slope * centred)):
            g0 = float(e @ e)
            if not g0 > 1e-20 * float(y @ y):  # a constant, or an exact trend
                yield (spec,) + (None,) * 4
                continue
            # products of values a lag apart; a position without a value adds nothing
            dense = np.zeros(int(pos[-1] - pos[0]) + 1)
            dense[(pos - pos[0]).astype(int)] = e
            cov = lambda l: float(dense[l:] @ dense[: len(dense) - l]) if l < len(dense) else 0.0
            first = [cov(l) / (n / 2) for l in range(1, max(1, int(n ** (2 / 9))) + 1)]
            s0, s1 = g0 / n + sum(first), sum(l * c for l, c in enumerate(first, 1))
            if s0 == 0:
                yield (spec,) + (None,) * 4
                continue
            lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
            if lags <= 0 and n < 2:
                yield (spec,) + (None,) * 4
                continue
            v = g0 + 2 * sum(cov(l) * (1 - l / (lags + 1)) for l in range(1, lags + 1))
            stat = float((np.cumsum(e) ** 2).sum() / n**2 / (v / n))
            yield spec, stat, kpss_p(stat, spec), int(lags), n

    return _per_row(rows, keys, solve, "spec string, stat double, p_value double, lags long, n_obs long")


def stationarity_verdict(adf_result: DataFrame, kpss_result: DataFrame, by: str = "ticker", alpha: float = 0.05) -> DataFrame:
    """Joint reading of the two tests with a constant."""
    keys = [by, "variable"]
    a = adf_result.filter("spec = 'c'").select(*keys, F.col("p_value").alias("adf_p"))
    k = kpss_result.filter("spec = 'c'").select(*keys, F.col("p_value").alias("kpss_p"))
    unit, level = F.col("adf_p") < alpha, F.col("kpss_p") < alpha
    verdict = (
        F.when(F.col("adf_p").isNull() | F.col("kpss_p").isNull(), "Unknown")
        .when(unit & ~level, "Stationary (I(0))")
        .when(~unit & level, "Non-Stationary (I(1) / Unit Root)")
        .when(unit & level, "Conflicting (Structural Break Likely)")
        .otherwise("Ambiguous (Low Power)")
    )
    return a.join(k, keys, "full").withColumn("conclusion", verdict)


def integration_order(verdicts: DataFrame, by: str = "ticker") -> DataFrame:
    """I(0) if the level is stationary, I(1) if its difference ``d_<variable>`` is, else higher."""
    ok = F.col("conclusion") == "Stationary (I(0))"
    base = F.regexp_replace("variable", "^d_", "")
    return verdicts.groupBy(by, base.alias("series")).agg(
        F.when(F.max(F.when(~F.col("variable").startswith("d_"), ok)), "I(0)")
        .when(F.max(F.when(F.col("variable").startswith("d_"), ok)), "I(1)")
        .otherwise("I(2) or higher")
        .alias("integration_order")
    )


# --- two-variable systems ------------------------------------------------------------------------------------------


def _pairs(df: DataFrame, a: str, b: str, by: list[str], time: str) -> DataFrame:
    rows = df.select(*by, time, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna(subset=["a", "b"])
    return rows.withColumn("pos", F.row_number().over(_ordered(by, time)))


def johansen(df: DataFrame, a: str, b: str, by: str = "ticker", time: str = "week_monday", minimum: int = 50) -> DataFrame:
    """Trace test for two series with a constant and one lagged difference."""
    w = _ordered([by], time)
    rows = _pairs(df, a, b, [by], time)
    rows = rows.withColumns({f"d{c}": F.col(c) - F.lag(c).over(w) for c in "ab"})
    rows = rows.withColumns({f"l{c}": F.lag(c).over(w) for c in "ab"}).withColumns({f"z{c}": F.lag(f"d{c}").over(w) for c in "ab"})
    sums = gram(rows.filter("pos > 2"), [by], [F.lit(1.0), "za", "zb", "da", "db", "la", "lb"])

    def solve(r):
        n = int(r.n)
        g = unpack(r.g, 7)
        if n + 2 < minimum or not all(_full_rank(g[np.ix_(i, i)]) for i in ([0, 1, 2, 3, 4], [0, 1, 2, 5, 6])):
            yield (None,) * 5
            return
        m = _partial(g, [0, 1, 2], [3, 4, 5, 6])
        s00, s01, s11 = m[:2, :2], m[:2, 2:], m[2:, 2:]
        eig = np.linalg.eigvals(np.linalg.inv(s11) @ s01.T @ np.linalg.inv(s00) @ s01)
        lam = np.sort(np.clip(eig.real, 0, 1 - 1e-15))[::-1]
        trace = [-n * float(np.log(1 - lam[i:]).sum()) for i in range(2)]
        yield trace[0], JOHANSEN_TRACE_95[0], trace[1], JOHANSEN_TRACE_95[1], bool(trace[0] > JOHANSEN_TRACE_95[0])

    return _per_row(sums, [by], solve, "trace_r0 double, cv_r0_95 double, trace_r1 double, cv_r1_95 double, cointegrated_95 boolean")


def cointegration(df: DataFrame, orders: DataFrame, a: str, b: str, by: str = "ticker", time: str = "week_monday") -> DataFrame:
    """Johansen test for the firms whose two series are both integrated of order one."""
    both = orders.filter(F.col("series").isin(a, b) & (F.col("integration_order") == "I(1)")).groupBy(by).agg(F.count(F.lit(1)).alias("_c"))
    return johansen(df.join(both.filter("_c = 2"), by, "left_semi"), a, b, by, time)


def _lagged_pair(rows: DataFrame, by: list[str], p: int, order: str = "pos") -> tuple[DataFrame, list[str]]:
    """Lag columns a1, b1, ... ap, bp with zero where a lag does not exist."""
    w = _ordered(by, order)
    names = [f"{c}{i}" for i in range(1, p + 1) for c in "ab"]
    return rows.withColumns({n: F.coalesce(F.lag(n[0], int(n[1:])).over(w), F.lit(0.0)) for n in names}), names


def var_order(df: DataFrame, a: str, b: str, max_lags: int = MAX_VAR_LAGS, minimum: int = 50, by: str = "ticker", time: str = "week_monday") -> DataFrame:
    """Lag orders by AIC and BIC on the common sample; the chosen one is BIC, at least 1."""
    rows, names = _lagged_pair(_pairs(df, a, b, [by], time), [by], max_lags)
    sums = gram(rows.filter(F.col("pos") > max_lags), [by], [F.lit(1.0), *names, "a", "b"])

    def solve(r):
        n, k = int(r.n), 2 * max_lags + 3
        m = unpack(r.g, k)
        if n + max_lags < minimum or not _full_rank(m):
            yield None, None, None, n + max_lags
            return
        aic, bic = [], []
        for p in range(max_lags + 1):
            sigma = _partial(m, list(range(1 + 2 * p)), [k - 2, k - 1]) / n
            ld, free = np.linalg.slogdet(sigma)[1], 4 * p + 2
            aic.append(ld + 2 / n * free)
            bic.append(ld + np.log(n) / n * free)
        ia, ib = int(np.argmin(aic)), int(np.argmin(bic))
        yield ia, ib, max(ib, 1), n + max_lags

    return _per_row(sums, [by], solve, "aic_lag long, bic_lag long, chosen_lag long, n_obs long")


def _fit_rows(df: DataFrame, orders: DataFrame, a: str, b: str, by: str, time: str, max_lags: int):
    rows, names = _lagged_pair(_pairs(df, a, b, [by], time), [by], max_lags)
    rows = rows.join(orders.select(by, F.col("chosen_lag").alias("p")), by).filter(F.col("pos") > F.col("p"))
    return rows, names


def _var_moments(rows: DataFrame, names: list[str], by: str) -> DataFrame:
    return gram(rows, [by, "p"], [F.lit(1.0), *names, "a", "b"])


def _companion(coef: np.ndarray, p: int) -> np.ndarray:
    top = coef[1 : 1 + 2 * p].T
    return np.vstack([top, np.eye(2 * (p - 1), 2 * p)]) if p > 1 else top


def var_fit(
    df: DataFrame, orders: DataFrame, a: str, b: str, by: str = "ticker", time: str = "week_monday", max_lags: int = MAX_VAR_LAGS
) -> DataFrame:
    """Coefficients of both equations (constant, then lag by lag), stability and smallest root modulus."""
    rows, names = _fit_rows(df, orders, a, b, by, time, max_lags)

    def solve(r):
        p, k = int(r.p), 2 * max_lags + 3
        m, use = unpack(r.g, k), list(range(1 + 2 * int(r.p)))
        coef = np.linalg.pinv(m[np.ix_(use, use)]) @ m[np.ix_(use, [k - 2, k - 1])]
        roots = np.abs(np.linalg.eigvals(_companion(coef, p)))
        full = np.zeros((2 * max_lags + 1, 2))
        full[: len(use)] = coef
        top = roots.max()
        yield full[:, 0].tolist(), full[:, 1].tolist(), bool(top < 1), float(1 / top) if top > 0 else None, int(r.n)

    out = _per_row(
        _var_moments(rows, names, by), [by, "p"], solve,
        "coef_a array<double>, coef_b array<double>, is_stable boolean, min_root_modulus double, n_obs long",
    )
    return _every_firm(orders, out.withColumnRenamed("p", "chosen_lag"), by)


def _every_firm(asked: DataFrame, result: DataFrame, by: str) -> DataFrame:
    """A firm without a lag order has a row of nulls."""
    none = asked.filter("chosen_lag IS NULL").select(by, *(F.lit(None).cast(f.dataType).alias(f.name) for f in result.schema.fields if f.name != by))
    return result.unionByName(none)


def _dot(vector: Column, coef: str) -> Column:
    return F.aggregate(F.zip_with(vector, F.col(coef), lambda x, c: x * c), F.lit(0.0), lambda s, v: s + v)


def var_diagnostics(
    df: DataFrame, fit: DataFrame, a: str, b: str, by: str = "ticker", time: str = "week_monday", max_lags: int = MAX_VAR_LAGS,
    extra: int = 10, arch_lags: int = 4,
) -> DataFrame:
    """Residual whiteness (chosen lag + ``extra``), joint normality and ARCH effects per equation."""
    rows, names = _fit_rows(df, fit, a, b, by, time, max_lags)
    x = F.array(F.lit(1.0), *names)
    u = rows.join(fit.select(by, "coef_a", "coef_b"), by).select(
        by, "p", "pos", (F.col("a") - _dot(x, "coef_a")).alias("u"), (F.col("b") - _dot(x, "coef_b")).alias("v")
    )
    w = _ordered([by], "pos")
    horizon = max_lags + extra
    cross = []
    lagged = u.withColumns({f"{c}{i}": F.lag(c, i).over(w) for i in range(1, horizon + 1) for c in "uv"})
    for i in range(1, horizon + 1):
        cross += [F.coalesce(F.sum(F.col(s) * F.col(f"{t}{i}")), F.lit(0.0)) for s in "uv" for t in "uv"]
    power = [F.sum(F.pow("u", F.lit(float(i))) * F.pow("v", F.lit(float(j)))) for i in range(5) for j in range(5 - i)]
    sums = lagged.groupBy(by, "p").agg(F.count(F.lit(1)).alias("n"), F.array(*cross).alias("cross"), F.array(*power).alias("power"))
    sq = lagged.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") > arch_lags)
    arch = None
    for c in "uv":
        terms = [F.lit(1.0), *[F.col(f"{c}{i}") ** 2 for i in range(1, arch_lags + 1)], F.col(c) ** 2]
        part = gram(sq, [by], terms).select(by, F.col("n").alias("n_arch"), F.col("g").alias(f"arch_{c}"))
        arch = part if arch is None else arch.join(part.drop("n_arch"), by)

    def solve(r):
        n, p = int(r.n), int(r.p)
        mom = dict(zip([(i, j) for i in range(5) for j in range(5 - i)], r.power))
        c0 = np.array([[mom[2, 0], mom[1, 1]], [mom[1, 1], mom[0, 2]]]) / n
        inv = np.linalg.inv(c0)
        cov = np.asarray(r.cross).reshape(horizon, 2, 2) / n
        q = n * sum(float(np.trace(c.T @ inv @ c @ inv)) for c in cov[: p + extra])
        white = chi2_sf(q, 4 * extra)
        # standardised residuals are linear in (u, v), so their third and fourth moments expand binomially
        t = np.linalg.inv(np.linalg.cholesky(c0))
        stat = 0.0
        for i in range(2):
            s, k = t[i]
            b3, b4 = _binomial(s, k, mom, 3) / n, _binomial(s, k, mom, 4) / n
            stat += n * b3**2 / 6 + n * (b4 - 3) ** 2 / 24
        out = [white, chi2_sf(stat, 4)]
        for g in (r.arch_u, r.arch_v):
            m = unpack(g, arch_lags + 2)
            sse = _partial(m, list(range(arch_lags + 1)), [arch_lags + 1])[0, 0]
            sst = m[-1, -1] - m[0, -1] ** 2 / r.n_arch
            out.append(chi2_sf(float(r.n_arch * (1 - sse / sst)), arch_lags))
        yield tuple(float(v) for v in out)

    out = _per_row(sums.join(arch, by), [by, "p"], solve, "portmanteau_p double, normality_p double, arch_a_p double, arch_b_p double")
    return _every_firm(fit, out.withColumnRenamed("p", "chosen_lag"), by)


def _binomial(s: float, k: float, mom: dict, order: int) -> float:
    """Sum over rows of (s u + k v) ** order from the moments of u and v."""
    return sum(comb(order, j) * s ** (order - j) * k**j * mom[order - j, j] for j in range(order + 1))


# --- Granger causality ---------------------------------------------------------------------------------------------


def _wald(beta: np.ndarray, inv: np.ndarray, meat: np.ndarray, tested: list[int], n: int) -> tuple[float, float]:
    v = (inv @ meat @ inv)[np.ix_(tested, tested)]
    f = float(beta[tested] @ np.linalg.pinv(v) @ beta[tested] / len(tested))
    return f, f_sf(f, len(tested), n - len(beta))


def granger(
    df: DataFrame, bias: str, ret: str, orders: DataFrame, post: str = "is_post_break", by: str = "ticker", time: str = "week_monday",
    max_lags: int = MAX_VAR_LAGS, minimum: int = 40,
) -> DataFrame:
    """HAC-robust Granger tests in both directions on the full, pre-break and post-break samples of every firm."""
    sample = F.explode(F.array(F.lit("Full"), F.when(F.col(post), "Post").otherwise("Pre")))
    rows = df.select(by, time, F.col(bias).cast("double").alias("_b"), F.col(ret).cast("double").alias("_r"), sample.alias("sample"))
    # a firm without a lag order is tried with one lag, and the tests below find what is wrong
    rows = rows.join(orders.select(by, F.coalesce("chosen_lag", F.lit(1).cast("long")).alias("p")), by)
    ways = F.explode(
        F.array(
            F.struct(F.lit("bias2ret").alias("way"), F.col("_r").alias("a"), F.col("_b").alias("b")),
            F.struct(F.lit("ret2bias").alias("way"), F.col("_b").alias("a"), F.col("_r").alias("b")),
        )
    )
    rows = rows.select(by, time, "sample", "p", ways.alias("_w")).select(by, time, "sample", "p", "_w.*")
    keys = [by, "sample", "way"]
    size = F.count(F.lit(1)).over(W.partitionBy(*keys))
    rows = rows.withColumn("n_sample", size)
    w = _ordered(keys, time)
    names = [f"{c}{i}" for i in range(1, max_lags + 1) for c in "ab"]
    rows = rows.withColumns({n: F.lag(n[0], int(n[1:])).over(w) for n in names})
    # a row counts when all values up to its own lag order are there
    bad = F.lit(False)
    for n in names:
        bad = bad | ((F.lit(int(n[1:])) <= F.col("p")) & F.col(n).isNull())
    rows = rows.filter(F.col("a").isNotNull() & ~bad)
    rows = rows.withColumns({n: F.when(F.lit(int(n[1:])) <= F.col("p"), F.col(n)).otherwise(0.0) for n in names})
    rows = rows.withColumn("pos", F.row_number().over(w))
    x = [F.lit(1.0), *[F.col(n) for n in names]]
    group = [*keys, "p", "n_sample"]
    sums = gram(rows, group, [*x, "a"])

    def solve(r):
        p, n, k = int(r.p), int(r.n), 2 * max_lags + 2
        m, use = unpack(r.g, k), list(range(1 + 2 * int(r.p)))
        if r.n_sample < minimum or n <= 2 * p + 5 or not _full_rank(m[np.ix_(use, use)]):
            yield None, None, n
            return
        inv = np.linalg.pinv(m[np.ix_(use, use)])
        beta = np.zeros(k - 1)
        beta[use] = inv @ m[use, k - 1]
        full = np.zeros((k - 1, k - 1))
        full[np.ix_(use, use)] = inv
        yield beta.tolist(), full.ravel().tolist(), n

    fits = _per_row(sums, group, solve, "beta array<double>, inv array<double>, n_used long")
    u = F.col("a") - _dot(F.array(*x), "beta")
    scored = rows.join(fits.filter("beta IS NOT NULL").select(*keys, "beta"), keys).withColumn("_u", u)
    scores = [f"_s{i}" for i in range(len(x))]
    scored = scored.select(*keys, "p", "pos", *[(F.col("_u") * c).alias(s) for s, c in zip(scores, x)])
    meat = gram(moving_sums(scored, [*keys, "p"], "pos", scores, F.col("p")), keys, scores).select(*keys, "g")

    def test(r):
        if r.beta is None or r.g is None:
            yield None, None
            return
        p, k = int(r.p), 2 * max_lags + 1
        use = list(range(1 + 2 * p))
        inv = np.asarray(r.inv).reshape(k, k)[np.ix_(use, use)]
        m = unpack(r.g, k)[np.ix_(use, use)] / (p + 1)
        tested = [2 * i for i in range(1, p + 1)]
        yield _wald(np.asarray(r.beta)[use], inv, m, tested, int(r.n_used))

    out = _per_row(fits.join(meat, keys, "left"), group, test, "f_stat double, p_value double")
    pick = lambda way, c: F.max(F.when(F.col("way") == way, F.col(c)))
    return out.groupBy(by, "sample", F.col("n_sample").alias("n_obs"), F.col("p").alias("lag")).agg(
        *[pick(way, c).alias(f"{'f_stat' if c == 'f_stat' else 'p_val'}_{way}") for way in ("bias2ret", "ret2bias") for c in ("f_stat", "p_value")]
    )


def granger_table(result: DataFrame, by: str = "ticker") -> DataFrame:
    """Formatted p-values with one column per direction and sample."""
    cols = [(w, s) for w in ("bias2ret", "ret2bias") for s in ("Full", "Pre", "Post")]
    at = lambda w, s: F.max(F.when(F.col("sample") == s, F.col(f"p_val_{w}")))
    return result.groupBy(by).agg(*[stars(at(w, s)).alias(f"{w}_{s.lower()}") for w, s in cols])


def panel_granger(
    df: DataFrame, bias: str, ret: str, controls: list[str], p: int = PANEL_LAGS, post: str = "is_post_break", by: str = "ticker",
    time: str = "week_monday", by_group: bool = False,
) -> DataFrame:
    """Pooled Granger tests after Helmert differencing, on the full, pre- and post-break samples.

    The long-run variance runs over the rows stacked by firm and week and crosses firm borders, unless ``by_group``.
    """
    sample = F.explode(F.array(F.lit("Full"), F.when(F.col(post), "Post-break").otherwise("Pre-break")))
    cols = list(dict.fromkeys([bias, ret, *controls]))
    rows = df.select(by, time, sample.alias("sample"), *[F.col(c).cast("double").alias(c) for c in cols])
    w = _ordered(["sample", by], time)
    lagged = [f"{c}_L{i}" for c in (bias, ret) for i in range(1, p + 1)]
    rows = rows.withColumns({f"{c}_L{i}": F.lag(c, i).over(w) for c in (bias, ret) for i in range(1, p + 1)})
    rows = rows.dropna(subset=[*lagged, *cols])
    enough = rows.groupBy("sample").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 50").drop("_n")
    rows = rows.join(enough, "sample", "left_semi")
    every = [bias, ret, *lagged, *[c for c in controls if c not in (bias, ret)]]
    rows = rows.withColumns(_helmert(every, ["sample", by], time)).dropna(subset=every)
    xs = every[2:]
    k = len(xs)
    if by_group:
        rows, stack = rows.withColumn("_pos", F.row_number().over(_ordered(["sample", by], time)).cast("long")), ["sample", by]
    else:
        rows, stack = rank_in_group(rows, ["sample"], [F.col(by), F.col(time)], "_pos"), ["sample"]
    sums = gram(rows, ["sample"], [*xs, bias, ret])

    def solve(r):
        n = int(r.n)
        if n < k + 10:
            return
        m = unpack(r.g, k + 2)
        inv = np.linalg.pinv(m[:k, :k])
        yield (inv @ m[:k, k]).tolist(), (inv @ m[:k, k + 1]).tolist(), inv.ravel().tolist(), n

    fits = _per_row(sums, ["sample"], solve, "beta_b array<double>, beta_r array<double>, inv array<double>, n_obs long")
    x = F.array(*xs)
    scored = rows.join(fits, "sample").withColumn("_ub", F.col(bias) - _dot(x, "beta_b")).withColumn("_ur", F.col(ret) - _dot(x, "beta_r"))
    meats = []
    for u in ("_ub", "_ur"):
        scores = [f"_s{i}" for i in range(k)]
        part = scored.select(*stack, "_pos", *[(F.col(u) * F.col(c)).alias(s) for s, c in zip(scores, xs)])
        meats.append(gram(moving_sums(part, stack, "_pos", scores, F.lit(p)), ["sample"], scores).select("sample", F.col("g").alias("g" + u)))

    def test(r):
        inv, n = np.asarray(r.inv).reshape(k, k), int(r.n_obs)
        r2b = _wald(np.asarray(r.beta_b), inv, unpack(r.g_ub, k) / (p + 1), list(range(p, 2 * p)), n)
        b2r = _wald(np.asarray(r.beta_r), inv, unpack(r.g_ur, k) / (p + 1), list(range(p)), n)
        yield (*r2b, *b2r)

    both = fits.join(meats[0], "sample").join(meats[1], "sample")
    return _per_row(both, ["sample", "n_obs"], test, "f_stat_ret2bias double, p_val_ret2bias double, f_stat_bias2ret double, p_val_bias2ret double")

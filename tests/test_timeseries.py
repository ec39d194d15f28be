"""Time-series tests against direct numpy versions on simulated and hand-made series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelspark.functions import distributions as D
from panelspark.operators import timeseries as T

WEEK = dt.timedelta(days=7)
START = dt.date(2015, 1, 5)


def make(spark, data: dict[str, dict[str, np.ndarray]]):
    rows = []
    for ticker, cols in data.items():
        n = len(next(iter(cols.values())))
        for i in range(n):
            rows.append((ticker, START + i * WEEK, *[None if np.isnan(c[i]) else float(c[i]) for c in cols.values()]))
    names = list(next(iter(data.values())))
    return spark.createDataFrame(rows, "ticker string, week_monday date, " + ", ".join(f"{n} double" for n in names)).cache()


@pytest.fixture(scope="module")
def system():
    rng = np.random.default_rng(11)
    out = {}
    for k, t in enumerate(["A", "B"]):
        n = 260
        e = rng.normal(size=(n, 2))
        x = np.zeros((n, 2))
        for i in range(2, n):
            x[i, 0] = 0.1 + 0.5 * x[i - 1, 0] - 0.2 * x[i - 2, 0] + e[i, 0]
            x[i, 1] = 0.4 * x[i - 1, 0] + 0.2 * x[i - 1, 1] + e[i, 1] * (1 + k)
        out[t] = {"bias": x[:, 0], "ret": x[:, 1]}
    return out


@pytest.fixture(scope="module")
def frame(spark, system):
    return make(spark, system)


def lagmat(x, p):
    return np.column_stack([x[p - i : len(x) - i] for i in range(1, p + 1)]) if p else np.empty((len(x), 0))


def fit(y, x):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    return b, y - x @ b


def adf_direct(x, trend, maxlag=12):
    d = np.diff(x)

    def design(p):
        y = d[p:]
        cols = [x[p:-1], *[d[p - i : len(d) - i] for i in range(1, p + 1)]]
        if trend != "n":
            cols.append(np.ones(len(y)))
        if trend == "ct":
            cols.append(np.arange(len(y), dtype=float))
        return y, np.column_stack(cols)

    best = None
    for p in range(maxlag + 1):
        y, z = design(p)
        y, z = y[maxlag - p :], z[maxlag - p :]
        _, u = fit(y, z)
        aic = len(y) * np.log(u @ u / len(y)) + 2 * z.shape[1]
        if best is None or aic < best[0]:
            best = (aic, p)
    y, z = design(best[1])
    b, u = fit(y, z)
    v = u @ u / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)
    return b[0] / np.sqrt(v[0, 0]), best[1], len(y)


def test_adf_matches_direct(spark):
    rng = np.random.default_rng(1)
    ar = np.zeros(300)
    for i in range(1, 300):
        ar[i] = 0.5 * ar[i - 1] + rng.normal()
    walk = np.cumsum(rng.normal(size=300))
    df = make(spark, {"A": {"ar": ar, "walk": walk}})
    got = {(r["variable"], r["spec"]): r for r in T.adf(T.long_series(df, ["ar", "walk"])).collect()}
    for name, x in (("ar", ar), ("walk", walk)):
        for spec in ("n", "c", "ct"):
            stat, p, n = adf_direct(x, spec)
            r = got[name, spec]
            assert (r["lags"], r["n_obs"]) == (p, n)
            assert r["stat"] == pytest.approx(stat, rel=1e-6)
    assert got["ar", "c"]["p_value"] < 0.01 < got["walk", "c"]["p_value"]


def kpss_direct(x, trend):
    n = len(x)
    z = np.column_stack([np.ones(n)] + ([np.arange(n)] if trend == "ct" else []))
    _, e = fit(x, z)
    cov = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for i in range(1, cov + 1):
        c = e[i:] @ e[: n - i] / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    v = e @ e + 2 * sum(e[i:] @ e[: n - i] * (1 - i / (lags + 1)) for i in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / n**2 / (v / n), lags


def test_kpss_matches_direct_and_verdicts(spark):
    rng = np.random.default_rng(2)
    noise, walk = rng.normal(size=250), np.cumsum(rng.normal(size=250))
    df = T.difference(make(spark, {"A": {"noise": noise, "walk": walk}}), ["noise", "walk"])
    series = T.long_series(df, ["noise", "walk", "d_noise", "d_walk"])
    kp = T.kpss(series)
    got = {(r["variable"], r["spec"]): r for r in kp.collect()}
    for name, x in (("noise", noise), ("walk", walk)):
        for spec in ("c", "ct"):
            stat, lags = kpss_direct(x, spec)
            assert got[name, spec]["lags"] == lags
            assert got[name, spec]["stat"] == pytest.approx(stat, rel=1e-8)
    verdicts = T.stationarity_verdict(T.adf(series), kp)
    said = {r["variable"]: r["conclusion"] for r in verdicts.collect()}
    assert said["noise"] == "Stationary (I(0))" and said["walk"] == "Non-Stationary (I(1) / Unit Root)"
    orders = {r["series"]: r["integration_order"] for r in T.integration_order(verdicts).collect()}
    assert orders == {"noise": "I(0)", "walk": "I(1)"}


def test_johansen_matches_direct(spark, system, frame):
    got = {r["ticker"]: r for r in T.johansen(frame, "bias", "ret").collect()}
    for t, c in system.items():
        x = np.column_stack([c["bias"], c["ret"]])
        d = np.diff(x, axis=0)
        z, dx, lx = d[:-1], d[1:], x[1:-1]
        center = lambda v: v - v.mean(axis=0)
        z, dx, lx = center(z), center(dx), center(lx)
        clean = lambda v: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
        r0, rk = clean(dx), clean(lx)
        n = len(r0)
        s00, skk, sk0 = r0.T @ r0 / n, rk.T @ rk / n, rk.T @ r0 / n
        lam = np.sort(np.linalg.eigvals(np.linalg.inv(skk) @ sk0 @ np.linalg.inv(s00) @ sk0.T).real)[::-1]
        assert got[t]["trace_r0"] == pytest.approx(-n * np.log(1 - lam).sum(), rel=1e-8)
        assert got[t]["trace_r1"] == pytest.approx(-n * np.log(1 - lam[1]), rel=1e-8)


def var_direct(x, p):
    z = np.column_stack([np.ones(len(x) - p), *[x[p - i : len(x) - i] for i in range(1, p + 1)]])
    b, u = fit(x[p:], z)
    return b, u


def test_var_order_fit_and_diagnostics(spark, system, frame):
    orders = T.var_order(frame, "bias", "ret").cache()
    fits = T.var_fit(frame, orders, "bias", "ret").cache()
    diag = {r["ticker"]: r for r in T.var_diagnostics(frame, fits, "bias", "ret").collect()}
    o, f = ({r["ticker"]: r for r in d.collect()} for d in (orders, fits))
    for t, c in system.items():
        x = np.column_stack([c["bias"], c["ret"]])
        n = len(x) - 8
        bic = []
        for p in range(9):
            u = var_direct(x[8 - p :], p)[1]
            bic.append(np.linalg.slogdet(u.T @ u / n)[1] + np.log(n) / n * (4 * p + 2))
        p = max(int(np.argmin(bic)), 1)
        assert o[t]["chosen_lag"] == p
        b, u = var_direct(x, p)
        np.testing.assert_allclose(f[t]["coef_a"][: 2 * p + 1], b[:, 0], rtol=1e-7)
        comp = np.vstack([b[1:].T, np.eye(2 * (p - 1), 2 * p)])
        assert f[t]["min_root_modulus"] == pytest.approx(1 / np.abs(np.linalg.eigvals(comp)).max(), rel=1e-7)
        assert f[t]["is_stable"]
        n = len(u)
        c0 = np.linalg.inv(u.T @ u / n)
        q = 0.0
        for h in range(1, p + 11):
            ch = u[h:].T @ u[:-h] / n
            q += np.trace(ch.T @ c0 @ ch @ c0)
        assert diag[t]["portmanteau_p"] == pytest.approx(D.chi2_sf(n * q, 40), rel=1e-6)
        w = np.linalg.inv(np.linalg.cholesky(u.T @ u / n)) @ u.T
        jb = n * ((w**3).mean(axis=1) ** 2).sum() / 6 + n * (((w**4).mean(axis=1) - 3) ** 2).sum() / 24
        assert diag[t]["normality_p"] == pytest.approx(D.chi2_sf(jb, 4), rel=1e-6)
        s = u[:, 0] ** 2
        z = np.column_stack([np.ones(n - 4), lagmat(s, 4)])
        e = fit(s[4:], z)[1]
        lm = (n - 4) * (1 - e @ e / ((s[4:] - s[4:].mean()) ** 2).sum())
        assert diag[t]["arch_a_p"] == pytest.approx(D.chi2_sf(lm, 4), rel=1e-6)


def hac_f(y, x, tested, lags):
    b, u = fit(y, x)
    s = x * u[:, None]
    meat = s.T @ s
    for l in range(1, lags + 1):
        g = s[l:].T @ s[:-l]
        meat += (1 - l / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(x.T @ x)
    v = (inv @ meat @ inv)[np.ix_(tested, tested)]
    f = b[tested] @ np.linalg.inv(v) @ b[tested] / len(tested)
    return f, D.f_sf(f, len(tested), len(y) - x.shape[1])


def test_granger_matches_direct(spark, system, frame):
    df = T.flag_post(frame, spark.createDataFrame([("A", START + 100 * WEEK)], "ticker string, bias_break_date date"))
    orders = spark.createDataFrame([("A", 2), ("B", 3)], "ticker string, chosen_lag long")
    got = {(r["ticker"], r["sample"]): r for r in T.granger(df, "bias", "ret", orders).collect()}
    assert set(got) == {("A", "Full"), ("A", "Pre"), ("A", "Post"), ("B", "Full"), ("B", "Pre")}
    cuts = {"Full": slice(None), "Pre": slice(0, 100), "Post": slice(100, None)}
    for (t, s), r in got.items():
        p = {"A": 2, "B": 3}[t]
        part = cuts[s] if t == "A" else slice(None)
        b, y = system[t]["bias"][part], system[t]["ret"][part]
        for way, caused, causing in (("bias2ret", y, b), ("ret2bias", b, y)):
            x = np.column_stack([np.ones(len(b) - p), lagmat(caused, p), lagmat(causing, p)])
            f, pv = hac_f(caused[p:], x, list(range(1 + p, 1 + 2 * p)), p)
            assert r[f"f_stat_{way}"] == pytest.approx(f, rel=1e-6)
            assert r[f"p_val_{way}"] == pytest.approx(pv, rel=1e-5, abs=1e-12)
    table = {r["ticker"]: r for r in T.granger_table(T.granger(df, "bias", "ret", orders)).collect()}
    assert table["A"]["bias2ret_full"].endswith("***") and table["B"]["ret2bias_post"] == "N/A"


@pytest.mark.parametrize("by_group", [False, True])
def test_panel_granger_matches_direct(spark, system, by_group):
    rng = np.random.default_rng(4)
    data = {t: {**c, "vix": rng.normal(size=260), "post": (np.arange(260) >= 130).astype(float)} for t, c in system.items()}
    df = make(spark, data).selectExpr("*", "post = 1 AS is_post_break")
    got = {r["sample"]: r for r in T.panel_granger(df, "bias", "ret", ["post", "vix"], by_group=by_group).collect()}
    parts = []
    for t in sorted(data):
        c = data[t]
        m = np.column_stack([c["bias"][3:], c["ret"][3:], lagmat(c["bias"], 3), lagmat(c["ret"], 3), c["post"][3:], c["vix"][3:]])
        n = len(m)
        parts.append(np.array([np.sqrt((n - i - 1) / (n - i)) * (m[i] - m[i + 1 :].mean(axis=0)) for i in range(n - 1)]))
    m = np.vstack(parts)
    r = got["Full"]
    assert r["n_obs"] == len(m)
    if not by_group:
        f, p = hac_f(m[:, 1], m[:, 2:], [0, 1, 2], 3)
        assert r["f_stat_bias2ret"] == pytest.approx(f, rel=1e-6)
        f, p = hac_f(m[:, 0], m[:, 2:], [3, 4, 5], 3)
        assert r["f_stat_ret2bias"] == pytest.approx(f, rel=1e-6)
        assert r["p_val_ret2bias"] == pytest.approx(p, rel=1e-5)
    else:
        b, u = fit(m[:, 1], m[:, 2:])
        s, k = m[:, 2:] * u[:, None], m.shape[1] - 2
        meat = np.zeros((k, k))
        for part in np.split(s, 2):
            meat += part.T @ part
            for l in range(1, 4):
                g = part[l:].T @ part[:-l]
                meat += (1 - l / 4) * (g + g.T)
        inv = np.linalg.inv(m[:, 2:].T @ m[:, 2:])
        v = (inv @ meat @ inv)[:3, :3]
        assert r["f_stat_bias2ret"] == pytest.approx(b[:3] @ np.linalg.inv(v) @ b[:3] / 3, rel=1e-6)


def test_step_series_breaks_in_the_middle(spark):
    step = np.r_[np.zeros(60), np.ones(60)]
    df = make(spark, {"S": {"bias": step, "ret": step}, "short": {"bias": np.arange(50.0), "ret": np.arange(50.0)}})
    table = {r["ticker"]: r for r in T.break_table(df, "bias", "ret").collect()}
    assert table["S"]["pre_obs"] == 60 and table["S"]["is_valid_split"]
    assert table["S"]["bias_break_date"] == START + 60 * WEEK
    assert table["short"]["bias_break_date"] is None and not table["short"]["is_valid_split"]
    assert table["short"]["pre_obs"] == 50


def test_tails_match_published_points():
    assert D.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert D.chi2_sf(55.75848, 40) == pytest.approx(0.05, abs=1e-6)
    assert D.f_sf(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert D.f_critical(0.05, 2, 60) == pytest.approx(3.150411, abs=1e-5)
    assert D.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    for trend in ("n", "c", "ct"):
        assert D.mackinnon_p(D.mackinnon_5pct(trend, 100_000), trend) == pytest.approx(0.05, abs=2e-3)
    assert D.kpss_p(0.463, "c") == pytest.approx(0.05) and D.kpss_p(9.0, "c") == pytest.approx(0.01)


@pytest.fixture(scope="module")
def spoiled(spark, system):
    """A normal firm beside a constant one, one with two equal series, and a short one."""
    a = system["A"]
    flat, short = np.full(260, 3.0), {c: x[:12] for c, x in a.items()}
    return make(spark, {"A": a, "K": {"bias": flat, "ret": flat + 1}, "E": {"bias": a["bias"], "ret": a["bias"]}, "S": short})


def test_one_bad_firm_leaves_the_others_alone(spark, frame, spoiled):
    from pyspark.sql import functions as F

    def rows(df, cols, only=None):
        return {tuple(r[c] for c in ("ticker", *cols)): r.asDict() for r in df.filter(F.col("ticker") == only if only else F.lit(True)).collect()}

    series, clean = (T.long_series(d, ["bias", "ret"]) for d in (spoiled, frame))
    for test, cols in ((T.adf, ("variable", "spec")), (T.kpss, ("variable", "spec"))):
        got, want = rows(test(series), cols), rows(test(clean), cols, "A")
        assert all(got[k] == pytest.approx(v) for k, v in want.items())
        assert all(r["stat"] is None for k, r in got.items() if k[0] == "K") and any(k[0] == "K" for k in got)
    verdicts = rows(T.stationarity_verdict(T.adf(series), T.kpss(series)), ("variable",))
    assert {r["conclusion"] for k, r in verdicts.items() if k[0] == "K"} == {"Unknown"}
    assert all(r["integration_order"] for r in T.integration_order(T.stationarity_verdict(T.adf(clean), T.kpss(clean))).collect())
    got = rows(T.johansen(spoiled, "bias", "ret"), ())
    assert got[("A",)] == pytest.approx(rows(T.johansen(frame, "bias", "ret"), ())[("A",)])
    assert all(got[(t,)]["trace_r0"] is None for t in "KES")
    orders = T.var_order(spoiled, "bias", "ret")
    by_firm = rows(orders, ())
    assert by_firm[("A",)] == rows(T.var_order(frame, "bias", "ret"), ())[("A",)]
    assert all(by_firm[(t,)]["chosen_lag"] is None for t in "KE")
    fit = T.var_fit(spoiled, orders, "bias", "ret")
    want = T.var_fit(frame, T.var_order(frame, "bias", "ret"), "bias", "ret")
    assert rows(fit, ())[("A",)] == rows(want, ())[("A",)] and rows(fit, ())[("K",)]["is_stable"] is None
    checks, wanted = rows(T.var_diagnostics(spoiled, fit, "bias", "ret"), ()), rows(T.var_diagnostics(frame, want, "bias", "ret"), ())
    assert checks[("A",)] == pytest.approx(wanted[("A",)]) and checks[("E",)]["portmanteau_p"] is None
    post = F.col("week_monday") > F.lit(START + 130 * WEEK)
    g = T.granger(spoiled.withColumn("is_post_break", post), "bias", "ret", orders)
    h = T.granger(frame.withColumn("is_post_break", post), "bias", "ret", T.var_order(frame, "bias", "ret"))
    got, want = rows(g, ("sample",)), rows(h, ("sample",), "A")
    assert len(want) == 3 and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert all(r["p_val_bias2ret"] is None and r["f_stat_ret2bias"] is None for k, r in got.items() if k[0] in "KES")
    table = {r["ticker"]: r for r in T.granger_table(g).collect()}
    assert set(table) == set("AKE") | ({"S"} if "S" in table else set())

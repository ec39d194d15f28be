"""SQL for least squares: normal equations eliminated in a recursive query, robust and clustered errors, normal tails."""

from __future__ import annotations


def normal_p(t: str) -> str:
    """Two-sided tail of the normal distribution, by the series of the error function without alternating signs."""
    z = f"(abs({t}) / sqrt(2.0))"
    term = f"exp(2 * i * ln(2.0) + (2 * i + 1) * ln({z}) + lgamma(CAST(i + 1 AS DOUBLE)) - lgamma(CAST(2 * i + 2 AS DOUBLE)))"
    return f"CASE WHEN abs({t}) > 9 THEN 0.0 WHEN {t} = 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * exp(-{z} * {z}) * list_sum([{term} FOR i IN range(150)]) END"


def eliminated(name: str, source: str, key: str = "1") -> str:
    """A recursive table ``name`` (key, m): the rows of each matrix in ``source`` (m) after elimination of its leading square
    part.

    A pivot without size belongs to a column that others explain; it is left out, which sets its solution to zero.
    """
    return f"""{name}_steps AS (SELECT {key} AS key, 1 AS k, m FROM {source} UNION ALL SELECT key, k + 1, CASE WHEN abs(m[k][k]) < 1e-9 THEN
      list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: 0.0) ELSE r END)
      ELSE list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
        ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) END
    FROM {name}_steps WHERE k <= len(m)),
  {name} AS (SELECT key, arg_max(m, k) AS m FROM {name}_steps GROUP BY 1)"""


def least_squares(k: int, vcov: str = "hc1", cluster: str | None = None) -> str:
    """Tables from ``w`` (y, x as a list of k, and the cluster): ``fit`` has beta, se and, with a cluster, cse as lists."""
    idx = f"range(1, {k + 1})"
    tables = f"""pair AS (SELECT i, j, sum(x[i] * x[j]) AS v FROM w, {idx} a(i), {idx} b(j) GROUP BY 1, 2),
  side AS (SELECT i, sum(x[i] * y) AS v FROM w, {idx} a(i) GROUP BY 1),
  aug AS (SELECT list(r ORDER BY i) AS m FROM (SELECT pair.i, list_concat(list(pair.v ORDER BY j),
    [CASE WHEN q = pair.i THEN 1.0 ELSE 0.0 END FOR q IN {idx}], [any_value(side.v)]) AS r FROM pair JOIN side ON side.i = pair.i GROUP BY pair.i)),
  {eliminated("gj", "aug")},
  solved AS (SELECT [r[{2 * k + 1}] FOR r IN m] AS beta, [r[{k + 1}:{2 * k}] FOR r IN m] AS inv FROM gj),
  u AS (SELECT w.*, y - list_inner_product(x, beta) AS u, [list_inner_product(r, x) FOR r IN inv] AS f FROM w, solved),
  size AS (SELECT CAST(count(*) AS BIGINT) AS n, sum(y * y) - sum(y) * sum(y) / count(*) AS sst, sum(u * u) AS sse FROM u),
  hc AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, sum(f[i] * f[i] * u * u) AS s FROM u, {idx} a(i) GROUP BY 1))"""
    if cluster:
        tables += f""",
  cl AS (SELECT list(s ORDER BY i) AS c, any_value(g) AS g FROM (SELECT i, sum(s * s) AS s, count(*) AS g
    FROM (SELECT i, {cluster}, sum(f[i] * u) AS s FROM u, {idx} a(i) GROUP BY 1, 2) GROUP BY 1))"""
    factor = f"n / (n - {k}.0)" if vcov == "hc1" else "1.0"
    clustered = f", [sqrt(g / (g - 1.0) * (n - 1.0) / (n - {k}.0) * v) FOR v IN c] AS cse" if cluster else ""
    return tables + f""",
  fit AS (SELECT n, 1 - sse / sst AS r2, beta, [sqrt({factor} * v) FOR v IN s] AS se{clustered} FROM solved, size, hc{", cl" if cluster else ""})"""


def frame(names: list[str], cluster: bool = False) -> str:
    """The rows of a fit, one per regressor."""
    listed = "[" + ", ".join(f"'{n}'" for n in names) + "]"

    def stats(se: str, suffix: str) -> str:
        return f"""b / {se} AS {'t' if suffix else 't_stat'}{suffix}, {normal_p(f'(b / {se})')} AS p{suffix or '_value'},
      b - 1.96 * {se} AS ci95_low{suffix}, b + 1.96 * {se} AS ci95_high{suffix}"""

    more = ", c AS se_cluster, " + stats("c", "_cluster") if cluster else ""
    return f"""SELECT v AS variable, b AS coef, s AS se, {stats('s', '')}{more}, n AS n_obs, CAST({len(names)} AS BIGINT) AS n_regressors, r2 AS r2_within
    FROM (SELECT n, r2, unnest({listed}) AS v, unnest(beta) AS b, unnest(se) AS s{", unnest(cse) AS c" if cluster else ""} FROM fit)"""


FRAME_DOUBLES = "coef se t_stat p_value ci95_low ci95_high r2_within"
CLUSTER_DOUBLES = FRAME_DOUBLES + " se_cluster t_cluster p_cluster ci95_low_cluster ci95_high_cluster"


def absorbed(rows: str, y: str, x: str, small: list[str], most: str) -> str:
    """Table ``w`` (y, x as a list of one): y and x of ``rows`` net of all factors; the factor ``most`` goes by its means, the
    levels of ``small`` by the normal equations that are left."""
    levels = " UNION ALL ".join(f"SELECT DISTINCT '{f}' AS f, CAST({f} AS VARCHAR) AS l FROM {rows}" for f in small)
    listed = "[" + ", ".join(f"concat('{f}:', CAST({f} AS VARCHAR))" for f in small) + "]"
    return f"""base AS (SELECT row_number() OVER () AS id, {most} AS most, {y} AS y, {x} AS x, {listed} AS ls FROM {rows}),
  lev AS (SELECT row_number() OVER (ORDER BY f, l) AS a, concat(f, ':', l) AS l FROM ({levels})),
  long AS (SELECT id, most, y, x, lev.a FROM (SELECT id, most, y, x, unnest(ls) AS l FROM base) JOIN lev USING (l)),
  per AS (SELECT most, a, count(*) AS c FROM long GROUP BY 1, 2),
  mean AS (SELECT most, count(*) AS c, avg(y) AS y, avg(x) AS x FROM base GROUP BY 1),
  cross_ab AS (SELECT p.a, q.a AS b, count(*) AS v FROM long p JOIN long q ON q.id = p.id GROUP BY 1, 2),
  within_ab AS (SELECT p.a, q.a AS b, sum(p.c * q.c / CAST(mean.c AS DOUBLE)) AS v FROM per p JOIN per q ON q.most = p.most JOIN mean ON mean.most = p.most GROUP BY 1, 2),
  right_a AS (SELECT a, sum(long.y - mean.y) AS y, sum(long.x - mean.x) AS x FROM long JOIN mean ON mean.most = long.most GROUP BY 1),
  normal AS (SELECT list(r ORDER BY a) AS m FROM (SELECT i.a, list_concat(list(coalesce(c.v, 0) - coalesce(z.v, 0) ORDER BY j.a), [any_value(s.y), any_value(s.x)]) AS r
    FROM lev i CROSS JOIN lev j LEFT JOIN cross_ab c ON c.a = i.a AND c.b = j.a LEFT JOIN within_ab z ON z.a = i.a AND z.b = j.a
    JOIN right_a s ON s.a = i.a GROUP BY i.a)),
  {eliminated("effect", "normal")},
  theta AS (SELECT unnest(range(1, len(m) + 1)) AS a, unnest([r[len(r) - 1] FOR r IN m]) AS y, unnest([r[len(r)] FOR r IN m]) AS x FROM effect),
  net AS (SELECT id, any_value(long.most) AS most, any_value(long.y) - sum(theta.y) AS y, any_value(long.x) - sum(theta.x) AS x
    FROM long JOIN theta ON theta.a = long.a GROUP BY 1),
  w AS (SELECT y - avg(y) OVER (PARTITION BY most) AS y, [x - avg(x) OVER (PARTITION BY most)] AS x FROM net)"""


def synthetic_effects(rows: str, min_pre: int = 180, min_post: int = 180, min_donors: int = 5) -> str:
    """Table ``effects`` (firm, effect) from ``rows`` (ticker, date, daily_return, post): every firm against the weighted others."""
    return f"""daily AS (SELECT ticker, date, avg(daily_return) AS y FROM {rows} WHERE daily_return IS NOT NULL GROUP BY 1, 2),
  day AS (SELECT date, max(post) AS post, count(DISTINCT ticker) AS n FROM {rows} WHERE daily_return IS NOT NULL GROUP BY 1),
  own AS (SELECT ticker AS firm, daily.date, y, post, post = 0 AND n > {min_donors} AS valid FROM daily JOIN day USING (date)),
  treated AS (SELECT firm FROM own GROUP BY 1 HAVING count(*) FILTER (post = 0) >= {min_pre} AND count(*) FILTER (post = 1) >= {min_post}
    AND count(*) FILTER (valid) >= {min_pre}),
  means AS (SELECT firm, ticker AS donor, avg(d.y) AS mu FROM own JOIN treated USING (firm) JOIN daily d ON d.date = own.date AND d.ticker <> firm
    WHERE valid GROUP BY 1, 2),
  numbered AS (SELECT firm, donor, mu, row_number() OVER (PARTITION BY firm ORDER BY donor) AS a FROM means),
  wide AS (SELECT own.firm, own.date, own.y, own.post, own.valid, list(coalesce(d.y, mu) ORDER BY a) AS x FROM own JOIN numbered ON numbered.firm = own.firm
    LEFT JOIN daily d ON d.date = own.date AND d.ticker = donor GROUP BY 1, 2, 3, 4, 5),
  cell AS (SELECT firm, i, j, sum(x[i] * x[j]) AS v FROM wide, (SELECT unnest(range(1, 1 + (SELECT max(a) FROM numbered))) AS i), (SELECT unnest(range(1, 1 + (SELECT max(a) FROM numbered))) AS j)
    WHERE valid AND i <= len(x) AND j <= len(x) GROUP BY 1, 2, 3),
  rhs AS (SELECT firm, i, sum(x[i] * y) AS v FROM wide, (SELECT unnest(range(1, 1 + (SELECT max(a) FROM numbered))) AS i) WHERE valid AND i <= len(x) GROUP BY 1, 2),
  normal AS (SELECT firm, list(r ORDER BY i) AS m FROM (SELECT cell.firm, cell.i, list_append(list(cell.v ORDER BY j), any_value(rhs.v)) AS r
    FROM cell JOIN rhs ON rhs.firm = cell.firm AND rhs.i = cell.i GROUP BY 1, 2) GROUP BY 1),
  {eliminated("gj", "normal", "firm")},
  raw AS (SELECT key AS firm, [greatest(r[len(r)], 0.0) FOR r IN m] AS w FROM gj),
  weight AS (SELECT firm, CASE WHEN list_sum(w) > 0 THEN [v / list_sum(w) FOR v IN w] ELSE [1.0 / len(w) FOR v IN w] END AS w FROM raw),
  effects AS (SELECT firm, avg(y - list_inner_product(x, w)) AS effect FROM wide JOIN weight USING (firm) WHERE post = 1 GROUP BY 1)"""

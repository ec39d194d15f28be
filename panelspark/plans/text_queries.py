"""Sources, sinks, headline text, deduplication, matrices, relevance, evaluation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text
from ..operators import dedup, evaluation, filters, headline_classifier, matrices, relevance, training
from ..scale import rank_in_group
from ..sources import sinks, tables
from ..views import Tables
from .registry import query

YEARS = list(range(2015, 2026))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(phrases: list[str], col: str) -> str:
    return "(" + " OR ".join(f"contains({col}, {_quote(p)})" for p in phrases) + ")"


def _regex(col: str, pattern: str) -> str:
    # braces are doubled nowhere: view names are the only {word} tokens, and quantifiers hold digits and commas
    return f"regexp_matches({col}, {_quote(pattern)}, 'i')"


def _rule_sql(rule: dict) -> str:
    parts = [_any(rule["phrases"], "lower(t)")] if rule.get("phrases") else []
    parts += [_regex("t", p) for p in rule.get("patterns", [])]
    cond = "(" + " OR ".join(parts) + ")"
    if "company_contains" in rule:
        cond += f" AND contains(lower(trim(company_name)), {_quote(rule['company_contains'])})"
    if "also" in rule:
        cond += " AND " + _any(rule["also"], "lower(t)")
    if "also_pattern" in rule:
        cond += " AND " + _regex("t", rule["also_pattern"])
    if "unless" in rule:
        cond += " AND NOT " + _any(rule["unless"], "lower(t)")
    return cond


def _adjusted(source: str, prob: str) -> str:
    rules = list(enumerate(fv.ADJUSTMENT_RULES))
    number = "CASE " + " ".join(f"WHEN {_rule_sql(r)} THEN {i}" for i, r in rules) + " END"
    score = "CASE rule_no " + " ".join(
        f"WHEN {i} THEN {r['floor'] if r['cut'] is None else 'greatest(%s, %s - %s)' % (r['floor'], prob, r['cut'])}" for i, r in rules
    )
    name = "CASE rule_no " + " ".join(f"WHEN {i} THEN {_quote(r['name'])}" for i, r in rules)
    return f"""(SELECT * EXCLUDE (t, rule_no), {score} ELSE {prob} END AS adj_prob, {name} ELSE '' END AS rule_fired
      FROM (SELECT *, {number} AS rule_no FROM (SELECT *, trim(title) AS t FROM {source})))"""


def _forced(exclusions: dict[str, str]) -> str:
    other = " OR ".join(f"(company_name = {_quote(f)} AND {_regex('title', p)})" for f, p in exclusions.items())
    firms = ", ".join(map(_quote, fv.ANALYST_FIRMS))
    return f"""(lower(source) IN ({', '.join(map(_quote, fv.SOURCE_BLOCKLIST))}) OR {_regex('title', fv.CONSUMER_PATTERN)}
      OR (company_name IN ({firms}) AND contains(lower(title), lower(company_name)) AND {_regex('title', fv.ANALYST_ACTION_PATTERN)})
      OR {other})"""


MENTION = "(contains(lower(title), lower(name)) OR contains(lower(title), lower(symbol)))"
MATCHED = f"""matched AS (SELECT a.*, c.name, c.symbol, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS title_norm
  FROM {{articles}} a JOIN {{companies}} c ON c.id = a.company_id
  WHERE published_at IS NOT NULL AND trim(title) <> '' AND {MENTION}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY company_id, title_norm ORDER BY published_at DESC, id DESC) AS rn FROM matched)"""


def matched(t: Tables):
    return filters.mentions_company(t.articles, t.companies)


def kept(t: Tables):
    return dedup.dedup_exact(matched(t))


# --- sources -------------------------------------------------------------------------------------------------------


@query("valid_companies", "SELECT * FROM {companies} WHERE trim(name) <> '' AND trim(symbol) <> ''", "exposure")
def _(t: Tables):
    return tables.valid_companies(t.companies)


@query("relevant_ids", "SELECT DISTINCT id FROM {annotated} WHERE label = 'relevant'")
def _(t: Tables):
    return tables.relevant_ids(t.annotated.withColumnRenamed("label", "predicted_label"))


@query("semi_join_relevant", "SELECT id, company_id FROM {articles} WHERE id IN (SELECT id FROM {annotated} WHERE label = 'relevant')")
def _(t: Tables):
    ids = tables.relevant_ids(t.annotated.withColumnRenamed("label", "predicted_label"))
    return t.articles.select("id", "company_id").join(ids, "id", "left_semi")


@query("borderline_band", "SELECT id, p1 FROM {model_scores} WHERE p1 >= 0.65 AND p1 < 0.70", "p1")
def _(t: Tables):
    return tables.scores_between(t.model_scores.select("id", "p1"), "p1", 0.65, 0.70)


@query(
    "canonical_market_rows",
    """SELECT trade_date, '^VIX' AS symbol, close - 1 AS open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low, close,
      close AS adj_close, CAST(NULL AS BIGINT) AS volume, 'csv' AS source FROM {vix} WHERE close IS NOT NULL""",
    "open high low close adj_close",
)
def _(t: Tables):
    raw = t.vix.select(
        F.col("trade_date").cast("string").alias("Trade Date"),
        F.col("close").cast("string").alias("CLOSE"),
        (F.col("close") - 1).cast("string").alias("Open "),
    )
    return tables.canonical_ohlcv(raw)


@query(
    "benchmark_return",
    """SELECT date, r AS sp500_return FROM (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM {market}
      WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31') WHERE r IS NOT NULL""",
    "sp500_return",
)
def _(t: Tables):
    empty = t.market.filter("date < '1900-01-01'")
    return tables.benchmark_return(empty, t.market, start="1995-01-01", end="2001-12-31")


# --- sinks ---------------------------------------------------------------------------------------------------------


@query(
    "upsert_latest",
    """WITH u AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber DESC, l_extendedprice DESC) AS rn FROM {lineitem})
    SELECT o_orderkey AS id, o_totalprice AS price FROM {orders} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM u)
    UNION ALL SELECT l_orderkey, l_extendedprice FROM u WHERE rn = 1""",
    "price",
)
def _(t: Tables):
    base = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    updates = t.lineitem.select(
        F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_extendedprice").alias("price")
    )
    return sinks.upsert_latest(base, updates, ["id"], "l_linenumber")


@query(
    "insert_absent",
    """WITH b AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT * FROM b UNION ALL SELECT o_custkey, min(o_orderkey) FROM {orders} WHERE o_custkey NOT IN (SELECT k FROM b) GROUP BY 1""",
)
def _(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderstatus")
    base = rows.filter("o_orderstatus = 'F'").groupBy("k").agg(F.min("v").alias("v"))
    return sinks.insert_absent(base, rows.drop("o_orderstatus"), ["k"])


@query(
    "score_write_back",
    """SELECT a.id, coalesce(m.p1, a.pos_score) AS pos_score, coalesce(m.p2, a.neg_score) AS neg_score FROM {articles} a
    LEFT JOIN {model_scores} m ON m.id = a.id""",
    "pos_score neg_score",
)
def _(t: Tables):
    new = t.model_scores.select("id", F.col("p1").alias("pos_score"), F.col("p2").alias("neg_score"))
    return sinks.write_back(t.articles.select("id", "pos_score", "neg_score"), new, "id", ["pos_score", "neg_score"])


@query(
    "purge_failures_and_duplicates",
    f"""WITH {MATCHED} SELECT id FROM {{articles}} WHERE id NOT IN
      (SELECT a.id FROM {{articles}} a JOIN {{companies}} c ON c.id = a.company_id WHERE trim(title) = '' OR NOT {MENTION}
       UNION SELECT id FROM numbered WHERE rn > 1)""",
)
def _(t: Tables):
    bad = dedup.union_ids(filters.title_failures(t.articles, t.companies), dedup.duplicates(matched(t)))
    return sinks.purge(t.articles.select("id"), bad)


@query(
    "get_or_create_outlet_ids",
    """WITH d AS (SELECT DISTINCT source FROM {articles}), dim AS (SELECT CAST(row_number() OVER (ORDER BY source) AS BIGINT) AS id, source AS domain
        FROM d WHERE source < 'src2'), m AS (SELECT coalesce(max(id), 0) AS top FROM dim)
    SELECT * FROM dim UNION ALL SELECT top + row_number() OVER (ORDER BY source), source FROM d, m WHERE source >= 'src2'""",
)
def _(t: Tables):
    known = t.articles.select(F.col("source").alias("domain")).distinct()
    dim = sinks.assign_ids(known.filter("domain < 'src2'"), 0, [F.col("domain")]).select("id", "domain")
    return sinks.get_or_create_ids(dim, known, "domain").select("id", "domain")


@query(
    "assigned_ids",
    """SELECT o_orderkey, (SELECT max(doc_id) FROM {documents}) + row_number() OVER (ORDER BY o_orderkey) AS id FROM {orders}""",
)
def _(t: Tables):
    top = t.documents.select(F.max("doc_id")).scalar()
    return sinks.assign_ids(t.orders.select("o_orderkey"), top, [F.col("o_orderkey")])


@query(
    "assembled_articles",
    """SELECT a.id AS story_id, a.company_id, a.title, a.url, o.id AS media_outlet_id,
      CASE WHEN a.id % 2 = 0 THEN 'Daily' ELSE a.source END AS source, a.published_at,
      concat('{"language":"', d.lang, '","media_cloud_id":', a.id, '}') AS social_data
    FROM {articles} a JOIN {documents} d ON d.doc_id = a.id
    LEFT JOIN (SELECT source, min(media_outlet_id) AS id FROM {articles} GROUP BY 1) o ON o.source = a.source""",
)
def _(t: Tables):
    outlets = t.articles.groupBy(F.col("source").alias("domain")).agg(F.min("media_outlet_id").alias("id"))
    langs = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    stories = t.articles.drop("media_outlet_id").join(langs, "id").withColumn("media_name", F.when(F.col("id") % 2 == 0, "Daily"))
    return sinks.assemble_articles(stories.withColumnRenamed("id", "story_id"), outlets)


@query("pending_rows", "SELECT id FROM {articles} WHERE id NOT IN (SELECT id FROM {annotated})")
def _(t: Tables):
    return sinks.pending(t.articles.select("id"), t.annotated)


LEDGER = """ev AS (SELECT 'run' || CAST(o_orderkey % 2 AS STRING) AS run_key, o_custkey % 25 AS company_id, CAST(year(o_orderdate) AS BIGINT) AS year,
      o_orderkey AS event_time, CASE WHEN o_orderkey % 4 < 3 THEN 'completed' ELSE 'failed' END AS status FROM {orders}),
    ledger AS (SELECT run_key, company_id, year, arg_max(status, event_time) AS status FROM ev GROUP BY 1, 2, 3)"""


def _ledger(t: Tables):
    events = t.orders.select(
        F.concat(F.lit("run"), (F.col("o_orderkey") % 2).cast("string")).alias("run_key"),
        (F.col("o_custkey") % 25).alias("company_id"),
        F.year("o_orderdate").cast("long").alias("year"),
        F.col("o_orderkey").alias("event_time"),
        F.when(F.col("o_orderkey") % 4 < 3, "completed").otherwise("failed").alias("status"),
    )
    empty = events.drop("event_time").filter("false")
    return sinks.update_ledger(empty, events)


@query("run_ledger", f"WITH {LEDGER} SELECT * FROM ledger")
def _(t: Tables):
    return _ledger(t)


@query(
    "ledger_completion",
    f"""WITH {LEDGER} SELECT run_key, company_id, count(*) FILTER (status = 'completed') AS years_completed, count(*) AS years,
      count(*) FILTER (status = 'completed') = count(*) AS completed FROM ledger GROUP BY 1, 2""",
)
def _(t: Tables):
    return sinks.company_completion(_ledger(t))


@query("ledger_open_cells", f"WITH {LEDGER} SELECT run_key, company_id, year FROM ledger WHERE status <> 'completed'")
def _(t: Tables):
    cells = _ledger(t)
    return sinks.open_cells(cells.select(*sinks.LEDGER_KEYS), cells)


@query(
    "merged_json",
    """SELECT id, concat('{"symbol":"', symbol, '","state":"done","rank":"', CAST(id AS STRING), '"}') AS metadata FROM {companies}""",
)
def _(t: Tables):
    current = F.to_json(F.struct("symbol", F.lit("open").alias("state")))
    patch = F.to_json(F.struct(F.lit("done").alias("state"), F.col("id").cast("string").alias("rank")))
    return t.companies.select("id", sinks.merge_json(current, patch).alias("metadata"))


@query(
    "copied_articles",
    """SELECT id, title, company_id, pos_score, CAST(NULL AS DOUBLE) AS neutral_score FROM {articles}
    WHERE company_id IN (SELECT id FROM {companies} WHERE exposure > 0.5)""",
    "pos_score neutral_score",
)
def _(t: Tables):
    keep = t.companies.filter("exposure > 0.5").select(F.col("id").alias("company_id"))
    return sinks.copy_selected(t.articles, keep, ["id", "title", "company_id", "pos_score", "neutral_score"])


# --- filters and text ----------------------------------------------------------------------------------------------


@query(
    "date_window_and_scores",
    """SELECT id, pos_score - neg_score AS stance FROM {articles} WHERE CAST(published_at AS DATE) BETWEEN DATE '2016-01-01'
      AND DATE '2019-12-31' AND company_id IS NOT NULL AND pos_score IS NOT NULL AND neg_score IS NOT NULL AND neutral_score IS NOT NULL
      AND greatest(pos_score, neg_score, neutral_score) >= 0.5""",
    "stance",
)
def _(t: Tables):
    rows = filters.in_window(t.articles, "published_at", "2016-01-01", "2019-12-31", "company_id")
    return filters.scored_only(rows, 0.5).select("id", filters.stance().alias("stance"))


@query(
    "unscored_newest",
    """SELECT id, published_at FROM {articles} WHERE pos_score < 0.3 ORDER BY published_at DESC, id DESC LIMIT 100""",
)
def _(t: Tables):
    rows = t.articles.withColumn("pos_score", F.when(F.col("pos_score") >= 0.3, F.col("pos_score")))
    return filters.unscored_newest(rows, 100).select("id", "published_at")


@query("ticker_filter", "SELECT ticker, date, close FROM {prices} WHERE ticker IN ('F1', 'F5', 'F9')", "close")
def _(t: Tables):
    return filters.only_firms(t.prices, ["F1", "F5", "F9"])


@query("mentions_firm", f"WITH {MATCHED} SELECT id, company_id, name AS company_name FROM matched")
def _(t: Tables):
    return matched(t).select("id", "company_id", "company_name")


@query(
    "mentions_firm_like",
    """SELECT a.id FROM {articles} a JOIN {companies} c ON c.id = a.company_id WHERE published_at IS NOT NULL AND trim(title) <> ''
    AND (lower(title) LIKE '%' || lower(name) || '%' OR lower(title) LIKE '%' || lower(symbol) || '%')""",
)
def _(t: Tables):
    return filters.mentions_company(t.articles, t.companies, "like").select("id")


@query(
    "mentions_firm_normalised",
    """SELECT a.id FROM {articles} a JOIN {companies} c ON c.id = a.company_id
    WHERE contains(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))))
      OR contains(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), lower(symbol))""",
)
def _(t: Tables):
    return filters.mentions_company(t.articles, t.companies, "normalised").select("id")


@query(
    "mentions_firm_alias",
    """SELECT id FROM {headlines} WHERE company_name NOT IN ('Boeing', 'Goldman Sachs', 'Morgan Stanley') AND title <> '' AND
      CASE company_name WHEN 'Visa Inc.' THEN contains(lower(title), 'visa') WHEN 'Intel' THEN contains(lower(title), 'intel')
        WHEN 'Amazon' THEN contains(lower(title), 'amazon') OR contains(lower(title), 'aws') OR contains(lower(title), 'whole foods')
        ELSE contains(lower(title), lower(company_name)) END""",
)
def _(t: Tables):
    firms = t.headlines.select(
        F.col("company_id").alias("id"), F.col("company_name").alias("name"), F.col("company_symbol").alias("symbol")
    ).distinct()
    rows = t.headlines.drop("company_name", "company_symbol")
    return filters.mentions_company(rows, firms, "alias").select("id")


@query(
    "title_check_failures",
    f"""SELECT a.id, coalesce(title, '') AS title, coalesce(name, '') AS company_name, coalesce(symbol, '') AS symbol, published_at
    FROM {{articles}} a LEFT JOIN {{companies}} c ON c.id = a.company_id
    WHERE trim(coalesce(title, '')) = '' OR c.id IS NULL OR NOT {MENTION}""",
)
def _(t: Tables):
    return filters.title_failures(t.articles, t.companies)


@query(
    "title_check_sample",
    f"""SELECT a.id FROM {{articles}} a LEFT JOIN {{companies}} c ON c.id = a.company_id
    WHERE trim(coalesce(title, '')) = '' OR c.id IS NULL OR NOT {MENTION} ORDER BY published_at DESC NULLS LAST, a.id DESC LIMIT 25""",
)
def _(t: Tables):
    return filters.newest(filters.title_failures(t.articles, t.companies), 25).select("id")


@query("hard_filter", f"SELECT id FROM {{headlines}} WHERE {_forced(fv.HARD_EXCLUSIONS)}")
def _(t: Tables):
    return t.headlines.filter(relevance.hard_filter()).select("id")


@query(
    "post_filter",
    f"""SELECT h.id, CASE WHEN {_forced(fv.POST_EXCLUSIONS)} THEN 'irrelevant' ELSE CASE WHEN p1 >= 0.5 THEN 'relevant'
      ELSE 'irrelevant' END END AS predicted_label FROM {{headlines}} h JOIN {{model_scores}} m ON m.id = h.id""",
)
def _(t: Tables):
    rows = t.headlines.join(t.model_scores, "id").withColumn(
        "predicted_label", F.when(F.col("p1") >= 0.5, "relevant").otherwise("irrelevant")
    )
    return relevance.post_filter(rows).select("id", "predicted_label")


LABEL_RULES = f"""({_regex('title', fv.CONSUMER_PATTERN)} OR {_regex('title', fv.CRIME_PATTERN)} OR {_regex('title', fv.LIFESTYLE_PATTERN)}
      OR (company_name IN ({', '.join(map(_quote, fv.LABEL_ANALYST_FIRMS))}) AND {_regex('title', fv.ANALYST_ACTION_PATTERN)})
      OR (company_name = 'Visa Inc.' AND {_regex('title', fv.VISA_EXCLUSION)})
      OR (company_name = 'Intel' AND {_regex('title', fv.INTEL_EXCLUSION)}))"""


@query(
    "label_filter",
    f"""SELECT id, CASE WHEN {_regex('reason', fv.HEDGE_PATTERN)} THEN 'DROP'
      WHEN lower(trim(label)) = 'relevant' AND {LABEL_RULES} THEN 'irrelevant' ELSE lower(trim(label)) END AS label FROM {{headlines}}""",
)
def _(t: Tables):
    return relevance.label_filter(t.headlines).select("id", "label")


@query(
    "label_filter_report",
    f"""SELECT count(*) FILTER (a = 'DROP') AS dropped, count(*) FILTER (a <> 'DROP' AND a <> b) AS corrected, count(*) AS total FROM
      (SELECT lower(trim(label)) AS b, CASE WHEN {_regex('reason', fv.HEDGE_PATTERN)} THEN 'DROP'
      WHEN lower(trim(label)) = 'relevant' AND {LABEL_RULES} THEN 'irrelevant' ELSE lower(trim(label)) END AS a FROM {{headlines}})""",
)
def _(t: Tables):
    return training.label_corrections(t.headlines, relevance.label_filter(t.headlines))


@query("clean_labels", "SELECT id, lower(trim(label)) AS label FROM {headlines} WHERE lower(trim(label)) IN ('relevant', 'irrelevant')")
def _(t: Tables):
    return filters.clean_labels(t.headlines).select("id", "label")


@query(
    "text_keys",
    """SELECT a.id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS title_norm,
      sha256(concat(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), '|', lower(trim(regexp_replace(url, '\\s+', ' ', 'g'))))) AS article_hash,
      lower(replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), 'www.', '')) AS domain,
      trim(replace(replace(replace(replace(replace(replace(replace(concat(c.name, ' Inc., Corp. LLC'), ' Inc.', ''), ' Corp.', ''),
        ' Corporation', ''), ' Ltd.', ''), ' Limited', ''), ' LLC', ''), ',', '')) AS clean_name
    FROM {articles} a JOIN {companies} c ON c.id = a.company_id""",
)
def _(t: Tables):
    c = t.companies.select(F.col("id").alias("company_id"), "name")
    return t.articles.join(c, "company_id").select(
        "id",
        text.normalise(F.col("title")).alias("title_norm"),
        text.article_hash(F.col("title"), F.col("url")).alias("article_hash"),
        text.domain(F.col("url")).alias("domain"),
        text.clean_name(F.concat("name", F.lit(" Inc., Corp. LLC"))).alias("clean_name"),
    )


PARAGRAPH = """para AS (SELECT id, company_id, title, content, coalesce(list_filter(list_transform(string_split_regex(whole, '\\n{2,}|\\r\\n\\r\\n'),
      lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 80)[1], whole) AS paragraph
      FROM (SELECT *, regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g') AS whole FROM {articles}))"""


@query("first_paragraph", f"WITH {PARAGRAPH} SELECT id, paragraph FROM para")
def _(t: Tables):
    return t.articles.select("id", text.first_paragraph(F.col("content")).alias("paragraph"))


@query(
    "target_split",
    f"""WITH {PARAGRAPH}, chosen AS (SELECT h.id, company_name AS name, split_part(company_name, ' ', 1) AS word,
      CASE WHEN length(paragraph) > 100 AND contains(lower(paragraph), lower(split_part(company_name, ' ', 1))) THEN paragraph ELSE h.title END AS x
      FROM {{headlines}} h JOIN para p ON p.id = h.id),
    cut AS (SELECT *, CASE WHEN contains(lower(x), lower(name)) THEN name ELSE word END AS part FROM chosen),
    found AS (SELECT *, instr(lower(x), lower(part)) AS pos FROM cut),
    sides AS (SELECT id, x, CASE WHEN pos > 0 THEN substr(x, pos, length(part)) ELSE name END AS target,
      CASE WHEN pos > 0 THEN regexp_replace(substr(x, 1, pos - 1), '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(x, '^\\s+|\\s+$', '', 'g') END AS l,
      CASE WHEN pos > 0 THEN regexp_replace(substr(x, pos + length(part)), '^\\s+|\\s+$', '', 'g') ELSE '' END AS r FROM found)
    SELECT id, target, x AS text_used, CASE WHEN length(l) < 3 OR length(r) < 3 THEN x ELSE l END AS left_context,
      CASE WHEN length(l) < 3 OR length(r) < 3 THEN x ELSE r END AS right_context FROM sides""",
)
def _(t: Tables):
    rows = t.headlines.select("id", "title", "company_name").join(t.articles.select("id", "content"), "id")
    name = F.col("company_name")
    rows = rows.select("id", "company_name", text.choose_text(F.col("title"), text.first_paragraph(F.col("content")), name).alias("x"))
    rows = rows.withColumn("s", text.split_target(F.col("x"), name))
    return rows.select("id", F.col("s.target").alias("target"), F.col("x").alias("text_used"), F.col("s.left").alias("left_context"), F.col("s.right").alias("right_context"))


@query(
    "p_value_stars",
    """SELECT id, CASE WHEN p1 < 0.01 THEN concat(printf('%.3f', p1), '***') WHEN p1 < 0.05 THEN concat(printf('%.3f', p1), '**')
      WHEN p1 < 0.10 THEN concat(printf('%.3f', p1), '*') ELSE printf('%.3f', p1) END AS shown FROM {model_scores}""",
)
def _(t: Tables):
    return t.model_scores.select("id", text.stars(F.col("p1")).alias("shown"))


@query(
    "did_features",
    """SELECT a.id, coalesce(pos_score, 0) - coalesce(neg_score, 0) AS bias_score, strftime(published_at, '%Y-%m') AS year_month,
      CAST(CASE WHEN year(published_at) >= 2020 THEN 1 ELSE 0 END AS BIGINT) AS post_2020,
      CASE WHEN year(published_at) >= 2020 THEN exposure ELSE 0 END AS post_x_exposure
    FROM {articles} a JOIN {companies} c ON c.id = a.company_id""",
    "bias_score post_x_exposure",
)
def _(t: Tables):
    c = t.companies.select(F.col("id").alias("company_id"), "exposure")
    return filters.did_features(t.articles.join(c, "company_id")).select(
        "id", "bias_score", "year_month", "post_2020", "post_x_exposure"
    )


# --- joins and sets ------------------------------------------------------------------------------------------------


@query("article_company_join", "SELECT a.id, c.symbol FROM {articles} a JOIN {companies} c ON c.id = a.company_id")
def _(t: Tables):
    c = t.companies.select(F.col("id").alias("company_id"), "symbol")
    return t.articles.join(c, "company_id").select("id", "symbol")


@query(
    "article_company_left_join",
    """SELECT a.id, coalesce(c.symbol, '') AS company_symbol, coalesce(c.name, '') AS company_name FROM {articles} a
    LEFT JOIN {companies} c ON c.id = a.company_id""",
)
def _(t: Tables):
    c = t.companies.select(F.col("id").alias("company_id"), "symbol", "name")
    return t.articles.join(c, "company_id", "left").select(
        "id", F.coalesce("symbol", F.lit("")).alias("company_symbol"), F.coalesce("name", F.lit("")).alias("company_name")
    )


@query(
    "leakage_filter",
    """SELECT id FROM {annotated} WHERE source = 'llm_v2' AND lower(trim(title)) NOT IN
      (SELECT lower(trim(title)) FROM {annotated} WHERE source = 'gold_manual')""",
)
def _(t: Tables):
    rows = t.annotated
    return dedup.leakage_filter(rows.filter("source = 'llm_v2'"), rows.filter("source = 'gold_manual'")).select("id")


@query(
    "merged_label_sources",
    """SELECT id, arg_min(label, prio) AS label, arg_min(source, prio) AS source FROM
      (SELECT id, label, 'gold' AS source, 0 AS prio FROM {annotated} WHERE source = 'gold_manual'
       UNION ALL SELECT id, 'relevant', 'extra', 1 FROM {annotated}) GROUP BY 1""",
)
def _(t: Tables):
    gold = t.annotated.filter("source = 'gold_manual'").select("id", "label", F.lit("gold").alias("source"))
    extra = t.annotated.select("id", F.lit("relevant").alias("label"), F.lit("extra").alias("source"))
    return dedup.merge_sources(gold, extra)


@query(
    "bad_id_union",
    f"""WITH {MATCHED} SELECT a.id FROM {{articles}} a JOIN {{companies}} c ON c.id = a.company_id WHERE trim(title) = '' OR NOT {MENTION}
      UNION SELECT id FROM numbered WHERE rn > 1""",
)
def _(t: Tables):
    return dedup.union_ids(filters.title_failures(t.articles, t.companies), dedup.duplicates(matched(t)))


# --- deduplication -------------------------------------------------------------------------------------------------


@query("exact_dedup", f"WITH {MATCHED} SELECT id, company_id, title FROM numbered WHERE rn = 1")
def _(t: Tables):
    return kept(t).select("id", "company_id", "title")


@query("duplicate_report", f"WITH {MATCHED} SELECT id, title, rn FROM numbered WHERE rn > 1")
def _(t: Tables):
    return dedup.duplicates(matched(t)).select("id", "title", "rn")


TEXT_KEY = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


@query(
    "hash_dedup",
    f"""WITH h AS (SELECT id, company_id, published_at, sha256(concat({TEXT_KEY.replace('{c}', 'title')}, '|', {TEXT_KEY.replace('{c}', 'source')})) AS article_hash
        FROM {{articles}}), n AS (SELECT *, row_number() OVER (PARTITION BY company_id, article_hash ORDER BY id) AS rn FROM h
        WHERE (company_id, article_hash) NOT IN (SELECT (company_id, article_hash) FROM h WHERE published_at < TIMESTAMP '2016-01-01'))
    SELECT id, company_id, article_hash FROM n WHERE rn = 1""",
)
def _(t: Tables):
    rows = dedup.with_hash(t.articles, "title", "source").select("id", "company_id", "article_hash", "published_at")
    stored = rows.filter("published_at < TIMESTAMP '2016-01-01'")
    return dedup.dedup_hash(rows, stored).drop("published_at")


# --- matrices and distributions ------------------------------------------------------------------------------------

BY_YEAR = f"""WITH {MATCHED}, counts AS (SELECT symbol, CAST(year(published_at) AS BIGINT) AS year, count(*) AS article_count
  FROM numbered WHERE rn = 1 GROUP BY 1, 2)"""


def year_counts(t: Tables):
    return matrices.firm_year_counts(kept(t).withColumnRenamed("company_symbol", "symbol"))


@query("firm_year_counts", f"{BY_YEAR} SELECT * FROM counts")
def _(t: Tables):
    return year_counts(t)


_CELLS = ", ".join(f"CAST(coalesce(sum(article_count) FILTER (year = {y}), 0) AS BIGINT) AS y{y}" for y in YEARS)


@query(
    "firm_year_matrix",
    f"""{BY_YEAR} SELECT coalesce(symbol, 'Total') AS symbol, {_CELLS}, CAST(sum(article_count) AS BIGINT) AS total FROM counts
    GROUP BY ROLLUP (symbol)""",
)
def _(t: Tables):
    return matrices.firm_year_matrix(year_counts(t), YEARS)


@query(
    "firm_year_matrix_top10",
    f"""{BY_YEAR}, m AS (SELECT symbol, {_CELLS}, CAST(sum(article_count) AS BIGINT) AS total FROM counts GROUP BY 1
      ORDER BY total DESC, symbol LIMIT 10)
    SELECT * FROM m UNION ALL SELECT 'Total', {', '.join(f'CAST(sum(y{y}) AS BIGINT)' for y in YEARS)}, CAST(sum(total) AS BIGINT) FROM m""",
)
def _(t: Tables):
    return matrices.firm_year_matrix(year_counts(t), YEARS, top=10)


@query(
    "top_firms",
    """SELECT company_id, count(*) AS article_count FROM {articles} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def _(t: Tables):
    return matrices.top_k(matrices.company_counts(t.articles), "article_count", 5, "company_id")


@query(
    "firm_selection",
    f"""{BY_YEAR} SELECT symbol, 11 - count(*) FILTER (year BETWEEN 2015 AND 2025 AND article_count > 2) AS faults,
      CASE WHEN 11 - count(*) FILTER (year BETWEEN 2015 AND 2025 AND article_count > 2) <= 3 THEN 'KEPT' ELSE 'BOOTED' END AS status
    FROM counts GROUP BY 1""",
)
def _(t: Tables):
    return matrices.select_firms(year_counts(t), YEARS, min_n=2)


@query(
    "company_count_cdf",
    """SELECT company_id, article_count, row_number() OVER (ORDER BY article_count, company_id) AS cumulative_firms
    FROM (SELECT company_id, count(*) AS article_count FROM {articles} GROUP BY 1)""",
)
def _(t: Tables):
    return matrices.count_cdf(matrices.company_counts(t.articles))


@query(
    "company_count_distribution",
    """SELECT count(*) AS n_firms, CAST(sum(n) AS BIGINT) AS total_articles, avg(n) AS mean, stddev_pop(n) AS std, min(n) AS min, max(n) AS max,
      count(*) FILTER (n = 0) AS zero_count, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75,
      quantile_cont(n, 0.9) AS p90 FROM (SELECT company_id, count(*) AS n FROM {scored_events} GROUP BY 1)""",
    "mean std p25 p50 p75 p90",
)
def _(t: Tables):
    return matrices.count_distribution(matrices.company_counts(t.scored_events))


@query(
    "table_totals",
    f"""WITH {MATCHED} SELECT (SELECT count(*) FROM {{articles}}) AS rows_before, (SELECT count(DISTINCT company_id) FROM {{articles}}) AS firms_before,
      (SELECT count(*) FROM numbered WHERE rn = 1) AS rows_after, (SELECT count(DISTINCT company_id) FROM numbered WHERE rn = 1) AS firms_after""",
)
def _(t: Tables):
    return matrices.table_totals(t.articles, kept(t))


@query(
    "ingest_cell_stats",
    f"""WITH h AS (SELECT a.id, a.company_id, CAST(year(published_at) AS BIGINT) AS year, {MENTION} AS ok, published_at < TIMESTAMP '2017-01-01' AS stored,
      sha256(concat({TEXT_KEY.replace('{c}', 'title')}, '|', {TEXT_KEY.replace('{c}', 'a.source')})) AS hash
      FROM {{articles}} a JOIN {{companies}} c ON c.id = a.company_id),
    known AS (SELECT DISTINCT company_id, hash FROM h WHERE stored),
    f AS (SELECT h.company_id, year, ok, known.hash IS NOT NULL AS old,
      ok AND row_number() OVER (PARTITION BY h.company_id, h.hash, ok ORDER BY id) > 1 AS dup
      FROM h LEFT JOIN known ON known.company_id = h.company_id AND known.hash = h.hash)
    SELECT company_id, year, count(*) AS fetched, count(*) FILTER (old) AS existing, count(*) FILTER (NOT old AND NOT ok) AS filtered_title,
      count(*) FILTER (NOT old AND ok AND dup) AS filtered_duplicates, count(*) FILTER (NOT old AND ok AND NOT dup) AS inserted,
      CAST(2 * grouping(company_id) + grouping(year) AS BIGINT) AS level FROM f GROUP BY ROLLUP (company_id, year)""",
)
def _(t: Tables):
    c = t.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("symbol").alias("company_symbol"))
    rows = dedup.with_hash(t.articles.join(c, "company_id"), "title", "source")
    stored = rows.filter(F.col("published_at") < F.lit("2017-01-01").cast("timestamp"))
    flagged = dedup.ingest_flags(rows.withColumn("title_ok", filters.mention()), stored)
    return matrices.cell_stats(flagged.withColumn("year", F.year("published_at")))


# --- relevance and evaluation --------------------------------------------------------------------------------------

SCORED = "scored AS (SELECT h.*, p1 * 0.5 + p2 * 0.25 + p3 * 0.25 AS ensemble_prob FROM {headlines} h JOIN {model_scores} m ON m.id = h.id)"
CLASSIFIED = f"""{SCORED}, hard AS (SELECT *, {_forced(fv.HARD_EXCLUSIONS)} AS is_hard FROM scored),
  judged AS (SELECT id, company_id, company_name, title, CASE WHEN NOT is_hard THEN round_even(ensemble_prob, 4) END AS ensemble_prob,
    CASE WHEN NOT is_hard THEN round_even(adj_prob, 4) END AS adj_prob, CASE WHEN is_hard THEN '' ELSE rule_fired END AS rule_fired,
    CASE WHEN NOT is_hard AND adj_prob >= 0.65 THEN 'relevant' ELSE 'irrelevant' END AS predicted_label
    FROM {_adjusted('hard', 'ensemble_prob')})"""


def scored(t: Tables):
    return relevance.ensemble(t.headlines.join(t.model_scores, "id"), ["p1", "p2", "p3"], [2.0, 1.0, 1.0])


@query("score_ensemble", f"WITH {SCORED} SELECT id, ensemble_prob FROM scored", "ensemble_prob")
def _(t: Tables):
    return scored(t).select("id", "ensemble_prob")


@query(
    "rule_adjustment",
    f"WITH {SCORED} SELECT id, adj_prob, rule_fired FROM {_adjusted('scored', 'ensemble_prob')}",
    "adj_prob",
)
def _(t: Tables):
    return relevance.adjust_scores(scored(t)).select("id", "adj_prob", "rule_fired")


@query("rule_counts", f"WITH {SCORED} SELECT rule_fired, count(*) AS n FROM {_adjusted('scored', 'ensemble_prob')} WHERE rule_fired <> '' GROUP BY 1")
def _(t: Tables):
    return evaluation.rule_counts(relevance.adjust_scores(scored(t)))


@query("relevance_scoring", f"WITH {CLASSIFIED} SELECT id, ensemble_prob, adj_prob, rule_fired, predicted_label FROM judged", "ensemble_prob adj_prob")
def _(t: Tables):
    return relevance.classify(scored(t)).select("id", "ensemble_prob", "adj_prob", "rule_fired", "predicted_label")


@query("relevance_scoring_by_model", f"WITH {CLASSIFIED} SELECT id, adj_prob, predicted_label FROM judged", "adj_prob")
def _(t: Tables):
    def add(df):
        return relevance.score_batches(df, lambda pdf: pdf["p1"] * 0.5 + pdf["p2"] * 0.25 + pdf["p3"] * 0.25)

    rows = t.headlines.join(t.model_scores, "id")
    return relevance.classify(rows, score=add).select("id", "adj_prob", "predicted_label")


@query(
    "argmax_label",
    """SELECT id, greatest(p1, 1 - p1) AS confidence_score, CASE WHEN greatest(p1, 1 - p1) < 0.65 THEN 'uncertain'
      WHEN p1 > 1 - p1 THEN 'relevant' ELSE 'irrelevant' END AS predicted_label FROM {model_scores}""",
    "confidence_score",
)
def _(t: Tables):
    return relevance.argmax_label(t.model_scores, "p1").select("id", "confidence_score", "predicted_label")


JUDGED = """judged AS (SELECT a.id, a.label, a.source, a.company_id, m.p1, m.p2, m.p3, CASE WHEN p1 >= 0.75 THEN 'relevant'
  WHEN p1 <= 0.5 THEN 'irrelevant' ELSE 'uncertain' END AS predicted FROM {annotated} a JOIN {model_scores} m ON m.id = a.id)"""


def judged(t: Tables):
    return relevance.three_way(t.annotated.join(t.model_scores, "id"), "p1")


@query("three_way_decision", f"WITH {JUDGED} SELECT id, predicted FROM judged")
def _(t: Tables):
    return judged(t).select("id", "predicted")


@query("confusion_matrix", f"WITH {JUDGED} SELECT label, predicted, count(*) AS n FROM judged WHERE predicted <> 'uncertain' GROUP BY 1, 2")
def _(t: Tables):
    return evaluation.confusion(judged(t).filter("predicted <> 'uncertain'"))


@query(
    "class_report",
    f"""WITH {JUDGED}, c AS (SELECT label, predicted FROM judged WHERE predicted <> 'uncertain'),
    s AS (SELECT k AS class, count(*) FILTER (label = k) AS support, count(*) FILTER (label = k AND predicted = k) AS tp,
      count(*) FILTER (predicted = k) AS np FROM c, (VALUES ('relevant'), ('irrelevant')) v(k) GROUP BY 1)
    SELECT class, support, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, tp / support AS recall,
      2.0 * tp / (np + support) AS f1 FROM s""",
    "precision recall f1",
)
def _(t: Tables):
    return evaluation.class_report(judged(t).filter("predicted <> 'uncertain'"))


def _sweep_sql(score: str, points: list[float]) -> str:
    return f"""SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER ({score} >= t AND label = 'relevant') AS tp,
      count(*) FILTER ({score} >= t AND label <> 'relevant') AS fp, count(*) FILTER ({score} < t AND label = 'relevant') AS fn
      FROM judged, (VALUES {', '.join(f'(CAST({p} AS DOUBLE))' for p in points)}) v(t) GROUP BY 1"""


_RATES = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
      coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fp AS n_pred, coalesce(tp / nullif(tp + fp, 0), 0) >= 0.9 AS precision_ok"""


@query("threshold_sweep", f"WITH {JUDGED} SELECT *, {_RATES} FROM ({_sweep_sql('p1', fv.SWEEP_POINTS)})", "threshold precision recall f1")
def _(t: Tables):
    return evaluation.threshold_sweep(judged(t), "p1")


@query("solo_model_at_070", f"WITH {JUDGED} SELECT *, {_RATES} FROM ({_sweep_sql('p2', [0.7])})", "threshold precision recall f1")
def _(t: Tables):
    return evaluation.threshold_sweep(judged(t), "p2", [0.70])


# the three models, their ensemble, and the ensemble after the headline rules
_ALL_SCORES = ("p1", "p2", "p3", "ensemble_prob", "adj_prob")


@query(
    "best_thresholds",
    f"""WITH {SCORED}, labelled AS (SELECT s.* REPLACE (a.label AS label), m.p1, m.p2, m.p3 FROM scored s JOIN {{annotated}} a ON a.id = s.id
      JOIN {{model_scores}} m ON m.id = s.id),
    judged AS (SELECT id, label, p1, p2, p3, ensemble_prob, adj_prob FROM {_adjusted('labelled', 'ensemble_prob')}), r AS ("""
    + " UNION ALL ".join(f"SELECT *, {_RATES}, '{s}' AS score FROM ({_sweep_sql(s, fv.GRID_POINTS)})" for s in _ALL_SCORES)
    + ") SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY score ORDER BY f1 DESC, threshold) AS k FROM r WHERE n_pred > 0) WHERE k = 1",
    "threshold precision recall f1",
)
def _(t: Tables):
    rows = scored(t).drop("label").join(t.annotated.select("id", "label"), "id")
    return evaluation.compare_scores(relevance.adjust_scores(rows), list(_ALL_SCORES))


def _histogram_sql(edges: list[float]) -> str:
    pairs = ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in zip(edges, edges[1:]))
    return f"""WITH {JUDGED} SELECT lo, hi, count(*) FILTER (label = 'relevant' AND p1 >= lo AND p1 < hi) AS n
    FROM judged, (VALUES {pairs}) v(lo, hi) GROUP BY 1, 2"""


@query("score_histogram", _histogram_sql(fv.POSITIVE_BUCKETS), "lo hi")
def _(t: Tables):
    return evaluation.score_histogram(judged(t), "p1")


@query("score_histogram_all", _histogram_sql(fv.ALL_BUCKETS), "lo hi")
def _(t: Tables):
    return evaluation.score_histogram(judged(t), "p1", fv.ALL_BUCKETS)


@query(
    "ranked_errors",
    f"""WITH {JUDGED} SELECT id, p1, CASE WHEN label = 'irrelevant' THEN 'FP' ELSE 'FN' END AS error FROM judged
    WHERE label <> predicted AND predicted <> 'uncertain'""",
    "p1",
)
def _(t: Tables):
    return evaluation.errors(judged(t), "p1").select("id", "p1", "error")


@query("label_source_counts", "SELECT label, source, count(*) AS n FROM {annotated} GROUP BY 1, 2")
def _(t: Tables):
    return t.annotated.groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"))


VERDICTS = "v AS (SELECT id, CASE WHEN id % 4 < 2 THEN 'CONFIRM' ELSE 'REJECT' END AS verdict FROM {annotated})"


def verdicts(t: Tables, yes: str, no: str):
    return t.annotated.select("id", F.when(F.col("id") % 4 < 2, yes).otherwise(no).alias("verdict"))


@query(
    "second_pass_verdicts",
    f"""WITH {VERDICTS} SELECT a.id, CASE WHEN source = 'llm_v2' AND label = 'relevant' AND coalesce(verdict, 'REJECT') <> 'CONFIRM'
      THEN 'irrelevant' ELSE label END AS label FROM {{annotated}} a LEFT JOIN v ON v.id = a.id""",
)
def _(t: Tables):
    return training.apply_verdicts(t.annotated, verdicts(t, "CONFIRM", "REJECT")).select("id", "label")


@query(
    "audit_rate_by_firm",
    f"""WITH {VERDICTS}, a AS (SELECT company_id, coalesce(verdict, 'REJECT') = 'CONFIRM' AS flip FROM {{annotated}} x LEFT JOIN v ON v.id = x.id
      WHERE label = 'irrelevant')
    SELECT company_id, count(*) AS n_audited, count(*) FILTER (flip) AS n_flipped, count(*) FILTER (flip) * 100.0 / count(*) AS fn_rate,
      CASE WHEN count(*) FILTER (flip) * 100.0 / count(*) > 5 THEN 'action' WHEN count(*) FILTER (flip) * 100.0 / count(*) > 2 THEN 'warning'
        ELSE 'ok' END AS band FROM a GROUP BY 1""",
    "fn_rate",
)
def _(t: Tables):
    sample = t.annotated.filter("label = 'irrelevant'")
    return training.audit_rate(training.audit_verdicts(sample, verdicts(t, "RELEVANT", "IRRELEVANT")), ["company_id"])


@query(
    "annotations_joined_back",
    """SELECT a.id, l.label FROM {articles} a LEFT JOIN {annotated} l ON l.id = a.id""",
)
def _(t: Tables):
    return t.articles.select("id").join(t.annotated.select("id", "label"), "id", "left")


@query(
    "class_weights",
    """SELECT n / (2.0 * irr) AS w_irrelevant, least(n / (2.0 * rel), 1.5 * n / (2.0 * irr)) AS w_relevant FROM
      (SELECT count(*) AS n, count(*) FILTER (label = 'relevant') AS rel, count(*) FILTER (label = 'irrelevant') AS irr FROM {annotated})""",
    "w_irrelevant w_relevant",
)
def _(t: Tables):
    return training.class_weights(t.annotated)


@query(
    "sample_weights",
    "SELECT id, CAST(CASE WHEN source = 'gold_manual' THEN 5 ELSE 1 END AS DOUBLE) AS sample_weight FROM {annotated}",
    "sample_weight",
)
def _(t: Tables):
    return training.sample_weights(t.annotated).select("id", "sample_weight")


@query(
    "parsed_verdicts",
    """SELECT CAST(id AS STRING) AS id, CASE WHEN id % 4 < 2 THEN 'CONFIRM' ELSE 'REJECT' END AS verdict FROM {annotated}""",
)
def _(t: Tables):
    v = F.when(F.col("id") % 4 < 2, "CONFIRM").otherwise("REJECT")
    good = F.concat(F.lit('Here: [{"id": "'), F.col("id").cast("string"), F.lit('", "verdict": "'), v, F.lit('"}] done'))
    broken = F.concat(F.lit('[{"id": '), F.col("id").cast("string"), F.lit(', "title": "a "b" c", "verdict": "'), F.lower(v), F.lit('"},]'))
    answers = t.annotated.select(F.when(F.col("id") % 3 == 0, broken).otherwise(good).alias("response"))
    return training.parse_verdicts(answers)


# --- sampling (ordered by a hash that SQL engines do not share: rows and invariants are checked) --------------------


_KEY = "sha256(concat(CAST(id AS STRING), ':42'))"


def _first(columns: str, source: str, n: str, within: str = "") -> str:
    """SQL of the n rows with the smallest keys, within each group."""
    over = f"{f'PARTITION BY {within} ' if within else ''}ORDER BY {_KEY}, id"
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER ({over}) AS rn FROM {source}) AS ranked WHERE rn <= {n}"


@query("uniform_sample", _first("id, company_id", "{articles}", "100"))
def _(t: Tables):
    return training.sample_n(t.articles.select("id", "company_id"), 100)


@query("capped_per_firm", _first("id, company_id", "{articles}", "20", "company_id"))
def _(t: Tables):
    return training.cap_per_group(t.articles.select("id", "company_id"), ["company_id"], 20)


_ANNOTATED = "id, title, label, source, company_id"


@query("capped_per_firm_and_class", _first(_ANNOTATED, "{annotated}", "CASE WHEN label = 'relevant' THEN 4 ELSE 12 END", "company_id, label"))
def _(t: Tables):
    return training.cap_per_class(t.annotated, "company_id", 12)


@query(
    "stratified_sample_with_topup",
    f"""WITH base AS (SELECT {_ANNOTATED} FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY {_KEY}, id) AS rn,
      greatest(1, 60 // (SELECT count(DISTINCT company_id) FROM {{annotated}})) AS quota FROM {{annotated}}) AS q WHERE rn <= quota),
    rest AS (SELECT {_ANNOTATED} FROM {{annotated}} WHERE id NOT IN (SELECT id FROM base))
    SELECT * FROM base UNION ALL {_first(_ANNOTATED, "rest", "60 - (SELECT count(*) FROM base)")}""",
)
def _(t: Tables):
    return training.stratified_topup(t.annotated, "company_id", 60)


@query(
    "weighted_annotation_sample",
    f"""WITH gold AS (SELECT * FROM {{annotated}} WHERE source = 'gold_manual'),
    pool AS (SELECT id, company_id, title FROM {{articles}} WHERE id NOT IN (SELECT id FROM gold)),
    base AS (SELECT id, company_id, title FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY {_KEY}, id) AS rn,
      greatest(2, 120 // (3 * (SELECT count(DISTINCT company_id) FROM pool))) AS quota FROM pool) AS q WHERE rn <= quota),
    seen AS (SELECT company_id, count(*) AS c FROM gold WHERE label = 'relevant' GROUP BY 1),
    rest AS (SELECT p.*, -ln((CAST(concat('0x', substr(sha256(concat(CAST(id AS STRING), ':42')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
      * (coalesce(c, 0) + 1) AS k FROM pool p LEFT JOIN seen USING (company_id) WHERE id NOT IN (SELECT id FROM base))
    SELECT * FROM base UNION ALL SELECT id, company_id, title FROM (SELECT *, row_number() OVER (ORDER BY k, id) AS rn FROM rest) AS r
    WHERE rn <= 120 - (SELECT count(*) FROM base)""",
)
def _(t: Tables):
    gold = t.annotated.filter("source = 'gold_manual'")
    return training.weighted_sample(t.articles.select("id", "company_id", "title"), gold, 120, "company_id")


@query("capped_firm_sizes", "SELECT company_id, least(count(*), 20) AS n FROM {articles} GROUP BY 1")
def _(t: Tables):
    capped = training.cap_per_group(t.articles.select("id", "company_id"), ["company_id"], 20)
    return capped.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "capped_firm_class_sizes",
    "SELECT company_id, label, least(count(*), CASE WHEN label = 'relevant' THEN 4 ELSE 12 END) AS n FROM {annotated} GROUP BY 1, 2",
)
def _(t: Tables):
    capped = training.cap_per_class(t.annotated, "company_id", 12)
    return capped.groupBy("company_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fold_sizes",
    """SELECT label, f AS fold, count(*) // 5 + CASE WHEN f < count(*) % 5 THEN 1 ELSE 0 END AS n
    FROM {annotated}, (VALUES (CAST(0 AS BIGINT)), (1), (2), (3), (4)) v(f) GROUP BY 1, 2""",
)
def _(t: Tables):
    return training.assign_folds(t.annotated.select("id", "label"), 5).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stratified_folds",
    f"SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY {_KEY}, id) - 1) % 5 AS fold FROM {{annotated}}",
)
def _(t: Tables):
    return training.assign_folds(t.annotated.select("id", "label"), 5)


@query(
    "shuffled_training_rows",
    f"SELECT {_ANNOTATED}, row_number() OVER (ORDER BY {_KEY}, id) AS position FROM {{annotated}}",
)
def _(t: Tables):
    # the order is shown as a number, or a comparison without order would not see it
    shuffled = training.shuffle(t.annotated).withColumn("_row", F.monotonically_increasing_id())
    return rank_in_group(shuffled, [], [F.col("_row")], "position").drop("_row")


@query(
    "pseudo_labelled_set",
    f"""WITH gold AS (SELECT id, title, label, source, company_id FROM {{annotated}} WHERE source = 'gold_manual'),
    pool AS (SELECT a.id, title, company_id, CASE WHEN p1 >= 0.5 THEN 'relevant' ELSE 'irrelevant' END AS label,
      'pseudo_label' AS source FROM {{articles}} a JOIN {{model_scores}} m ON m.id = a.id
      WHERE greatest(p1, 1 - p1) >= 0.9 AND a.id NOT IN (SELECT id FROM gold))
    SELECT * FROM gold UNION ALL
    {_first(_ANNOTATED, "pool", "CASE WHEN label = 'relevant' THEN 10 ELSE 30 END", "company_id, label")}""",
)
def _(t: Tables):
    pool = t.articles.join(t.model_scores.select("id", F.col("p1").alias("p_rel")), "id").select("id", "title", "company_id", "p_rel")
    return training.pseudo_labels(pool, t.annotated, 0.9, 30, "company_id")


@query(
    "assembled_training_set",
    f"""WITH gold AS (SELECT id, title, label, source, CAST(company_id AS STRING) AS company_name FROM {{annotated}} WHERE source = 'gold_manual'),
    a AS (SELECT id, title, company_name, 'llm_v2' AS source, CASE WHEN {_regex('reason', fv.HEDGE_PATTERN)} THEN 'DROP'
        WHEN lower(trim(label)) = 'relevant' AND {LABEL_RULES} THEN 'irrelevant' ELSE lower(trim(label)) END AS label FROM {{headlines}}
      WHERE lower(trim(label)) IN ('relevant', 'irrelevant') AND id NOT IN (SELECT id FROM gold)),
    kept AS (SELECT * FROM a WHERE label <> 'DROP')
    SELECT * FROM gold UNION ALL
    {_first("id, title, label, source, company_name", "kept", "CASE WHEN label = 'relevant' THEN 10 ELSE 30 END", "company_name, label")}""",
)
def _(t: Tables):
    gold = t.annotated.filter("source = 'gold_manual'").withColumn("company_name", F.col("company_id").cast("string"))
    return training.training_set(gold, t.headlines, 30)


@query(
    "training_set_report",
    f"""WITH g AS (SELECT id, label, CAST(company_id AS STRING) AS company_name FROM {{annotated}} WHERE source = 'gold_manual'),
    a AS (SELECT id, company_name, CASE WHEN {_regex('reason', fv.HEDGE_PATTERN)} THEN 'DROP' WHEN lower(trim(label)) = 'relevant' AND {LABEL_RULES}
        THEN 'irrelevant' ELSE lower(trim(label)) END AS label FROM {{headlines}}
      WHERE lower(trim(label)) IN ('relevant', 'irrelevant') AND id NOT IN (SELECT id FROM g)),
    c AS (SELECT company_name, label, least(count(*), CASE WHEN label = 'relevant' THEN 10 ELSE 30 END) AS n, 0 AS gold FROM a
      WHERE label <> 'DROP' GROUP BY 1, 2 UNION ALL SELECT company_name, label, count(*), 1 FROM g GROUP BY 1, 2),
    s AS (SELECT sum(n) AS total, sum(n) FILTER (label = 'relevant') AS rel, sum(n) FILTER (gold = 1) AS gold,
      count(DISTINCT company_name) AS firms FROM c)
    SELECT CAST(total AS BIGINT) AS total, CAST(rel AS BIGINT) AS relevant, CAST(total - rel AS BIGINT) AS irrelevant,
      CAST(gold AS BIGINT) AS gold, firms, rel * 100.0 / total AS relevant_pct,
      CASE WHEN rel * 100.0 / total < 20 THEN 'low' WHEN rel * 100.0 / total > 45 THEN 'high' ELSE 'ok' END AS balance FROM s""",
    "relevant_pct",
)
def _(t: Tables):
    gold = t.annotated.filter("source = 'gold_manual'").withColumn("company_name", F.col("company_id").cast("string"))
    return training.training_report(training.training_set(gold, t.headlines, 30))


@query("headline_classifier_scores")
def _(t: Tables):
    return headline_classifier.held_out_scores(t.annotated).select("id", "label", "prediction")

"""Near duplicates, and the streaming operators drained over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import relevance, returns, similarity
from ..scale import shared_folder
from ..sources import sinks, tables
from ..streaming import incremental
from ..views import Tables
from .registry import query

NEAR_COLS = ("company_id", "id", "title")


_TFIDF = """tok AS (SELECT id, company_id, regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]{2,}') AS w FROM {articles}),
    gram AS (SELECT id, company_id, unnest(w) AS term FROM tok
      UNION ALL SELECT id, company_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tok),
    tf AS (SELECT company_id, id, term, count(*) AS tf FROM gram GROUP BY 1, 2, 3),
    voc AS (SELECT company_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
    docs AS (SELECT company_id, count(*) AS n FROM {articles} GROUP BY 1),
    raw AS (SELECT tf.company_id, id, tf.term, df, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS x FROM tf
      JOIN voc ON voc.company_id = tf.company_id AND voc.term = tf.term JOIN docs ON docs.company_id = tf.company_id),
    weights AS (SELECT company_id, id, term, df, x / sqrt(sum(x * x) OVER (PARTITION BY company_id, id)) AS w FROM raw)"""


@query("tfidf_weights", f"WITH {_TFIDF} SELECT * FROM weights", "w")
def _(t: Tables):
    return similarity.tfidf(t.articles.select(*NEAR_COLS), "company_id", "id", "title")


_PAIRS = f"""{_TFIDF},
    prints AS (SELECT company_id, id, sha256(string_agg(concat(term, ' ', round(w, 12)), '|' ORDER BY term)) AS f FROM weights GROUP BY 1, 2),
    reps AS (SELECT company_id, f, min(id) AS id FROM prints GROUP BY company_id, f),
    own AS (SELECT weights.* FROM weights JOIN reps USING (company_id, id)),
    pairs AS (SELECT a.company_id, a.id AS i, b.id AS j, sum(a.w * b.w) AS cosine FROM own a
      JOIN own b ON a.company_id = b.company_id AND a.term = b.term AND a.id < b.id GROUP BY 1, 2, 3 HAVING sum(a.w * b.w) >= 0.85)"""
# elimination in id order: a text joins the kept ones of its firm unless one of them is close
_GONE = f"""WITH RECURSIVE {_PAIRS},
    near AS (SELECT r.company_id, r.id, row_number() OVER (PARTITION BY r.company_id ORDER BY r.id) AS rn,
      coalesce(list(p.i) FILTER (p.i IS NOT NULL), CAST([] AS BIGINT[])) AS partners
      FROM reps r LEFT JOIN pairs p ON p.company_id = r.company_id AND p.j = r.id GROUP BY r.company_id, r.id),
    step AS (SELECT DISTINCT company_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept FROM near
      UNION ALL SELECT s.company_id, s.n + 1, CASE WHEN list_has_any(s.kept, x.partners) THEN s.kept ELSE list_append(s.kept, x.id) END
      FROM step s JOIN near x ON x.company_id = s.company_id AND x.rn = s.n + 1),
    final AS (SELECT company_id, arg_max(kept, n) AS kept FROM step GROUP BY 1),
    led AS (SELECT p.company_id, j AS id, min(i) AS leader, arg_min(cosine, i) AS cosine FROM pairs p JOIN final k ON k.company_id = p.company_id
      WHERE list_contains(k.kept, i) AND NOT list_contains(k.kept, j) GROUP BY 1, 2),
    gone AS (SELECT * FROM led UNION ALL SELECT p.company_id, p.id, coalesce(l.leader, r.id), coalesce(l.cosine, 1.0) FROM prints p
      JOIN reps r ON r.company_id = p.company_id AND r.f = p.f AND r.id <> p.id LEFT JOIN led l ON l.company_id = r.company_id AND l.id = r.id)"""


@query("near_duplicate_pairs", f"WITH {_PAIRS} SELECT * FROM pairs", "cosine")
def _(t: Tables):
    return similarity.near_duplicate_pairs(t.articles.select(*NEAR_COLS), "company_id", "id", "title")


@query(
    "near_duplicate_members",
    f"""WITH {_PAIRS} SELECT p.company_id, p.id, r.id AS rep, count(*) OVER (PARTITION BY p.company_id, p.f) AS n
    FROM prints p JOIN reps r ON r.company_id = p.company_id AND r.f = p.f""",
)
def _(t: Tables):
    return similarity.vector_classes(t.articles.select(*NEAR_COLS), "company_id", "id", "title")


@query("near_duplicates", f"{_GONE} SELECT company_id, id, leader, cosine FROM gone", "cosine")
def _(t: Tables):
    return similarity.near_duplicates(t.articles.select(*NEAR_COLS), "company_id", "id", "title")


@query("near_duplicate_survivors", f"{_GONE} SELECT company_id, id, title FROM {{articles}} WHERE id NOT IN (SELECT id FROM gone)")
def _(t: Tables):
    return similarity.leader_dedup(t.articles.select(*NEAR_COLS), "company_id", "id", "title")


def _stream(t: Tables, table: str) -> Tables:
    """The same views with one supplied table read as a stream of its files: the table is one file or a folder of them."""
    path = f"{t.sf_dir}/{table}.parquet"
    reader = t.spark.readStream.schema(getattr(t, table).schema)
    live = Tables(t.spark, t.sf_dir)
    # a stream reads folders, so a table in one file is named within the folder that holds it
    live._seen[table] = reader.parquet(path) if sinks.is_folder(t.spark, path) else reader.option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir)
    return live


def _drain(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


@query(
    "index_stream",
    """SELECT company_id, CAST(published_at AS DATE) AS article_date, count(*) AS n_articles, avg(pos_score - neg_score) AS mean_stance
    FROM {scored_events} GROUP BY 1, 2""",
    "mean_stance",
)
def _(t: Tables) -> DataFrame:
    at = shared_folder(t.spark)
    _drain(incremental.index_stream(_stream(t, "orders").scored_events, at + "/out", at + "/state"))
    return incremental.daily_totals(t.spark.read.parquet(at + "/out"))


@query(
    "ingest_stream",
    """SELECT DISTINCT company_id, sha256(concat(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), '|',
      lower(trim(regexp_replace(url, '\\s+', ' ', 'g'))))) AS article_hash
    FROM {articles} a JOIN {companies} c ON c.id = a.company_id
    WHERE contains(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), lower(name))
      OR contains(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), lower(symbol))""",
)
def _(t: Tables) -> DataFrame:
    at = shared_folder(t.spark)
    _drain(incremental.ingest_stream(_stream(t, "documents").articles, t.companies, at + "/out", at + "/state"))
    return t.spark.read.parquet(at + "/out").select("company_id", "article_hash")


@query(
    "score_stream",
    """SELECT id FROM {headlines}""",
)
def _(t: Tables) -> DataFrame:
    at = shared_folder(t.spark)
    score = lambda df: relevance.score_batches(df, lambda pdf: (pdf["id"] * 17 % 100) / 100)
    _drain(incremental.score_stream(_stream(t, "documents").headlines, score, at + "/out", at + "/state"))
    return t.spark.read.schema("id long").parquet(at + "/out").select("id")  # a store without rows names no columns


@query(
    "upsert_stream",
    """SELECT o_custkey AS k, CAST(max(o_orderkey) AS BIGINT) AS seq, arg_max(o_totalprice, o_orderkey) AS price, o_custkey % 8 AS part
    FROM {orders} GROUP BY o_custkey""",
    "price",
)
def _(t: Tables) -> DataFrame:
    at = shared_folder(t.spark)
    src = _stream(t, "orders").orders.select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 8).alias("part")
    )
    _drain(incremental.upsert_stream(src, at + "/out", at + "/state", ["k"], "seq", "part"))
    return t.spark.read.schema(src.schema).parquet(at + "/out")


# --- loads and reads of tables -------------------------------------------------------------------------------------


@query(
    "priced_companies",
    """SELECT c.id, c.symbol, c.name, p.date, p.close FROM (SELECT id, replace(symbol, 'N', 'F') AS symbol, name FROM {companies}) c
    JOIN {prices} p ON p.ticker = c.symbol""",
    "close",
)
def _(t: Tables):
    listed = t.companies.select("id", F.replace("symbol", F.lit("N"), F.lit("F")).alias("symbol"), "name")
    return returns.priced_companies(listed, t.prices).select("id", "symbol", "name", "date", "close")


@query(
    "market_levels_from_csv",
    """SELECT count(*) AS n_rows, count(*) FILTER (day(trade_date) = 13) AS n_corrupt, count(*) FILTER (day(trade_date) <> 13) AS n_levels,
      avg(close) FILTER (day(trade_date) <> 13) AS mean_level, min(trade_date) AS first_day FROM {vix}""",
    "mean_level",
)
def _(t: Tables):
    """The index levels go through a CSV file in which the levels of every 13th day are words."""
    path = shared_folder(t.spark)
    names = tables.SCHEMAS["vix_daily"].fieldNames()
    known = {"trade_date": F.col("trade_date"), "close": F.when(F.day("trade_date") == 13, "closed").otherwise(F.col("close").cast("string"))}
    t.vix.select(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in names]).write.csv(path, header=True)
    rows = tables.read_table(t.spark, "vix_daily", path, "csv", corrupt="_bad")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("_bad").alias("n_corrupt"), F.count("close").alias("n_levels"),
        F.avg("close").alias("mean_level"), F.min("trade_date").alias("first_day"),
    )


@query(
    "replaced_table",
    """SELECT id, symbol, CASE WHEN id % 5 = 0 THEN upper(concat(name, '!')) ELSE name END AS name, CAST(id % 5 = 0 AS BIGINT) AS updates FROM {companies}""",
)
def _(t: Tables):
    """A first load, a dry run, and a load of the upserted rows as the next version."""
    path = shared_folder(t.spark)
    rows = t.companies.select("id", "symbol", "name", F.lit(0).alias("updates"))
    sinks.replace_table(rows, path)
    sinks.replace_table(rows.limit(0), path, dry_run=True)
    changed = rows.filter("id % 5 = 0").withColumns({"name": F.upper(F.concat("name", F.lit("!"))), "updates": F.lit(1)})
    sinks.replace_table(sinks.upsert_latest(sinks.current_table(t.spark, path), changed, ["id"], "updates"), path)
    return sinks.current_table(t.spark, path)

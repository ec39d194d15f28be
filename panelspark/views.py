"""Domain tables derived from the supplied Parquet tables.

Each view is one SQL text that Spark and an ANSI engine both run; ``{name}`` stands for another table or view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import configure

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_SCORES = """CAST(({k} * 37) % 101 + 1 AS DOUBLE) / (({k} * 37) % 101 + ({k} * 53) % 103 + ({k} * 71) % 107 + 3) AS pos_score,
       CAST(({k} * 53) % 103 + 1 AS DOUBLE) / (({k} * 37) % 101 + ({k} * 53) % 103 + ({k} * 71) % 107 + 3) AS neg_score,
       CAST(({k} * 71) % 107 + 1 AS DOUBLE) / (({k} * 37) % 101 + ({k} * 53) % 103 + ({k} * 71) % 107 + 3) AS neutral_score"""


def _scores(key: str) -> str:
    return _SCORES.replace("{k}", key)


VIEWS = {
    "companies": """
SELECT CAST(n_nationkey AS BIGINT) AS id, concat('N', CAST(n_nationkey AS STRING)) AS symbol, n_name AS name,
       CAST(n_regionkey + 1 AS DOUBLE) / 5 AS exposure FROM {nation}""",
    "articles": f"""
SELECT d.doc_id AS id, d.doc_id % 25 AS company_id, d.doc_id % 20 AS media_outlet_id,
       CASE WHEN d.doc_id % 4 = 0 THEN concat(n.n_name, ' ', d.text)
            WHEN d.doc_id % 4 = 1 THEN concat('  ', upper(n.n_name), '   ', d.text)
            WHEN d.doc_id % 4 = 2 THEN concat(n.n_name, ' 20% off: ', d.text)
            ELSE d.text END AS title,
       d.text AS content, concat('https://www.', d.source, '.example.com/a/', CAST(d.doc_id AS STRING)) AS url,
       concat(d.source, '.example.com') AS source,
       CAST('2015-01-01 00:00:00' AS TIMESTAMP) + ((d.doc_id * 7919) % 96000) * INTERVAL '1' HOUR AS published_at,
       {_scores('d.doc_id')}
FROM {{documents}} d JOIN {{nation}} n ON n.n_nationkey = d.doc_id % 25""",
    "scored_events": f"""
SELECT o_orderkey AS id, o_custkey % 64 AS company_id, o_orderdate AS published_at,
       {_scores('o_orderkey')}
FROM {{orders}}""",
    "prices": """
SELECT concat('F', CAST(l_suppkey % 16 AS STRING)) AS ticker, CAST(l_shipdate AS DATE) AS date,
       avg(l_extendedprice / l_quantity) AS close FROM {lineitem} GROUP BY 1, 2""",
    "market": """
SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close FROM {lineitem} GROUP BY 1""",
    "vix": """
SELECT CAST(l_shipdate AS DATE) AS trade_date, 100 * avg(l_discount) AS close FROM {lineitem} GROUP BY 1""",
    "annotated": """
SELECT l.doc_id AS id, a.title, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'relevant' ELSE 'irrelevant' END AS label,
       CASE WHEN l.doc_id % 3 = 0 THEN 'gold_manual' ELSE 'llm_v2' END AS source, a.company_id
FROM {labels} l JOIN {articles} a ON a.id = l.doc_id""",
    "model_scores": """
SELECT id, CAST((id * 17) % 100 AS DOUBLE) / 100 AS p1, CAST((id * 29) % 100 AS DOUBLE) / 100 AS p2,
       CAST((id * 41) % 100 AS DOUBLE) / 100 AS p3 FROM {articles}""",
    # headlines worded so that every filter and rule finds some, with firm names and annotations
    "headlines": """
SELECT a.id, a.company_id, a.published_at,
       CASE a.company_id % 7 WHEN 0 THEN 'Visa Inc.' WHEN 1 THEN 'Intel' WHEN 2 THEN 'Goldman Sachs' WHEN 3 THEN 'Target'
            WHEN 4 THEN 'Amazon' WHEN 5 THEN 'Boeing' ELSE 'Nation Group' END AS company_name,
       concat('S', CAST(a.company_id % 7 AS STRING)) AS company_symbol,
       concat(split_part(concat('Student visa delays hit |Spy ring and street intel: |Goldman Sachs raises price target on |',
         'Airstrike target near |What to watch: |Foundation gives $5 million grant to |BRIEF-|Firm names head of marketing |',
         'the Netflix of India |Answer to the rival to |Competition with x |Taxi drivers struggle as |',
         'Board considers selling unit |Firm mulls bid, sources say |Ohio a big winner in |Texas lands jobs |',
         '$12 million lawsuit |$3m lawsuit: |Charity pledges $ and pays fine |Driver arrested |New holiday menu |',
         'Amazon AWS outage |Work visa and border patrol |Cyber  Monday picks ||||||||'), '|', CAST(a.id % 32 + 1 AS INTEGER)), a.title) AS title,
       CASE WHEN a.id % 31 = 0 THEN 'ESPN.com' ELSE a.source END AS source,
       CASE WHEN a.id % 9 = 0 THEN 'The subject is unclear' ELSE 'Names the firm' END AS reason,
       CASE WHEN a.id % 3 = 0 THEN 'irrelevant' WHEN a.id % 50 = 49 THEN 'unknown' ELSE ' Relevant' END AS label
FROM {articles} a""",
    # firm-days of 16 dense firms on the price calendar, used wherever stance meets returns
    "stance_days": f"""
SELECT id, concat('F', CAST(company_id % 16 AS STRING)) AS ticker, company_id % 16 AS company_id, published_at,
       pos_score, neg_score, neutral_score FROM {{scored_events}}""",
}


def _refs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Tables:
    """Lazy access to the supplied tables and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE_TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                df = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
            self._seen[name] = df
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in _refs(text)})


def oracle_text(query: str) -> str:
    """Turn SQL that names views as ``{view}`` into one statement with the views as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _refs(text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(query)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", text)

    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in needed)
    body = plain(query).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"

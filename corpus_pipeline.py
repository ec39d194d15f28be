"""The corpus pipeline: language, near duplicates, benchmark text, personal data and packing, one stage after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm.decontaminate import decontaminate
from panelspark.llm.language_id import language_id, learn
from panelspark.llm.minhash_dedup import near_duplicates
from panelspark.llm.packing import pack_documents
from panelspark.llm.personal_data import sanitise
from panelspark.scale import checkpointed


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin stay, with that language as ``lang``.

    Documents without letters and those that two languages encode alike go. A null id or text: the text decides.
    """
    out = language_id(docs, learn(docs)).filter("accepted")
    return out.withColumn("lang", F.col("lang_pred")).select(*docs.columns)



def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; so does a row without an id.

    Rows that share an id are one group, of which one row stays: that with the smallest text.
    """
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("doc_id")
    rest = [c for c in docs.columns if c != "text"]
    twice = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", *rest)).alias("row"))
    once = named.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(twice.select("row.*")).unionByName(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark stay. Rows that share an id are judged together; a row without an id is
    judged alone."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    nameless = checkpointed(docs.filter("doc_id IS NULL").withColumn("__row", F.monotonically_increasing_id()))

    def hits(rows: DataFrame, key: str) -> DataFrame:
        return decontaminate(rows, benchmark, key).filter("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()

    named = docs.filter("doc_id IS NOT NULL")
    named = named.join(hits(named, "doc_id"), "doc_id", "left_anti").select(*docs.columns)
    return named.unionByName(nameless.join(hits(nameless, "__row"), "__row", "left_anti").drop("__row"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; values and terms that disclose them are replaced in ``text``, and ``n_chars`` follows."""
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("personal_data", remove_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express compression, tokenizers or packing; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = _documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs

"""The queries over whole tables, by name, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracles
from .collocations import collocations
from .decontaminate import decontaminate
from .html_text import extract_text, learn_weights
from .language_id import held_out, language_id, learn
from .minhash_dedup import near_duplicates
from .packing import pack_documents
from .personal_data import find_personal_data
from .quality import quality_scores
from .spelling_variants import spelling_variants
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .topk_search import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(_table(spark, sf_dir, "documents"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extract_text(pages, learn_weights(pages)).select("page_id", "url", "text", "n_chars")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_token_counts,
        op3_suffix_array_dedup,
        op4_best_fit_packing,
        op5_minhash_dedup,
        op6_top_k,
        op7_html_text,
        op8_decontaminate,
        op9_language_id,
        op10_personal_data,
        op11_spelling_variants,
        op12_phrase_collocations,
        op13_quality_classifier,
    )
}

#: SQL for the queries that SQL can state: not tokenizers, packing into any numbers, learned weights and dictionaries, or
#: the places of regular-expression matches.
SQL: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op3_suffix_array_dedup": oracles.OP3,
    "op5_minhash_dedup": oracles.OP5,
    "op6_top_k": oracles.OP6,
    "op8_decontaminate": oracles.OP8,
    "op11_spelling_variants": oracles.OP11,
    "op12_phrase_collocations": oracles.OP12,
}

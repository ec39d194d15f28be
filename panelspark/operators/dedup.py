"""Exact and hash deduplication. Winners are picked by a partial aggregate, never by sorting a group of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import article_hash, normalise, normalise_or_empty
from ..scale import rank_in_group
from .filters import mentions_company


def _title_key(df: DataFrame, title: str) -> DataFrame:
    return df.withColumn("title_norm", normalise(F.coalesce(F.col(title), F.lit(""))))


def newest_copy(df: DataFrame, keys: list[str], id_col: str = "id", ts: str = "published_at") -> DataFrame:
    """Id of the newest row per key (later date, then higher id; undated rows last)."""
    return df.groupBy(*keys).agg(F.max(F.struct(ts, id_col)).alias("_w")).select(F.col(f"_w.{id_col}").alias(id_col))


def dedup_exact(
    df: DataFrame, keys: tuple = ("company_id",), title: str = "title", id_col: str = "id", ts: str = "published_at"
) -> DataFrame:
    """One row per (keys, normalised headline): the newest."""
    slim = _title_key(df.select(*keys, title, id_col, ts), title)
    return df.join(newest_copy(slim, [*keys, "title_norm"], id_col, ts), id_col, "left_semi")


def matched_and_deduped(articles: DataFrame, companies: DataFrame, mode: str = "sql") -> DataFrame:
    """Headlines that name their firm, one per firm and normalised headline."""
    return dedup_exact(mentions_company(articles, companies, mode))


def duplicates(df: DataFrame, keys: tuple = ("company_id",), title: str = "title") -> DataFrame:
    """Every row that dedup would drop, with its position ``rn`` (2, 3, ...) among its copies."""
    slim = _title_key(df.select(*keys, title, "id", "published_at"), title)
    group = [*keys, "title_norm"]
    repeated = slim.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    ranked = rank_in_group(
        slim.join(repeated, group, "left_semi").drop(title),
        group,
        [F.desc_nulls_last("published_at"), F.desc("id")],
        "rn",
    )
    return df.join(ranked.filter("rn > 1").select("id", "rn"), "id")


def with_hash(df: DataFrame, title: str = "title", url: str = "url") -> DataFrame:
    return df.withColumn("article_hash", article_hash(F.col(title), F.col(url)))


def dedup_hash(new: DataFrame, existing: DataFrame, keys: tuple = ("company_id",), order: str = "id") -> DataFrame:
    """Incoming rows whose hash is neither stored nor repeated earlier in the batch (lowest ``order`` first)."""
    group = [*keys, "article_hash"]
    fresh = new.join(existing.select(*group).distinct(), group, "left_anti")
    first = fresh.groupBy(*group).agg(F.min(order).alias(order))
    return fresh.join(first, [*group, order], "left_semi")


def ingest_flags(candidates: DataFrame, stored: DataFrame, keys: tuple = ("company_id",), order: str = "id") -> DataFrame:
    """Add ``is_existing`` (the hash is stored) and ``is_duplicate`` (an earlier candidate with a good title has it)."""
    group = [*keys, "article_hash"]
    known = stored.select(*group).distinct().withColumn("_known", F.lit(True))
    first = candidates.filter("title_ok").groupBy(*group).agg(F.min(order).alias("_first"))
    out = candidates.join(known, group, "left").join(first, group, "left")
    repeat = F.col("title_ok") & (F.col(order) > F.col("_first"))
    return out.withColumns({"is_existing": F.coalesce("_known", F.lit(False)), "is_duplicate": repeat}).drop("_known", "_first")


def leakage_filter(train: DataFrame, test: DataFrame, title: str = "title") -> DataFrame:
    """Training rows whose tidy headline does not occur in the test set."""
    key = lambda c: F.lower(F.trim(c))
    seen = test.select(key(F.col(title)).alias("_k")).distinct()
    return train.withColumn("_k", key(F.col(title))).join(seen, "_k", "left_anti").drop("_k")


def merge_sources(*frames: DataFrame, key: str = "id") -> DataFrame:
    """Union of label sources; for a key present in several, the first source wins."""
    tagged = None
    for i, df in enumerate(frames):
        df = df.withColumn("_prio", F.lit(i))
        tagged = df if tagged is None else tagged.unionByName(df, allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in (key, "_prio")]
    # ties inside one source fall to the smallest row, so that the result does not depend on arrival order
    best = tagged.groupBy(key).agg(F.min(F.struct("_prio", *rest)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def union_ids(*frames: DataFrame, key: str = "id") -> DataFrame:
    out = frames[0].select(key)
    for df in frames[1:]:
        out = out.unionByName(df.select(key))
    return out.distinct()

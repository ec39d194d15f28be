"""Incremental work as Structured Streaming: ingest, daily index, scoring and keyed upserts.

Sinks are Parquet folders. Every batch function is safe to run again for the same batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import article_hash
from ..operators.filters import mentions_company, stance
from ..operators.relevance import classify
from ..scale import checkpointed
from ..sources.sinks import upsert_latest


# Folders of a store that is keyed by a hash; a batch reads only those that its keys fall into.
BUCKETS = 64


# what Spark says of a folder that is not there, or that no batch with rows has written to
_NOTHING_YET = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _stored(batch: DataFrame, path: str) -> DataFrame | None:
    """What the store holds, or None before the first rows; every other failure to read it is raised."""
    try:
        return batch.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in _NOTHING_YET:
            return None
        raise


def _absent(batch: DataFrame, path: str, keys: list[str], bucket: str) -> DataFrame:
    """Rows of the batch, once per key, whose key the store at ``path`` doesn't have yet.

    The store is partitioned by ``bucket``, which follows from the keys. The buckets of the batch, at most BUCKETS, prune
    the folders that are read.
    """
    old = _stored(batch, path)
    if old is None:
        return batch
    touched = [r[0] for r in batch.select(bucket).distinct().collect()]
    return batch.join(old.filter(F.col(bucket).isin(touched)).select(*keys), keys, "left_anti")


def ingest_stream(stories: DataFrame, companies: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Headlines that name their firm, once per firm and hash of title and URL, however old they are.

    Of several new rows with one hash the earliest in (published_at, id) is kept; what the store holds stays. Rows without
    a title or URL are left out, as they could not be told apart. The store is partitioned by ``bucket`` of the hash.
    """
    named = stories.filter((F.trim("title") != "") & (F.trim("url") != ""))
    matched = mentions_company(named, companies, "normalised").withColumn("article_hash", article_hash(F.col("title"), F.col("url")))
    matched = matched.withColumn("bucket", F.pmod(F.xxhash64("article_hash"), F.lit(BUCKETS)).cast("int"))
    keys = ["company_id", "article_hash"]
    columns = matched.columns

    def write(batch: DataFrame, _: int) -> None:
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("published_at", "id")).alias("row")).select("row.*")
        # the new rows are stored before the folders that they were compared with are added to
        fresh = checkpointed(_absent(first, path, keys, "bucket"))
        fresh.write.mode("append").partitionBy("bucket").parquet(path)

    return matched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def index_stream(articles: DataFrame, path: str, checkpoint: str, firm: str = "company_id") -> DataStreamWriter:
    """Daily count and mean stance per firm, complete after every batch, with late rows in their day.

    ``path`` holds a sum per firm and day for each batch, written under the batch's number, so a batch that runs again
    replaces its own sums; ``daily_totals`` adds them up. What is stored grows with firms, days and batches, not rows.
    """
    scored = articles.filter(F.col("pos_score").isNotNull() & F.col("neg_score").isNotNull())

    def write(batch: DataFrame, number: int) -> None:
        daily = batch.groupBy(F.col(firm), F.to_date("published_at").alias("article_date"))
        sums = daily.agg(F.count(F.lit(1)).alias("n_articles"), F.sum(stance()).alias("stance_sum"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def daily_totals(sums: DataFrame, firm: str = "company_id") -> DataFrame:
    """The daily index from the stored sums."""
    n = F.sum("n_articles")
    return sums.groupBy(firm, "article_date").agg(n.alias("n_articles"), (F.sum("stance_sum") / n).alias("mean_stance"))


def score_stream(articles: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Score ids that are not in the output yet and append them; the output is partitioned by ``bucket`` of the id."""

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(["id"]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
        fresh = checkpointed(_absent(rows, path, ["id"], "bucket"))
        classify(fresh, score=score).write.mode("append").partitionBy("bucket").parquet(path)

    return articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def upsert_stream(updates: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, partition: str) -> DataStreamWriter:
    """Last write wins per key. Only the partitions a batch touches are read and replaced; ``partition`` must follow
    from the keys, and ``order`` stays in the table so that late updates lose."""

    def write(batch: DataFrame, _: int) -> None:
        old = _stored(batch, path)
        if old is None:
            old = batch.filter(F.lit(False))
        touched = old.join(batch.select(partition).distinct(), partition, "left_semi")
        both = touched.unionByName(batch)
        # the merged rows are stored before their partitions are replaced
        merged = checkpointed(upsert_latest(touched.filter(F.lit(False)), both, keys, order))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

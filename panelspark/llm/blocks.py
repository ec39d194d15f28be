"""Documents dealt into blocks of bounded size, the unit that tasks work on and that other blocks answer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 8 << 20
#: Rows that Python workers are handed at a time: a row is a whole text, so the default of 10,000 is too many.
BATCH_ROWS = 1_000


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session hands BATCH_ROWS of them to Python at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def size_class(total: int, each: int) -> int:
    """How many parts of about ``each`` bytes hold ``total``: the next power of two."""
    return 1 << max(0, (max(1, total) - 1) // each).bit_length()


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts; one scan of that column."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]


def in_blocks(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(block, doc_id, text). A hash of the id deals the rows, so neither a source nor a group of copies fills a block,
    and all rows of one id meet in one block."""
    key: Column = F.col(id_col).cast("long")
    return docs.select(
        F.pmod(F.xxhash64(key), F.lit(n)).alias("block"), key.alias("doc_id"), F.col(text_col).alias("text")
    )

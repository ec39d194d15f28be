"""Hierarchical residual packing of token pieces into sequences of a fixed length."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scale import checkpointed
from .blocks import in_small_batches
from .token_counts import model_path

TOKENIZER = "byte_bpe_50k"
SEQUENCE = 2048
GROUP_ITEMS = 16_384
#: Bins that a group hands on to the next round, the emptiest first. It bounds what a task of a later round holds, and no
#: row is lost by it: all other bins are final.
HAND_ON = 1_024
FAN_IN = 8
DOCUMENT_END = 0
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


@lru_cache(maxsize=2)
def _encoding(name: str):
    """The byte-level vocabulary by ranks, and the pattern that the tokenizer's own file splits by."""
    import public_tokenizers
    import tiktoken

    with open(model_path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, name: str = TOKENIZER) -> np.ndarray:
    """Ids of a whole text, then the id that ends a document. The special string is one token, as by the tokenizer's default."""
    encoding, out = _encoding(name), []
    for i, part in enumerate((text or "").split(SPECIAL)):
        if i:
            out.append(np.array([SPECIAL_ID], np.uint32))
        if part:
            out.append(encoding.encode_to_numpy(part, disallowed_special=()))
    return np.concatenate([*out, np.array([DOCUMENT_END], np.uint32)]).astype("<u4")


def cut_points(n: int, most: int) -> list[int]:
    """Starts of the pieces of n tokens: whole sequences behind a first piece that may be shorter."""
    first = n % most or most
    return [0, *range(first, n, most)]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, most: int = SEQUENCE, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); every document has a piece, if only of its end."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = token_ids(text, name)
                starts = cut_points(len(ids), most)
                for piece, (low, high) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((doc, piece, low, high - low, zlib.crc32(ids[low:high].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of every item, its offset there, and the fill of every bin.

    Room is an integer of at most ``most``, so open bins are kept in a stack for each room, and one integer has a bit for
    every room with a bin: the tightest fit is its lowest bit from the item's length on.
    """
    stacks: list[list[int]] = [[] for _ in range(most + 1)]
    rooms, fills = 0, []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = most, len(fills)
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += need
        left = room - need
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(b)
    return where, offset, np.array(fills, np.int64)


def _round(items: DataFrame, groups: int, level: int, most: int, last: bool) -> DataFrame:
    """Pack (item, length) within random groups: (item, bin, offset, fill, open). A bin's number is unique over all rounds."""
    schema = pa.schema([("item", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("open", pa.bool_())])

    def pack(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        table = table.sort_by("item")
        where, offset, fills = best_fit(table.column("length").to_numpy(), most)
        handed = np.zeros(len(fills), np.bool_)
        if not last:
            underfull = np.flatnonzero(fills < most)
            handed[underfull[np.argsort(fills[underfull], kind="stable")][:HAND_ON]] = True
        name = (level << 56) | (group << 24)
        return pa.table([table.column("item").combine_chunks(), pa.array(where | name), pa.array(offset), pa.array(fills[where]), pa.array(handed[where])], schema=schema)

    dealt = items.withColumn("group", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pack, "item long, bin long, offset long, fill long, open boolean")


def pack(pieces: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """Add (sequence_id, offset) to rows with a ``length`` of 1..``most``; as few sequences as best fit finds.

    Round 0 deals the items into random groups and packs each by best-fit decreasing. Bins with room left, the emptiest
    first, are the items of the next round, eight groups in one, until one group is left. Sequence ids are any numbers;
    offsets leave no gap. Whole sequences never enter a round. An empty table gives an empty table.
    """
    rows = checkpointed(pieces.withColumn("_item", F.monotonically_increasing_id()))
    n = rows.filter(F.col("length") < most).count()
    groups = max(1, -(-n // GROUP_ITEMS))
    level, items, placed = 0, rows.filter(F.col("length") < most).select(F.col("_item").alias("item"), "length"), None
    while True:
        last = groups == 1
        done = checkpointed(_round(items, groups, level, most, last))
        if placed is None:
            placed = done
        else:  # what was handed on moves with its bin
            moved = done.select(F.col("item").alias("bin"), F.col("bin").alias("_to"), F.col("offset").alias("_by"), F.col("open").alias("_open"))
            placed = placed.join(moved, "bin", "left").select(
                "item",
                F.coalesce("_to", "bin").alias("bin"),
                (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"),
            )
        if last:
            break
        handed = done.filter("open").groupBy("bin").agg(F.max("fill").alias("length"))
        items, groups, level = handed.withColumnRenamed("bin", "item"), max(1, -(-groups // FAN_IN)), level + 1
    placed = placed.select(F.col("item").alias("_item"), "bin", "offset")
    whole = F.col("_item").bitwiseOR(F.lit(64 << 56))
    return (
        rows.join(placed, "_item", "left")
        .withColumn("sequence_id", F.coalesce("bin", whole))
        .withColumn("offset", F.coalesce("offset", F.lit(0)))
        .drop("_item", "bin")
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE, name: str = TOKENIZER) -> DataFrame:
    """Tokenise every whole text, cut what is longer than a sequence, and pack all pieces.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset). Null and empty texts have one piece, the id that
    ends a document. Rows with equal or null ids are packed as documents of their own. Other columns are ignored.
    """
    return pack(token_pieces(docs, id_col, text_col, most, name), most)

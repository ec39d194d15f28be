"""Groups of words that differ by one edit: dense tiles of padded code-point matrices compared by prefix and suffix."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import checkpointed
from . import arrays as A
from .blocks import in_small_batches, size_class

MIN_LENGTH = 5
MIN_COUNT = 3
#: One of this many runs, told by a checksum of document and run, loses a code point before it is counted.
SLIP_EVERY = 97
#: A word's form must occur this many times as often as the word.
FORM_RATIO = 2
#: Words of one side of a tile; a key with more words is cut into blocks, and every pair of blocks is a tile of its own.
TILE_WORDS = 1024
#: Cells of a tile that are compared at a time.
CELLS = 1 << 20
_BUCKET_ROWS = 1 << 17
_HELD_WORDS = 300_000
_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _slipped(run: str, seed: int) -> str:
    """The run, or the run without one code point if its checksum says so."""
    h = zlib.crc32(run.encode(), seed)
    return run if h % SLIP_EVERY else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all documents, for words of at least MIN_LENGTH code points; a row without an id has the id ''."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                runs = Counter(_RUNS.findall((text or "").encode().translate(_LOWER).decode()))
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs.items():
                    if len(run) >= MIN_LENGTH and len(word := _slipped(run, seed)) >= MIN_LENGTH:
                        held[word] += n
            if len(held) > _HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    rows = in_small_batches(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cuts(m: int | np.ndarray):
    """Where words of a pair whose longer one has m code points are cut into three parts."""
    return m // 3, m - m // 3


def _keys() -> Column:
    """The tiles a word belongs to: of pairs whose longer word is as long as it or one longer (size), the parts of it that
    stay when the edit falls into the last, the middle or the first third (kind 0, 1, 2)."""
    out, length = [], F.char_length("word")
    for size in (length, length + 1):
        low = F.floor(size / 3).cast("int")
        high = (size - low).cast("int")
        head = F.substring(F.col("word"), F.lit(1), high)
        ends = F.concat_ws("_", F.substring(F.col("word"), F.lit(1), low), F.right(F.col("word"), low))
        tail = F.right(F.col("word"), high)
        for kind, part in enumerate((head, ends, tail)):
            out.append(F.struct(F.xxhash64(size, F.lit(kind), part).alias("key"), size.cast("int").alias("size"), F.lit(kind).alias("kind")))
    return F.array(*out)


def _matrix(raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, right: bool) -> np.ndarray:
    """Code points of the words, padded with zeros to ``width`` on the right or, if ``right``, on the left."""
    at = np.arange(width)[None, :] - ((width - size)[:, None] if right else 0)
    inside = (at >= 0) & (at < size[:, None])
    return np.where(inside, raw[np.minimum(start[:, None] + np.maximum(at, 0), len(raw) - 1)], 0)


def _common(a: np.ndarray, b: np.ndarray, order: range) -> np.ndarray:
    """Length of the common start of every row of a with every row of b, group by group; columns are read in ``order``."""
    alive = np.ones((a.shape[0], a.shape[1], b.shape[1]), np.bool_)
    out = np.zeros(alive.shape, np.int16 if a.shape[2] < 32_000 else np.int32)
    for j in order:
        alive &= a[:, :, None, j] == b[:, None, :, j]
        out += alive
        if not alive.any():
            break
    return out


def near_pairs(words: list[str], group: np.ndarray, size: np.ndarray, kind: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b), both ways, of one group that are one edit apart and whose edit lies in the part that the group leaves open.

    ``size`` is the longer length of the group's pairs and ``side`` the half of a tile (-1: every pair counts, else pairs of
    one half with the other). Each pair of different words comes out of exactly one group of all their keys.
    """
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(length) - length
    order = np.lexsort((group, size))
    edge = np.flatnonzero(np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (size[order][1:] != size[order][:-1]), [True]]))
    first, members = edge[:-1], np.diff(edge)
    first, members = first[members > 1], members[members > 1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    padded = 1 << np.ceil(np.log2(np.maximum(members, 2))).astype(np.int64)
    for m, s in sorted(set(zip(size[order[first]].tolist(), padded.tolist()))):
        mine = np.flatnonzero((size[order[first]] == m) & (padded == s))
        at_once = max(1, CELLS // (s * max(s, m)))
        for lo in range(0, len(mine), at_once):
            some = mine[lo : lo + at_once]
            place = first[some][:, None] + np.minimum(np.arange(s)[None, :], members[some][:, None] - 1)
            rows = order[place]  # groups x s, the last row repeated as padding
            real = np.arange(s)[None, :] < members[some][:, None]
            flat = rows.ravel()
            left = _matrix(raw, start[flat], length[flat], m, False).reshape(*rows.shape, m)
            right = _matrix(raw, start[flat], length[flat], m, True).reshape(*rows.shape, m)
            step = max(1, CELLS // (len(some) * s))
            for top in range(0, s, step):
                cut = slice(top, top + step)
                head = _common(left[:, cut], left, range(m))
                tail = _common(right[:, cut], right, range(m - 1, -1, -1))
                low, high = _cuts(m)
                which = kind[rows[:, :1]][:, :, None]
                part = np.where(head >= high, 0, np.where(head >= low, 1, 2))
                hit = (head.astype(np.int32) + tail >= m - 1) & (part == which) & real[:, cut, None] & real[:, None, :]
                hit &= (length[rows[:, cut]] == m)[:, :, None] | (length[rows] == m)[:, None, :]
                hit &= rows[:, cut, None] != rows[:, None, :]
                half = side[rows]
                hit &= (half[:, cut, None] < 0) | (half[:, cut, None] != half[:, None, :])
                g, a, b = np.nonzero(hit)
                found.append((rows[g, a + top], rows[g, b]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _tiles(words: DataFrame) -> DataFrame:
    """Every word with the tiles it belongs to: (key, size, kind, i, j, side, word, n)."""
    keyed = words.select("word", "n", F.explode(_keys()).alias("k")).select("word", "n", "k.*")
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > TILE_WORDS)
    large = large.select("key", F.ceil(F.col("_c") / TILE_WORDS).cast("int").alias("_blocks"))
    dealt = keyed.join(large, "key", "left").withColumn("_b", F.pmod(F.xxhash64("word"), F.coalesce("_blocks", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
    return dealt.select(
        "key", "size", "kind", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"),
        F.when(F.col("_b") == F.col("_o"), -1).otherwise((F.col("_b") > F.col("_o")).cast("int")).alias("side"), "word", "n",
    )


def near_words(words: DataFrame) -> DataFrame:
    """Of (word, n) with distinct words: word, n, n_near, best_n and best, the near word of largest n (ties: the first)."""
    total = words.count()
    buckets = size_class(total * 6, _BUCKET_ROWS)

    def compared(table: pa.Table) -> pa.Table:
        text = A.column(table, "word").to_pylist()
        column = lambda name: A.column(table, name).to_numpy(zero_copy_only=False).astype(np.int64)
        n, side = column("n"), column("side")
        _, group = np.unique(np.stack([column("key"), column("i"), column("j")]), axis=1, return_inverse=True)
        a, b = near_pairs(text, group.ravel(), column("size"), column("kind"), side)
        ranks = {w: r for r, w in enumerate(sorted(set(text)))}
        rank = np.array([ranks[w] for w in text], np.int64)
        order = np.lexsort((rank[b], -n[b], rank[a]))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.concatenate([[True], rank[a][1:] != rank[a][:-1]])) if len(a) else a
        near = np.diff(np.append(at, len(a)))
        return pa.table(
            {
                "word": pa.array([text[i] for i in a[at]], pa.string()),
                "n": pa.nulls(len(at), pa.int64()),
                "n_near": pa.array(near, pa.int64()),
                "best_n": pa.array(n[b[at]], pa.int64()),
                "best": pa.array([text[i] for i in b[at]], pa.string()),
            }
        )

    schema = "word string, n long, n_near long, best_n long, best string"
    tiles = _tiles(words).withColumn("bucket", F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets)))
    # words go along with their tiles' results, so that one shuffle adds both
    some = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))))
    out = some.unionByName(tiles.groupBy("bucket").applyInArrow(compared, schema))
    out = out.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): chains are halved by joining them with themselves. A form occurs at least twice as
    often as its word, so a chain is short and never closes."""
    chains = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        nxt = chains.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = chains.join(nxt, "root", "left")
        chains = checkpointed(longer.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if chains.filter("_moved").isEmpty():
            return chains.select("word", "root")
        chains = chains.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word of at least MIN_LENGTH code points and MIN_COUNT occurrences: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters, A-Z in lower case. Two words are near if one inserted, deleted or replaced code point
    tells them apart; ``form`` is the near word that occurs most often (ties: the first in code-point order), if it occurs
    FORM_RATIO times as often as the word, and ``root`` the end of the chain of forms.

    Near words share two of three parts of the longer one, so a word meets only the words of six keys; within a key the words
    form dense matrices, and common prefix plus common suffix decide. A key of more than TILE_WORDS words is cut into
    blocks, whose pairs are dealt to different tasks. Null and empty texts have no words; repeated rows count each;
    the checksum of a row without an id is that of the empty id. Columns besides the id and the text are not read.
    """
    words = checkpointed(word_counts(docs, id_col, text_col).filter(F.col("n") >= MIN_COUNT))
    near = checkpointed(near_words(words))
    is_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    near = near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n"))
    roots = _roots(near.filter("form IS NOT NULL"))
    out = near.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""TF-IDF features and near-duplicate removal inside groups, without forming all pairs of a group."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..scale import checkpointed, rank_in_group
from ..session import NEAR_DUP_COSINE

_EPS = 1e-9


def _words(text: str):
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1))


#: Texts whose terms are counted at a time, and terms of one block of counts.
_TEXTS, _BLOCK = 64, 1 << 17


def _counted(keys: list[str], ngram: tuple[int, int]):
    """From rows (keys, _words) sorted by their keys: (keys, _term, tf), the n-grams of every key and how often it has them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[tuple, Counter]] = []
        size, types = 0, None

        def block() -> pa.RecordBatch:
            owner = pa.array(np.repeat(np.arange(len(done)), [len(c) for _, c in done]))
            heads = [pa.array([k[i] for k, _ in done], t).take(owner) for i, t in enumerate(types)]
            names, tf = ([x for _, c in done for x in part(c)] for part in (Counter.keys, Counter.values))
            return pa.RecordBatch.from_arrays([*heads, pa.array(names, pa.string()), pa.array(tf, pa.int64())], [*keys, "_term", "tf"])

        for batch in batches:
            types = [batch.column(k).type for k in keys]
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                for *key, words in zip(*(part.column(c).to_pylist() for c in (*keys, "_words"))):
                    # rows that share their keys are one text; a block ends before the next text begins
                    if not done or done[-1][0] != tuple(key):
                        size += len(done[-1][1]) if done else 0
                        if size >= _BLOCK:
                            yield block()
                            done, size = [], 0
                        done.append((tuple(key), Counter()))
                    for n in range(ngram[0], ngram[1] + 1):
                        done[-1][1].update(words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n)))))
        if done:
            yield block()

    return counted


def term_counts(df: DataFrame, group: str, id_col: str, text: str, ngram: tuple[int, int]) -> DataFrame:
    """(group, id, _term, tf): how often every text of a group has each n-gram of its words. Texts are dealt by their ids before
    they are split, so that the terms of a text are counted where they are."""
    rows = df.filter(F.col(group).isNotNull()).select(group, id_col, text).repartition(group, id_col).sortWithinPartitions(group, id_col)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"`{group}` {types[group]}, `{id_col}` {types[id_col]}, _term string, tf long"
    return rows.select(group, id_col, _words(text).alias("_words")).mapInArrow(_counted([group, id_col], ngram), schema)


def _weights(df: DataFrame, group: str, id_col: str, text: str, ngram: tuple[int, int], max_terms: int | None, spelled: bool) -> DataFrame:
    """(group, id, df, term, x): the weights of ``vectors`` before they are scaled, a row per term, with the rows of a text together."""
    term = F.col("_term") if spelled else F.xxhash64("_term")
    # read twice below, so the texts are split only once
    counts = checkpointed(term_counts(df, group, id_col, text, ngram).select(group, id_col, term.alias("term"), "tf"))
    vocab = counts.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("_total"))
    if max_terms is not None:
        vocab = rank_in_group(vocab, [group], [F.desc("_total"), F.asc("term")], "_rank").filter(F.col("_rank") <= max_terms)
        rows = counts.join(vocab.select(group, "term", "df"), [group, "term"])
    else:
        # most terms are those of one text alone, which need not be looked up
        rows = counts.join(vocab.filter("df > 1").select(group, "term", "df"), [group, "term"], "left").withColumn("df", F.coalesce("df", F.lit(1).cast("long")))
    # a row per group, or the join would deal the terms out by their groups
    docs = F.broadcast(df.groupBy(group).agg(F.count(F.lit(1)).alias("_docs")))
    idf = F.ln((1 + F.col("_docs")) / (1 + F.col("df"))) + 1
    # dealt by text before any rows are put together, as the terms of a text come from everywhere
    return rows.join(docs, group).select(group, id_col, "df", "term", ((1 + F.ln("tf")) * idf).alias("x")).repartition(group, id_col)


def vectors(
    df: DataFrame, group: str, id_col: str, text: str, ngram: tuple[int, int] = (1, 2), max_terms: int | None = None, spelled: bool = False
) -> DataFrame:
    """(group, id, v): per text with terms its vector, an array of (df, term, w) from the rarest term to the most frequent.

    Sublinear term frequency times smoothed idf, scaled to unit length, fitted per group. With ``max_terms`` only that many of
    the most frequent terms of each group are kept; by default all are. A term is its 64-bit hash, which makes the shuffles
    a third as large, or with ``spelled`` its words.
    """
    rows = _weights(df, group, id_col, text, ngram, max_terms, spelled).select(group, id_col, F.struct("df", "term", F.col("x").alias("w")).alias("_e"))
    # the length is an aggregate of its own: as an expression it would be worked out again for every element of the array
    squares = F.sum(F.col("_e.w") * F.col("_e.w"))
    out = rows.groupBy(group, id_col).agg(F.sort_array(F.collect_list("_e")).alias("_v"), F.sqrt(squares).alias("_len"))
    scaled = F.transform("_v", lambda e: F.struct(e["df"].alias("df"), e["term"].alias("term"), (e["w"] / F.col("_len")).alias("w")))
    return out.select(group, id_col, scaled.alias("v"))


def tfidf(df: DataFrame, group: str, id_col: str, text: str, ngram: tuple[int, int] = (1, 2), max_terms: int | None = None) -> DataFrame:
    """(group, id, term, df, w): the same, a row per term, spelled out."""
    if max_terms is None:
        return _corpus(df, group, id_col, text, ngram).weights()
    rows = _weights(df, group, id_col, text, ngram, max_terms, spelled=True)
    # a window holds the terms of one text
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(group, id_col)))
    return rows.select(group, id_col, "term", "df", (F.col("x") / length).alias("w"))


#: Words of one block of texts, terms of one bucket of the vocabulary, and rounds in which the buckets are counted.
_WORDS, _BUCKET, _ROUNDS = 1 << 19, 1 << 21, 2
#: A term is told by 64 bits and by a prefix of 16 others, whose ranges are the buckets.
_PREFIX = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stable_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by the keys, numbers from 0 on, the last one first: in digits of 16 bits, which numpy counts."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, int(key.max(initial=0)).bit_length(), 16):
            order = order[np.argsort((key[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Where a row of the sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _flat(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and the sizes of the lists."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, one byte of all of them after the other."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zlib.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : packed[0]] = planes.T
    return out.view("<i8").ravel()


def _stored(df: DataFrame) -> DataFrame:
    """``checkpointed``, whose shuffles go with the write and don't wait for the driver to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return checkpointed(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


#: A block of texts as it is stored: n words; keys, documents of the group and its hash per text; distinct words; of each word
#: its number; of each row its words and whether a text begins.
_BLOCK_COLUMNS = "heads binary, words binary, numbers binary, sizes binary, begins binary"


def _text_blocks(keys: list[str]):
    """From rows (keys, _docs, _g, _words) sorted by their keys: (block, n, _BLOCK_COLUMNS), a row per block of about _WORDS words."""

    def block(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held)
        words, sizes = _flat(part, "_words")
        if not len(words):
            return
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        # small numbers for frequent words
        order = np.argsort(-np.bincount(at), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        rows = list(zip(*(part.column(k).to_pylist() for k in keys)))
        # rows that share their keys are one text
        begins = np.array([i == 0 or rows[i] != rows[i - 1] for i in range(len(rows))])
        heads = part.select([*keys, "_docs", "_g"]).take(pa.array(np.flatnonzero(begins))).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, heads.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(heads)
        spelled = zlib.compress("\n".join(coded.dictionary.take(pa.array(order)).to_pylist()).encode(), 1)
        packed = [sink.getvalue().to_pybytes(), spelled, _packed(rank[at]), _packed(sizes), _packed(begins)]
        name = TaskContext.get().partitionId() << 32 | number
        columns = [pa.array([name]), pa.array([len(at)]), *(pa.array([x], pa.binary()) for x in packed)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "n", "heads", "words", "numbers", "sizes", "begins"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, number, last = [], 0, 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                rows = list(zip(*(part.column(k).to_pylist() for k in keys)))
                # a block ends before a text begins
                cut = next((i for i, row in enumerate(rows) if row != (rows[i - 1] if i else last)), None)
                if words >= _WORDS and cut is not None:
                    yield from block([*held, part.slice(0, cut)], number)
                    held, words, number, part = [], 0, number + 1, part.slice(cut)
                held.append(part)
                words += len(part.column("_words").flatten())
                last = rows[-1]
        if held:
            yield from block(held, number)

    return blocks


@dataclass
class _Grams:
    """The n-grams of a block in the order of their terms, equal ones in the order of the texts: term, prefix, text, place and length."""

    heads: pa.Table
    words: pa.Array
    numbers: np.ndarray
    term: np.ndarray
    prefix: np.ndarray
    text: np.ndarray
    place: np.ndarray
    length: np.ndarray

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Where a term begins, and where a term of a text does."""
        term = _first_of(self.term)
        return term, term | _first_of(self.text)


def _grams(row: dict, ngram: tuple[int, int], wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> _Grams:
    """Of a stored block the n-grams, those with a wanted prefix."""
    heads = pa.ipc.open_stream(row["heads"]).read_all()
    words = zlib.decompress(row["words"]).decode().split("\n")
    known = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in words), "<u8").reshape(-1, 2).T.copy()
    numbers, sizes, begins = (_unpacked(row[c]) for c in ("numbers", "sizes", "begins"))
    line = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    text = (np.cumsum(begins) - 1).astype(np.int32)[line]
    group = heads.column("_g").to_numpy().view(np.uint64)[text]
    seeds, found = [group, _mixed(group + _MIX)], []
    for n in range(1, ngram[1] + 1):
        here = len(numbers) - n + 1
        if here <= 0:
            break
        seeds = [_mixed(seed[:here] * _MIX + known[i][numbers[n - 1 :]] + np.uint64(n)) for i, seed in enumerate(seeds)]
        if n >= ngram[0]:
            prefix = (seeds[1] >> np.uint64(64 - _PREFIX)).astype(np.uint16)
            within = line[:here] == line[n - 1 :]  # an n-gram is one of a row
            at = np.flatnonzero(within if wanted is None else within & wanted(prefix)).astype(np.int32)
            found.append((seeds[0][at].view(np.int64), prefix[at], text[at], at, np.full(len(at), n, np.int32)))
    seeds = group = line = None  # freed before the order is found
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
    # stable in each length, so equal terms are in the order of the texts
    order = np.argsort(columns[0], kind="stable")
    return _Grams(heads, pa.array(words, pa.string()), numbers, *(c[order] for c in columns))


def _sent_terms(ngram: tuple[int, int], buckets: int, turn: int):
    """From stored blocks: (bucket, block, counts, terms, n), the terms of a block in the buckets whose turn it is, in the order of
    prefix and term: how many each prefix has, their 64 bits, and in how many texts each is."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = lambda prefix: prefix.astype(np.int64) * buckets >> _PREFIX
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                grams = _grams(row, ngram, lambda prefix: bucket_of(prefix) % _ROUNDS == turn)
                if not len(grams.term):
                    continue
                begins, pairs = grams.names()
                first = np.flatnonzero(begins)
                n = np.add.reduceat(pairs.astype(np.int64), first)
                order = _stable_order(grams.prefix[first])
                term, prefix, n = grams.term[first][order], grams.prefix[first][order], n[order]
                bucket = bucket_of(prefix)
                starts = np.flatnonzero(_first_of(bucket))
                out = []
                for at, end in zip(starts, [*starts[1:], len(bucket)]):
                    low = -(-(int(bucket[at]) << _PREFIX) // buckets)
                    out.append((int(bucket[at]), row["block"], _packed(np.bincount(prefix[at:end].astype(np.int64) - low)), term[at:end].tobytes(), _packed(n[at:end])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    ["bucket", "block", "counts", "terms", "n"],
                )

    return sent


def _term_texts(part: pa.Table) -> pa.Table:
    """From the rows of one bucket: (block, bucket, df), in how many texts of all blocks each term is, in the order it was sent."""
    counts = [_unpacked(x) for x in part.column("counts").to_pylist()]
    prefix = np.concatenate([np.repeat(np.arange(len(c)), c) for c in counts])
    term = np.frombuffer(b"".join(part.column("terms").to_pylist()), np.int64)
    n = np.concatenate([_unpacked(x) for x in part.column("n").to_pylist()])
    order = np.argsort(term, kind="stable")
    order = order[_stable_order(prefix[order])]
    first = np.flatnonzero(_first_of(prefix[order], term[order]))
    df = np.empty_like(n)
    df[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(n))))
    ends = np.cumsum([c.sum() for c in counts])
    packed = [_packed(df[at:end]) for at, end in zip([0, *ends[:-1]], ends)]
    return pa.table({"block": part.column("block"), "bucket": part.column("bucket"), "df": pa.array(packed, pa.binary())})


@dataclass
class _Texts:
    """The texts of a block that have terms: their numbers, sizes, and the terms of all of them in the order of df and term."""

    grams: _Grams
    number: np.ndarray
    sizes: np.ndarray
    at: np.ndarray
    df: np.ndarray
    w: np.ndarray

    @property
    def term(self) -> np.ndarray:
        return self.grams.term[self.at]

    def heads(self, keys: list[str], schema: pa.Schema, of: np.ndarray) -> list[pa.Array]:
        """The keys of the given texts."""
        part = self.grams.heads.select(keys).take(pa.array(self.number[of])).combine_chunks()
        return [pa.concat_arrays(part.column(k).chunks).cast(schema.field(k).type) if len(of) else pa.array([], schema.field(k).type) for k in keys]


def _weighted(row: dict, ngram: tuple[int, int], df: np.ndarray) -> _Texts:
    """The texts of a stored block and their weights, given the df of its terms in the order of prefix and term."""
    grams = _grams(row, ngram)
    begins, pairs = grams.names()
    first, at = np.flatnonzero(begins), np.flatnonzero(pairs)
    known = np.empty(len(first), np.int64)
    known[_stable_order(grams.prefix[first])] = df
    df, tf = known[np.cumsum(begins)[at] - 1], np.diff(np.append(at, len(pairs)))
    order = _stable_order(df, grams.text[at])  # the terms of a text come in their own order
    at, df, tf = at[order], df[order], tf[order]
    text = grams.text[at].astype(np.int64)
    x = (1 + np.log(tf)) * (np.log((1 + grams.heads.column("_docs").to_numpy()[text]) / (1 + df)) + 1)
    starts = np.flatnonzero(_first_of(text))
    sizes = np.diff(np.append(starts, len(text)))
    length = np.sqrt(np.add.reduceat(x * x, starts)) if len(x) else x
    return _Texts(grams, text[starts], sizes, at, df, x / np.repeat(length, sizes))


@dataclass
class _Corpus:
    """Texts in stored blocks, and the df of their terms.

    Words are stored once. Terms travel as 64-bit hashes of group and words, once per block, to the bucket of another 16 bits,
    and the number of texts comes back in the order they were sent, so that a block works out its vectors anew whenever they
    are asked for; no term of a text is stored. The buckets are counted in _ROUNDS rounds, each of which frees its shuffle.
    """

    blocks: DataFrame
    counted: DataFrame
    group: str
    id_col: str
    ngram: tuple[int, int]
    keys_schema: object

    def each(self, make: Callable[[_Texts, int, list[int]], Iterator[list]], columns: str, wanted: DataFrame | None = None) -> DataFrame:
        """Rows of the given columns that ``make`` has of the texts of each block, its name and the numbers that are wanted of it."""
        ngram, names = self.ngram, [c.split("`")[1] if c.startswith("`") else c.split()[0] for c in columns.split(", ")]

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = sorted(pa.Table.from_batches(list(batches)).to_pylist(), key=lambda r: (r["kind"], r["at"]))
            asked = [r["at"] for r in parts if r["kind"] == 2]
            if wanted_only and not asked:
                return
            df = [_unpacked(r["df"]) for r in parts if r["kind"] == 1]
            texts = _weighted(parts[0], ngram, np.concatenate(df) if df else np.zeros(0, np.int64))
            for out in make(texts, parts[0]["block"], asked):
                yield pa.RecordBatch.from_arrays(out, names)

        wanted_only = wanted is not None
        rows = self.blocks.withColumns({"kind": F.lit(0), "at": F.lit(0).cast("long"), "df": F.lit(None).cast("binary")})
        rows = rows.drop("n").unionByName(self.counted.select("block", F.lit(1).alias("kind"), F.col("bucket").alias("at"), "df"), allowMissingColumns=True)
        if wanted_only:
            rows = rows.unionByName(wanted.select("block", F.lit(2).alias("kind"), "at"), allowMissingColumns=True)
        return rows.groupBy("block").applyInArrow(made, columns)

    @property
    def _heads(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.keys_schema.fields)

    def vectors(self, wanted: DataFrame | None = None) -> DataFrame:
        """(group, id, v) as ``vectors`` has them, of all texts or of those with a wanted (block, at)."""
        keys, schema = [self.group, self.id_col], to_arrow_schema(self.keys_schema)

        def make(texts: _Texts, block: int, asked: list[int]) -> Iterator[list]:
            of = np.flatnonzero(np.isin(texts.number, asked)) if some else np.arange(len(texts.number))
            take = np.repeat(np.isin(np.arange(len(texts.number)), of), texts.sizes)
            entries = [pa.array(x[take]) for x in (texts.df, texts.term, texts.w)]
            yield [*texts.heads(keys, schema, of), _lists(pa.StructArray.from_arrays(entries, ["df", "term", "w"]), texts.sizes[of])]

        some = wanted is not None
        return self.each(make, f"{self._heads}, v array<struct<df:bigint,term:bigint,w:double>>", wanted)

    def weights(self) -> DataFrame:
        """(group, id, term, df, w), the terms spelled out."""
        keys, schema = [self.group, self.id_col], to_arrow_schema(self.keys_schema)

        def make(texts: _Texts, block: int, asked: list[int]) -> Iterator[list]:
            grams, owner = texts.grams, np.repeat(np.arange(len(texts.number)), texts.sizes)
            length = grams.length[texts.at]
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                for lo in range(0, len(rows), _BLOCK):
                    here = rows[lo : lo + _BLOCK]
                    place = grams.place[texts.at[here]]
                    words = [grams.words.take(pa.array(grams.numbers[place + k])) for k in range(n)]
                    names = words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")
                    yield [*texts.heads(keys, schema, owner[here]), names, pa.array(texts.df[here]), pa.array(texts.w[here])]

        return self.each(make, f"{self._heads}, term string, df long, w double")

    def prints(self, threshold: float | None = None) -> DataFrame:
        """(group, id, block, at, _f, _g) of every text with terms: its place, and two hashes of its vector; with a threshold
        also (_terms, _ws, _rests), its entries of ``prefixes``."""
        keys, schema = [self.group, self.id_col], to_arrow_schema(self.keys_schema)

        def make(texts: _Texts, block: int, asked: list[int]) -> Iterator[list]:
            heads = texts.heads(keys, schema, np.arange(len(texts.number)))
            out = [*heads, pa.array(np.full(len(texts.number), block)), pa.array(texts.number), *_prints(texts.term, texts.w, texts.sizes)]
            if threshold is not None:
                owner, at, rest = _prefix_of(texts.df, texts.w, texts.sizes, threshold)
                sizes = np.bincount(owner, minlength=len(texts.number))
                out += [_lists(pa.array(x), sizes) for x in (texts.term[at], texts.w[at], rest)]
            yield out

        more = "" if threshold is None else ", _terms array<bigint>, _ws array<double>, _rests array<double>"
        return self.each(make, f"{self._heads}, block long, at long, _f long, _g long{more}")


def _corpus(df: DataFrame, group: str, id_col: str, text: str, ngram: tuple[int, int] = (1, 2)) -> _Corpus:
    keys = [group, id_col]
    # a row per group, or the join would deal the texts out by their groups
    docs = F.broadcast(df.groupBy(group).agg(F.count(F.lit(1)).alias("_docs")))
    # joined first, as an order below a join is not kept; texts of a group come together, so that a block sends a term of them once
    rows = df.filter(F.col(group).isNotNull()).select(*keys, text).join(docs, group).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.select(*keys, "_docs", F.xxhash64(group).alias("_g"), _words(text).alias("_words"))
    blocks = _stored(rows.mapInArrow(_text_blocks(keys), f"block long, n long, {_BLOCK_COLUMNS}"))
    buckets = min(1 << _PREFIX, 1 + (blocks.agg(F.sum("n")).first()[0] or 0) * (ngram[1] - ngram[0] + 1) // _BUCKET)
    counted = None
    for turn in range(min(_ROUNDS, buckets)):
        sent = blocks.mapInArrow(_sent_terms(ngram, buckets, turn), "bucket long, block long, counts binary, terms binary, n binary")
        back = _stored(sent.groupBy("bucket").applyInArrow(_term_texts, "block long, bucket long, df binary"))
        counted = back if counted is None else counted.union(back)
    return _Corpus(blocks, counted, group, id_col, ngram, df.select(*keys).schema)


def hashed_vectors(df: DataFrame, group: str, id_col: str, text: str, ngram: tuple[int, int] = (1, 2)) -> DataFrame:
    """(group, id, v): the same as ``vectors`` with all terms, where a term is a 64-bit hash of its group and words."""
    return _corpus(df, group, id_col, text, ngram).vectors()


def _prints(term: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    """Two 64-bit hashes of each vector, its weights rounded to twelve places."""
    one = _mixed(term.view(np.uint64) + _mixed(np.rint(w * 1e12).astype(np.uint64) + _MIX))
    # sums up to the end of each vector, which wrap around
    ends = np.cumsum(sizes)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (one, _mixed(one + _MIX))]
    return [pa.array((x[ends] - x[ends - sizes]).view(np.int64)) for x in sums]


def _first_copies(prints: DataFrame, group: str, id_col: str) -> DataFrame:
    """(group, id, rep) from the hashes of the vectors."""
    first = prints.groupBy(group, "_f", "_g").agg(F.min(id_col).alias("rep"))
    return prints.join(first, [group, "_f", "_g"]).select(group, id_col, "rep")


def same_vector(vecs: DataFrame, group: str, id_col: str) -> DataFrame:
    """(group, id, rep): the smallest id with the same weights to twelve places, told by two 64-bit hashes of all of them."""
    terms = F.col("v.term") if _term_type(vecs) == "bigint" else F.transform("v", lambda e: F.xxhash64(e["term"]))
    types = {f.name: f.dataType.simpleString() for f in vecs.schema.fields}

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (term, sizes), (w, _) = _flat(batch, "_t"), _flat(batch, "_w")
            prints = _prints(term.to_numpy(), w.to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column(id_col), *prints], [group, id_col, "_f", "_g"])

    schema = f"`{group}` {types[group]}, `{id_col}` {types[id_col]}, _f long, _g long"
    prints = checkpointed(vecs.select(group, id_col, terms.alias("_t"), F.col("v.w").alias("_w")).mapInArrow(printed, schema))
    return _first_copies(prints, group, id_col)


def _prefix_of(df: np.ndarray, w: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors, their entries from the rarest term on: text, place and rest of the entries that ``prefixes`` has."""
    spare, owner = 1 - (threshold - _EPS) ** 2, np.repeat(np.arange(len(sizes)), sizes)
    after = np.cumsum(w * w)
    starts = np.cumsum(sizes) - sizes
    after -= np.concatenate([[0.0], after])[starts][owner]
    # the squared length before a term grows along the array
    at = np.flatnonzero((after - w * w <= spare) & (df > 1))
    return owner[at], at, np.maximum(1 - after[at], 0.0)


def prefixes(vecs: DataFrame, group: str, id_col: str, threshold: float) -> DataFrame:
    """(group, id, term, w, rest): rarest terms of every text whose removal leaves a vector shorter than the threshold, with
    the squared length of what follows each.

    Two texts at or above the threshold share their rarest common term in both prefixes. A term of one text alone is no pair's.
    """
    types = {f.name: f.dataType.simpleString() for f in vecs.schema.fields}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, sizes = _flat(batch, "v")
            df, w = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("df", "w"))
            owner, at, rest = _prefix_of(df, w, sizes, threshold)
            heads = [batch.column(k).take(pa.array(owner)) for k in (group, id_col)]
            yield pa.RecordBatch.from_arrays([*heads, entries.field("term").take(pa.array(at)), pa.array(w[at]), pa.array(rest)], [group, id_col, "term", "w", "rest"])

    schema = f"`{group}` {types[group]}, `{id_col}` {types[id_col]}, term {_term_type(vecs)}, w double, rest double"
    return vecs.select(group, id_col, "v").mapInArrow(found, schema)


def _term_type(vecs: DataFrame) -> str:
    return vecs.schema["v"].dataType.elementType["term"].dataType.simpleString()


#: Terms of the vectors that one block of compared pairs holds.
_COMPARED = 1 << 20


def _products(keys: list[str], schema: pa.Schema):
    """From the pairs of a block and the vectors of their texts: (group, i, j, cosine) of the pairs that share a term."""

    def compared(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        if not pairs.num_rows or not texts.num_rows:
            return schema.empty_table()
        (term, sizes), (w, _) = _flat(texts, "_t"), _flat(texts, "_w")
        coded = term.dictionary_encode()
        term, w = coded.indices.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        at = {k: n for n, k in enumerate(zip(*(texts.column(k).to_pylist() for k in keys)))}
        owners = pairs.column(keys[0]).to_pylist()
        i, j = (np.array([at[k] for k in zip(owners, pairs.column(c).to_pylist())], np.int64) for c in "ij")
        cosine, own = np.zeros(len(i)), np.zeros(len(coded.dictionary))
        order = np.argsort(i, kind="stable")
        firsts = np.flatnonzero(_first_of(i[order]))
        for lo, hi in zip(firsts, [*firsts[1:], len(order)]):
            first = i[order[lo]]
            mine = slice(starts[first], starts[first] + sizes[first])
            own[term[mine]] = w[mine]
            for n in order[lo:hi]:
                other = slice(starts[j[n]], starts[j[n]] + sizes[j[n]])
                cosine[n] = own[term[other]] @ w[other]
            own[term[mine]] = 0
        # weights are positive
        return pairs.select([keys[0], "i", "j"]).append_column("cosine", pa.array(cosine)).filter(pa.array(cosine > 0)).cast(schema)

    return compared


def cosines(pairs: DataFrame, vectors_of: Callable[[DataFrame], DataFrame], group: str, id_col: str) -> DataFrame:
    """Exact cosine of the given (group, i, j) pairs, where they share a term, from the vectors of given (group, id).

    A text's hub is the smallest id among it and its partners, and a pair is compared in the block of the hub of its first text,
    where texts close to each other meet: a block gets the vector of a text once for all its pairs there. A hub whose texts
    have more than _COMPARED terms is cut into parts, which meet in pairs.
    """
    keys = [group, id_col]
    ends = pairs.select(group, F.col("i").alias(id_col), F.col("j").alias("_o")).union(pairs.select(group, F.col("j").alias(id_col), F.col("i").alias("_o")))
    # stored, so that their size is known and a few of them don't deal out all vectors again
    hubs = _stored(ends.groupBy(*keys).agg(F.least(F.col(id_col), F.min("_o")).alias("_hub")))
    own = vectors_of(hubs.select(*keys)).select(*keys, F.col("v.term").alias("_t"), F.col("v.w").alias("_w"))
    own = _stored(own.withColumn("_n", F.size("_t").cast("long")))
    dealt = _stored(pairs.join(hubs.withColumnRenamed(id_col, "i"), [group, "i"]).select(group, "i", "j", "_hub"))
    met = dealt.select(group, "_hub", F.col("i").alias(id_col)).union(dealt.select(group, "_hub", F.col("j").alias(id_col))).distinct()
    sizes = _stored(met.join(own.select(*keys, "_n"), keys).groupBy(group, "_hub").agg(F.sum("_n").alias("_n")))
    parts = sizes.select(group, "_hub", F.ceil(F.col("_n") / _COMPARED).alias("_parts"))
    buckets = 1 + (sizes.agg(F.sum(F.col("_n") * F.ceil(F.col("_n") / _COMPARED))).first()[0] or 0) // _COMPARED
    part = lambda c: F.pmod(F.xxhash64(c), F.col("_parts"))
    block = F.xxhash64(group, "_hub", F.least(part("i"), part("j")), F.greatest(part("i"), part("j")))
    blocks = _stored(dealt.join(parts, [group, "_hub"]).select(group, "i", "j", F.pmod(block, F.lit(buckets)).alias("_block")))
    sent = blocks.select("_block", group, F.col("i").alias(id_col)).union(blocks.select("_block", group, F.col("j").alias(id_col))).distinct()
    # named anew, or the columns of both sides of the cogroup were the same
    sent = sent.join(own, keys).select(*[F.col(c).alias(c) for c in ("_block", *keys, "_t", "_w")])
    out = pairs.select(group, "i", "j", F.lit(0.0).alias("cosine")).schema
    return blocks.groupBy("_block").cogroup(sent.groupBy("_block")).applyInArrow(_products(keys, to_arrow_schema(out)), out)


#: Texts of a term's list that one block holds; a longer list is cut, and its blocks meet in pairs.
LIST_BLOCK = 1000


def near_pairs(vecs: DataFrame, group: str, id_col: str, threshold: float = NEAR_DUP_COSINE, among: DataFrame | None = None) -> DataFrame:
    """(group, i, j, cosine) of all i < j of a group at or above the threshold, from ``vectors``.

    Candidates share a term in both prefixes; those whose shared part and the lengths of what follows it can't reach the
    threshold go, and the others are compared on all terms. Give one text of each set of equal vectors (``same_vector``):
    its copies have the same partners. With ``among`` (group, id) only those texts take part.
    """
    lists = prefixes(vecs, group, id_col, threshold)
    # the short prefixes are compared with the keys, not the vectors
    lists = _stored(lists if among is None else lists.join(among, [group, id_col], "left_semi"))
    return _close(lists, lambda texts: vecs.join(texts, [group, id_col], "left_semi"), group, id_col, threshold)


def _close(lists: DataFrame, vectors_of: Callable[[DataFrame], DataFrame], group: str, id_col: str, threshold: float) -> DataFrame:
    """The pairs of ``near_pairs`` from the prefixes and the vectors of given texts."""
    sizes = lists.groupBy(group, "term").agg(F.count(F.lit(1)).alias("_c"))
    sizes = sizes.filter("_c > 1").select(group, "term", F.ceil(F.col("_c") / LIST_BLOCK).cast("int").alias("_n"))
    dealt = lists.join(sizes, [group, "term"]).withColumn("_b", F.pmod(F.xxhash64(id_col), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select(group, "term", id_col, "w", "rest", "_b", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"))
    a, b = (dealt.select(group, "term", "_lo", "_hi", F.col(id_col).alias(n), *[F.col(c).alias(c + n) for c in ("w", "rest", "_b")]) for n in "ij")
    met = a.join(b, [group, "term", "_lo", "_hi"]).filter("i < j AND (_lo = _hi OR _bi <> _bj)")
    # beyond their last shared term of both prefixes two texts share only what follows it in either
    bound = F.sum(F.col("wi") * F.col("wj")) + F.sqrt(F.min("resti") * F.min("restj"))
    candidates = _stored(met.groupBy(group, "i", "j").agg(bound.alias("_most")).filter(F.col("_most") >= threshold - _EPS).select(group, "i", "j"))
    return cosines(candidates, vectors_of, group, id_col).filter(F.col("cosine") >= threshold)


def eliminated(pairs: DataFrame, group: str) -> DataFrame:
    """(group, id, leader, cosine) of what greedy elimination in id order drops, from the close pairs (group, i, j, cosine).

    A text goes when a kept one with a smaller id is close. Each round keeps the texts with no undecided close text before
    them and drops their partners; only the close pairs take part, and the rounds are as many as the longest chain of them.
    """
    open_, dropped = pairs.select(group, "i", "j"), None
    while not open_.isEmpty():
        later = open_.select(group, F.col("j").alias("i")).distinct()
        kept = open_.select(group, "i").distinct().join(later, [group, "i"], "left_anti")
        gone = _stored(open_.join(kept, [group, "i"], "left_semi").select(group, "j").distinct())
        rest = open_.join(gone, [group, "j"], "left_anti").join(gone.withColumnRenamed("j", "i"), [group, "i"], "left_anti")
        open_ = _stored(rest.join(kept, [group, "i"], "left_anti"))
        dropped = gone if dropped is None else dropped.union(gone)
    if dropped is None:
        return pairs.select(group, F.col("j").alias("id"), F.col("i").alias("leader"), "cosine")
    led = pairs.join(dropped, [group, "j"]).join(dropped.withColumnRenamed("j", "i"), [group, "i"], "left_anti")
    return led.groupBy(group, F.col("j").alias("id")).agg(F.min("i").alias("leader"), F.min_by("cosine", "i").alias("cosine"))


def _distinct_pairs(df: DataFrame, group: str, id_col: str, text: str, threshold: float, max_terms: int | None) -> tuple[DataFrame, DataFrame]:
    """(group, id, rep) of every text with terms, and the close pairs of the representatives."""
    keys = [group, id_col]
    own = lambda copies: copies.filter(F.col(id_col) == F.col("rep")).select(*keys)
    if max_terms is not None:
        vecs = _stored(vectors(df, group, id_col, text, max_terms=max_terms))
        copies = _stored(same_vector(vecs, group, id_col))
        return copies, near_pairs(vecs, group, id_col, threshold, own(copies))
    corpus = _corpus(df, group, id_col, text)
    prints = _stored(corpus.prints(threshold))
    copies = _stored(_first_copies(prints, group, id_col))
    entries = F.explode(F.arrays_zip(F.col("_terms").alias("term"), F.col("_ws").alias("w"), F.col("_rests").alias("rest")))
    lists = _stored(prints.join(own(copies), keys, "left_semi").select(*keys, entries.alias("_e")).select(*keys, "_e.*"))
    # vectors are worked out anew for those that are compared
    vectors_of = lambda texts: corpus.vectors(_stored(prints.select(*keys, "block", "at").join(texts, keys, "left_semi").select("block", "at")))
    return copies, _close(lists, vectors_of, group, id_col, threshold)


def vector_classes(df: DataFrame, group: str, id_col: str, text: str, max_terms: int | None = None) -> DataFrame:
    """(group, id, rep, n): the class of equal vectors of every text with terms, named by its smallest id, and its size."""
    if max_terms is None:
        copies = _stored(_first_copies(_stored(_corpus(df, group, id_col, text).prints()), group, id_col))
    else:
        copies = _stored(same_vector(_stored(vectors(df, group, id_col, text, max_terms=max_terms)), group, id_col))
    return copies.join(copies.groupBy(group, "rep").agg(F.count(F.lit(1)).alias("n")), [group, "rep"]).select(group, id_col, "rep", "n")


def near_duplicate_pairs(
    df: DataFrame, group: str, id_col: str, text: str, threshold: float = NEAR_DUP_COSINE, max_terms: int | None = None
) -> DataFrame:
    """(group, i, j, cosine) of the close pairs, where i and j stand for all texts with their vectors: ``vector_classes`` has
    the members, whose pairs within a class have cosine 1."""
    return _distinct_pairs(df, group, id_col, text, threshold, max_terms)[1]


def near_duplicates(
    df: DataFrame, group: str, id_col: str, text: str, threshold: float = NEAR_DUP_COSINE, max_terms: int | None = None
) -> DataFrame:
    """(group, id, leader, cosine) of every text dropped by greedy elimination in id order.

    A text is dropped when a kept text with a smaller id reaches the threshold; ``leader`` is the smallest of these. A copy
    follows its representative: dropped with the same leader, or led by the kept representative itself.
    """
    copies, pairs = _distinct_pairs(df, group, id_col, text, threshold, max_terms)
    pairs = _stored(pairs)
    dropped = eliminated(pairs, group)
    led = dropped.select(group, F.col("id").alias("rep"), "leader", "cosine")
    twins = copies.filter(F.col(id_col) != F.col("rep")).join(led, [group, "rep"], "left")
    twins = twins.select(group, id_col, F.coalesce("leader", "rep").alias("leader"), F.coalesce("cosine", F.lit(1.0)).alias("cosine"))
    return dropped.select(group, F.col("id").alias(id_col), "leader", "cosine").unionByName(twins)


def leader_dedup(df: DataFrame, group: str, id_col: str, text: str, threshold: float = NEAR_DUP_COSINE) -> DataFrame:
    """Rows that survive the elimination; texts without any term are always kept."""
    gone = near_duplicates(df, group, id_col, text, threshold).select(group, id_col)
    return df.join(gone, [group, id_col], "left_anti")

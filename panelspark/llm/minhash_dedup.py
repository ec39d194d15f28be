"""Near-duplicate documents by one-permutation MinHash with optimal densification, star candidates and exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import checkpointed
from . import arrays as A
from .blocks import in_small_batches

SHINGLE = 5
THRESHOLD_PERCENT = 80
BINS = 256
ROWS = 6
BANDS = BINS // ROWS
#: Members that one task compares with a centre at a time.
STAR_MEMBERS = 2_000


@cache
def _priorities() -> np.ndarray:
    """For every bin the order in which an empty one turns to the others: independent and uniform, as optimal densification asks."""
    n = np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS)
    return A.mix(n * A.MULTIPLIER + np.uint64(1))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as ascending 64-bit hashes; a text with fewer words is one shingle, none without words."""
    raw, borders = A.utf8(texts)
    raw = A.lower(raw)
    out: list[np.ndarray] = []
    for low, high in A.slices(borders, 1 << 20):
        part = raw[borders[low] : borders[high]]
        start, end, rows = A.word_spans(part, borders[low : high + 1] - borders[low], A.NOT_SPACE)
        words = A.span_hashes(A.byte_codes()[part], start, end)
        grams = A.mix(A.grams(words, size))
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(grams[a : b - size + 1]))
            elif b > a:
                code = words[a:b]
                out.append(A.mix(A.grams(code, b - a) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """One bin per leading byte of the hash with its least value; an empty bin takes over that of its first non-empty choice."""
    bins = (shingles >> np.uint64(56)).astype(np.int64)
    head = np.flatnonzero(np.diff(bins, prepend=-1))
    full = bins[head]
    out = np.zeros(BINS, np.uint64)
    out[full] = shingles[head]
    empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
    if len(empty):
        choice = full[np.argmin(_priorities()[np.ix_(empty, full)], axis=1)]
        out[empty] = A.mix(out[choice] + empty.astype(np.uint64))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    grid = A.mix(sig[: BANDS * ROWS].reshape(BANDS, ROWS))
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = A.mix(key * A.MULTIPLIER + grid[:, j])
    return key.view(np.int64)


def _features(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, key, bands): ``key`` is a 256-bit digest of the whole set."""
    import hashlib

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text"), size)
            keys = [hashlib.sha256(s.tobytes()).digest() if len(s) else None for s in sets]
            bands = [band_keys(signature(s)) for s in sets if len(s)]
            offsets = np.concatenate([[0], np.cumsum([BANDS if len(s) else 0 for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(A.joined(bands, np.int64)))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_shingles": n, "key": pa.array(keys, pa.binary()), "bands": lists})

    return in_small_batches(docs).mapInArrow(describe, "doc_id long, n_shingles long, key binary, bands array<long>")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(centre, member, n, both, linked, extra, missing): the whole sets of each pair.

    ``n`` is the member's size and ``both`` the intersection's; ``extra`` and ``missing`` are masks of what the member has
    beyond the centre and of what it has not.

    A centre's set meets its members in parts of about STAR_MEMBERS, so a centre of a large group fills no task.
    """
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_MEMBERS).cast("long").alias("parts"))
    dealt = pairs.join(sizes, "centre").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts"))).select("centre", "member", "part")
    members = dealt.join(sets.withColumnRenamed("rep", "member"), "member")
    centres = sizes.join(sets.withColumnRenamed("rep", "centre"), "centre").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    )

    masks = pa.list_(pa.int64())
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), masks, masks)
    schema = pa.schema(list(zip(("centre", "member", "n", "both", "linked", "extra", "missing"), kinds)))

    def compare(centre: pa.Table, member: pa.Table) -> pa.Table:
        out = []
        head = centre.column("centre")[0].as_py() if centre.num_rows else None
        for c in A.parts(centre, "shingles", np.uint64):
            for name, m in zip(A.column(member, "member").to_pylist(), A.parts(member, "own", np.uint64)):
                at = np.minimum(np.searchsorted(c, m), len(c) - 1)
                found = c[at] == m
                both = int(np.count_nonzero(found))
                has = np.zeros(len(c), np.bool_)
                has[at[found]] = True
                linked = 100 * both >= percent * (len(c) + len(m) - both)
                out.append((head, name, len(m), both, linked, _mask(m[~found]), _mask(c[~has])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else ([],) * 7, schema.types)], schema=schema)

    around = members.select(F.col("centre").alias("of"), F.col("part").alias("slice"), "member", F.col("shingles").alias("own"))
    return (
        centres.select("centre", "part", "shingles")
        .groupBy("centre", "part")
        .cogroup(around.groupBy("of", "slice"))
        .applyInArrow(compare, "centre long, member long, n long, both long, linked boolean, extra array<long>, missing array<long>")
    )


def _mask(tokens: np.ndarray) -> np.ndarray:
    """256 bits, one set for each token."""
    out = np.zeros(4, np.int64)
    bit = tokens >> np.uint64(3) & np.uint64(255)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (bit & np.uint64(63))).view(np.int64))
    return out


def _only_in(a: str, b: str) -> Column:
    """Bits that are in mask ``a`` alone: at least so many tokens are in the first set alone."""
    bits = (F.bit_count(F.col(a)[i].bitwiseAND(F.bitwise_not(F.col(b)[i]))) for i in range(4))
    return reduce(lambda x, y: x + y, bits).cast("long")


def _at_most(x: str, y: str) -> Column:
    """A bound on what two members of a star have in common, from what each has of the hub, beyond it and not of it.

    Of the hub's set both have at most what one has and the other's missing ones leave; beyond it at most what one has and
    the other may have.
    """
    name = lambda who, part: f"{who}.{part}"
    within = F.least(*(F.col(name(p, "both")) - _only_in(name(q, "missing"), name(p, "missing")) for p, q in ((x, y), (y, x))))
    beyond = F.least(*(F.col(name(p, "n")) - F.col(name(p, "both")) - _only_in(name(p, "extra"), name(q, "extra")) for p, q in ((x, y), (y, x))))
    return within + beyond


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of (a, b): the smallest node that can be reached, by alternating large and small stars.

    Both steps keep components as they are and shorten paths by half; a hub has as many edges as nodes, summed by joins.
    """
    edges = checkpointed(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        after = checkpointed(small)
        if _stamp(after) == _stamp(edges):
            break
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _links(compared: DataFrame) -> DataFrame:
    return compared.filter("linked").select(F.col("centre").alias("a"), F.col("member").alias("b"))


def _stamp(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = THRESHOLD_PERCENT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked by Jaccard similarity of their word shingles.

    Two documents are linked when 100 * intersection >= percent * union, which is checked on their whole sets; a component
    is named by its smallest id, whose document is kept. Texts with equal sets are one class from the start. Candidates are
    classes that share one of 42 bands of six bins: at a similarity of 0.85 all of them fail with a chance of 2e-9.

    In a bucket candidates form a star: each is compared with the smallest. Members that are then outside the component of
    their hub are compared with all others of its star, unless a bound rules a link out. The bound is nearly exact: what a
    member lacks of the hub and has beyond it are kept as bit masks, which tell what another member can't share. So no
    candidate between different components goes unchecked, and a group of n copies costs about n checks.

    Lower-cased A-Z; words are runs of other characters than space. Null and blank texts have no shingles and are linked with
    nothing. Rows that share an id are linked with each other. Rows without an id get no component and are kept. An empty
    table gives an empty table; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = checkpointed(_features(rows, shingle))
    usable = features.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = checkpointed(usable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    entries = classes.select(F.explode("bands").alias("bucket"), "rep", "n")
    crowded = entries.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("bucket")
    members = checkpointed(entries.join(crowded, "bucket"))
    wanted = members.select("rep").distinct()
    sets = checkpointed(_sets(rows.join(wanted, rows.doc_id == wanted.rep, "left_semi"), shingle))
    # rows of one id are one node
    shared = features.filter("doc_id IS NOT NULL AND key IS NOT NULL").join(classes.select("key", "rep"), "key").filter("doc_id <> rep").select("doc_id", "rep")
    twice = usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
    edges = checkpointed(shared.join(twice, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    labels = components(edges)
    # the star: every member with the smallest of its bucket
    hub = members.groupBy("bucket").agg(F.min("rep").alias("hub"))
    star = members.join(hub, "bucket").filter("rep <> hub").select(F.col("hub").alias("centre"), F.col("rep").alias("member")).distinct()
    first = checkpointed(_compared(star, sets, percent))
    edges = checkpointed(edges.union(_links(first)))
    labels = components(edges)
    # members that the star left outside the hub's component meet the others of the star, where the bound lets them
    def comp(df: DataFrame, key: str, name: str) -> DataFrame:
        known = labels.select(F.col("node").alias(key), F.col("comp").alias(name))
        return df.join(known, key, "left").withColumn(name, F.coalesce(name, key))

    placed = checkpointed(comp(comp(first, "member", "comp"), "centre", "hub_comp"))
    outside = placed.filter("comp <> hub_comp")
    some = placed.join(outside.select("centre").distinct(), "centre", "left_semi")
    x, y = outside.alias("x"), some.alias("y")
    new = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.hub_comp")) | (F.col("x.member") < F.col("y.member")))
    possible = (100 + percent) * _at_most("x", "y") >= percent * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.centre") == F.col("y.centre")) & new & possible)
    pairs = checkpointed(pairs.select(F.col("x.member").alias("centre"), F.col("y.member").alias("member")).distinct())
    if not pairs.isEmpty():
        edges = checkpointed(edges.union(_links(checkpointed(_compared(pairs, sets, percent)))))
        labels = components(edges)
    named = classes.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("key", F.coalesce("comp", "rep").alias("comp"))
    out = features.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(rep, shingles): the whole set of each row, packed."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [s.tobytes() for s in shingle_sets(b.column("text"), size)]
            yield pa.RecordBatch.from_pydict({"rep": b.column("doc_id"), "shingles": pa.array(packed, pa.binary())})

    return rows.select("doc_id", "text").mapInArrow(build, "rep long, shingles binary").filter(F.octet_length("shingles") > 0)

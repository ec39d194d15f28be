"""Phrase collocations: n-grams counted in weighted automata per shard, united by prefix, and composed with their parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..scale import checkpointed, rank_in_group
from . import arrays as A
from .blocks import in_small_batches, size_class, text_bytes
from .count_automata import Automaton, encode, word_array

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
UNKNOWN = "und"
#: Strings of an automaton are dealt by their first words, at most so many; counts of longer ones add up along its paths.
PREFIX_WORDS = 3
#: Bytes of text of a block, of which a task holds about forty times as much in codes and sums.
BLOCK_BYTES = 4 << 20
#: Bytes of text whose distinct words and pairs one task compares.
_COMPARED_BYTES = 32 << 20
_BREAK = A.byte_class((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
_WORD = ~(_BREAK | A.byte_class((0x20, 0x20), (0x09, 0x09)))

SHARD = "range long, lang string, n long, words binary, shape binary, states binary"


def _by_language(table: pa.Table) -> list[tuple[str, pa.Array]]:
    langs = A.column(table, "lang").to_pylist()
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    text = A.column(table, "text")
    return [(lang, text.take(pa.array(at, pa.int64()))) for lang, at in sorted(rows.items())]


class Shard:
    """The texts of one language in one block: words, which of them follow each other in a piece, and their codes."""

    def __init__(self, lang: str, texts: pa.Array):
        raw, borders = A.utf8(texts)
        self.raw = A.lower(raw)
        self.start, self.end, _ = A.word_spans(self.raw, borders, _WORD)
        broken = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_BREAK[self.raw], out=broken[1:])
        inner = np.zeros(len(raw) + 1, np.int32)
        inner[borders[1:-1]] = 1  # the end of a row breaks too; two words of one row have no border between them
        inner = np.cumsum(inner, dtype=np.int32)
        gap = self.start[1:], self.end[:-1]
        self.follows = (broken[gap[0]] == broken[gap[1]]) & (inner[gap[0]] == inner[np.maximum(gap[1] - 1, 0)])
        salt = A.span_hashes(A.byte_codes()[np.frombuffer(lang.encode() or b"\0", np.uint8)], np.array([0]), np.array([max(1, len(lang.encode()))]))
        self.codes = A.mix(A.span_hashes(A.byte_codes()[self.raw], self.start, self.end) ^ salt[0])
        self.pairs = A.mix(self.codes[:-1] * A.MULTIPLIER + self.codes[1:])

    def window(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words may be frequent, and how many words from each place on form frequent pairs (1 to LONGEST)."""
        pair = np.zeros(len(self.codes), np.bool_)
        pair[:-1] = self.follows & _isin(self.pairs, frequent)
        reach, alive = np.ones(len(self.codes), np.int8), np.ones(len(self.codes), np.bool_)
        for k in range(LONGEST - 1):
            ahead = np.zeros(len(alive), np.bool_)
            ahead[: max(0, len(alive) - k)] = pair[k:]
            alive &= ahead
            reach += alive
        return _isin(self.codes, frequent), reach


def _isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), np.bool_)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _prefix_code(strings: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A hash of the first PREFIX_WORDS words of every string."""
    out = np.zeros(len(strings), np.uint64)
    for d in range(PREFIX_WORDS):
        out = A.mix(out * A.MULTIPLIER + np.where(strings[:, d] >= 0, code[strings[:, d]], np.uint64(0)))
    return out


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, k, phrase, f) of every phrase of k <= LONGEST words with f >= min_count, and per language rows with k = 0 whose
    f adds up to the number of its words.

    Two rounds over blocks of documents: hashes of words and pairs, added up over all blocks, tell each block which may be
    frequent (a collision only lets one more through); then every block builds the automaton of the strings that consist
    of those, and the automata of a prefix range are united and their weights summed.
    """
    total = text_bytes(docs, text_col)
    blocks, buckets = size_class(total, BLOCK_BYTES), size_class(total, _COMPARED_BYTES)
    lang = F.coalesce(F.col(lang_col), F.lit(UNKNOWN))
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks))
    dealt = in_small_batches(docs.select(block.alias("block"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))

    def told(table: pa.Table) -> pa.Table:
        codes = [np.zeros(0, np.uint64)]
        for name, texts in _by_language(table):
            s = Shard(name, texts)
            codes += [s.codes, s.pairs[s.follows]]
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        n = np.minimum(n, min(min_count, 0xFFFF)).astype(np.uint16)
        to = (code % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edge = np.searchsorted(to[order], np.arange(buckets + 1))
        own = A.column(table, "block")[0]
        rows = [(b, code[order[x:y]].tobytes(), n[order[x:y]].tobytes()) for b, (x, y) in enumerate(zip(edge[:-1], edge[1:])) if y > x]
        kinds = pa.int64(), pa.binary(), pa.binary()
        b, c, m = (pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))
        return pa.table({"bucket": b, "block": pa.array([own.as_py()] * len(rows), pa.int64()), "codes": c, "counts": m})

    def resolve(table: pa.Table) -> pa.Table:
        each = A.parts(table, "codes", np.uint64)
        code, at = np.unique(np.concatenate(each), return_inverse=True)
        n = np.bincount(at, np.concatenate(A.parts(table, "counts", np.uint16)))
        frequent = code[n >= min(min_count, 0xFFFF)]
        mine = [c[_isin(c, frequent)].tobytes() for c in each]
        return pa.table({"block": A.column(table, "block"), "codes": pa.array(mine, pa.binary())})

    def build(table: pa.Table, answers: pa.Table) -> pa.Table:
        frequent = np.sort(np.concatenate([np.zeros(0, np.uint64), *A.parts(answers, "codes", np.uint64)]))
        out = []
        for name, texts in _by_language(table):
            s = Shard(name, texts)
            out.append((A.column(table, "block")[0].as_py() % buckets, name, len(s.codes), b"", b"", b""))
            known, reach = s.window(frequent)
            used = known.copy()
            for k in range(1, LONGEST):
                used[k:] |= reach[: max(0, len(used) - k)] > k
            at = np.flatnonzero(used)
            alphabet, label = encode(word_array(s.raw, s.start[at], s.end[at]))
            code = np.zeros(len(alphabet) + 1, np.uint64)
            code[label] = s.codes[at]
            of = np.full(len(s.codes) + LONGEST, -1, np.int32)
            of[at] = label
            strings = []
            for longest, where in ((1, known), (2, reach >= 2), (LONGEST, reach >= 3)):
                place = np.flatnonzero(where)
                rows = np.full((len(place), LONGEST), -1, np.int32)
                for k in range(longest):
                    rows[:, k] = np.where(reach[place] > k, of[place + k], -1)
                strings.append(rows)
            strings = np.vstack(strings)
            to = (_prefix_code(strings, code) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[order], np.arange(buckets + 1))
            for b, (x, y) in enumerate(zip(edge[:-1], edge[1:])):
                if y > x:
                    rows = strings[order[x:y]]
                    seen, own = np.unique(rows, return_inverse=True)
                    own = own.reshape(rows.shape).astype(np.int32) - (seen[0] < 0)
                    automaton = Automaton.build([alphabet[i] for i in seen if i >= 0], own, np.ones(len(rows), np.int64))
                    out.append((b, name, 0, *automaton.pack()))
        names = ("range", "lang", "n", "words", "shape", "states")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(names, kinds))})

    def unite(table: pa.Table) -> pa.Table:
        parts: dict[str, list[Automaton]] = {}
        n: dict[str, int] = {}
        for row in table.to_pylist():
            n[row["lang"]] = n.get(row["lang"], 0) + row["n"]
            if row["shape"]:
                parts.setdefault(row["lang"], []).append(Automaton.unpack(row["words"], row["shape"], row["states"]))
        out = [(name, 0, "", f) for name, f in sorted(n.items())]
        for name, some in sorted(parts.items()):
            one = Automaton.union(some)
            strings, _ = one.strings()
            f = np.concatenate(one.totals(PREFIX_WORDS - 1))
            for i in np.flatnonzero(f >= min_count):
                words = [one.alphabet[x] for x in strings[i] if x >= 0]
                out.append((name, len(words), b" ".join(words).decode(), int(f[i])))
        names, kinds = ("lang", "k", "phrase", "f"), (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(names, kinds))})

    whole = dealt.groupBy("block")
    frequent = whole.applyInArrow(told, "bucket long, block long, codes binary, counts binary").groupBy("bucket").applyInArrow(resolve, "block long, codes binary")
    shards = whole.cogroup(frequent.groupBy("block")).applyInArrow(build, SHARD)
    return shards.groupBy("range").applyInArrow(unite, "lang string, k int, phrase string, f long")


def _looked_up(counts: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, part, f) of the asked parts: the automaton of a range's counts composed with that of the parts asked there."""

    def rows_of(phrases: list[str]) -> tuple[list[bytes], np.ndarray]:
        split = [p.encode().split(b" ") for p in phrases]
        alphabet, label = encode(pa.array([w for ws in split for w in ws], pa.large_binary()))
        owner, place = A.spread(np.array([len(ws) for ws in split], np.int64))
        rows = np.full((len(split), LONGEST), -1, np.int32)
        rows[owner, place] = label
        return alphabet, rows

    def composed(known: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"lang": [], "part": [], "f": []}
        for lang in sorted(set(A.column(asked, "lang").to_pylist())):
            have = known.filter(pc.equal(known["lang"], lang))
            want = asked.filter(pc.equal(asked["lang"], lang))
            if not have.num_rows:
                continue
            counts_of = Automaton.build(*rows_of(A.column(have, "phrase").to_pylist()), A.column(have, "f").to_numpy())
            wanted = Automaton.build(*rows_of(A.column(want, "part").to_pylist()), np.ones(want.num_rows, np.int64))
            strings, ends = wanted.strings()
            met = counts_of.compose(wanted)
            f = np.concatenate([np.where(m >= 0, np.append(w, 0)[m], 0) for m, w in zip(met, counts_of.weight)])
            for i in np.flatnonzero(ends > 0):
                out["lang"].append(lang)
                out["part"].append(b" ".join(wanted.alphabet[x] for x in strings[i] if x >= 0).decode())
                out["f"].append(int(f[i]))
        return pa.table({"lang": pa.array(out["lang"], pa.string()), "part": pa.array(out["part"], pa.string()), "f": pa.array(out["f"], pa.int64())})

    ranges = size_class(counts.count(), 1 << 18)
    to = lambda c: F.pmod(F.xxhash64("lang", F.array_join(F.slice(F.split(c, " ", -1), 1, PREFIX_WORDS), " ")), F.lit(ranges)).alias("range")
    left = counts.select(to("phrase"), "lang", "phrase", "f").groupBy("range")
    right = parts.select(to("part"), "lang", "part").groupBy("range")
    return left.cogroup(right).applyInArrow(composed, "lang string, part string, f long")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", min_count: int = MIN_COUNT, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: per language the ``top`` phrases of 2 to LONGEST words by score.

    A phrase is within a piece of text (up to a sign or line end), a its occurrences, n all words of the language; the cut
    with the lowest floor(1000 a n / (l r)) counts, at a tie the first. A phrase goes if a longer one, frequent too,
    contains it and occurs as often. Ties in score go to the larger a, then to the phrase that comes first in byte order.

    Null and empty texts have no words; a null language is UNKNOWN and counts with rows that have that name; repeated rows
    and rows without an id count each. Columns besides id, language and text are not read.
    """
    all_counts = checkpointed(phrase_counts(docs, lang_col, text_col, id_col, min_count))
    n = all_counts.filter("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    counts = all_counts.filter("k > 0").select("lang", "k", "phrase", "f")
    words = F.split("phrase", " ", -1)
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"), cut)
    cuts = cuts.select(
        "lang", "phrase", "k", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"),
    )
    parts = cuts.select("lang", F.explode(F.array("head", "tail")).alias("part")).distinct()
    known = checkpointed(_looked_up(counts, parts))
    cuts = cuts.join(known.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(n, "lang")
    score = F.expr(
        "(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    )
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b")
    scored = cuts.groupBy("lang", "phrase", "k", "a", "n").agg(best)
    # a phrase that occurs as often within one two words longer does so within one that is one word longer
    inner = F.explode(F.array(F.struct(F.array_join(F.slice("w", F.lit(1), F.col("k") - 1), " ").alias("phrase")), F.struct(F.array_join(F.slice("w", F.lit(2), F.col("k") - 1), " ").alias("phrase")))).alias("i")
    longer = counts.filter("k > 2").select("lang", "f", "k", words.alias("w")).select("lang", "f", inner)
    longer = longer.groupBy("lang", F.col("i.phrase").alias("phrase")).agg(F.max("f").alias("_longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter("_longer IS NULL OR _longer < a")
    rows = kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    ranked = rank_in_group(rows, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "rank").filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

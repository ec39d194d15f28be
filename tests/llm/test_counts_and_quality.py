"""Spelling variants, collocations and quality scores against brute force, on odd and empty rows, and their parts."""

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
from rows import ODD_ROWS, SMALL, empty, odd  # noqa: F401

from panelspark.llm import collocations as C
from panelspark.llm import quality as K
from panelspark.llm import queries as Q
from panelspark.llm import spelling_variants as V
from panelspark.llm.count_automata import Automaton, encode


def variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert variants(Q.op11_spelling_variants(spark, SMALL)) == brute.variants(docs)


def test_variants_of_odd_and_no_rows(spark, odd, empty):
    assert variants(V.spelling_variants(odd)) == brute.variants([(r[0], r[1]) for r in ODD_ROWS])
    assert V.spelling_variants(empty).count() == 0


def test_variants_in_cut_tiles(spark, monkeypatch):
    """Few letters, so that words have many near ones, runs of one letter included; keys are cut into blocks of two words."""
    monkeypatch.setattr(V, "TILE_WORDS", 2)
    monkeypatch.setattr(V, "CELLS", 16)
    draw = random.Random(3)
    words = ["".join(draw.choices("aaabé", k=draw.randint(4, 7))) for _ in range(150)] + ["a" * k for k in range(4, 12)]
    rows = [(i, " ".join(draw.choices(words, k=200))) for i in range(20)]
    got = variants(V.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.variants(rows) and max(v[3] for v in got.values()) > 8


def test_variants_of_chains_and_ties(spark):
    rows = [(1, "abcdefg " * 40 + "abcdef " * 20 + "abcde " * 10 + "xbcde " * 20 + "ÀBCDE " * 5)]
    got = variants(V.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.variants(rows)
    assert got["abcde"][:2] == ("abcdef", "abcdefg")  # 20 times each: the first in order


def test_collocations_equal_brute_force(spark):
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, Q.op12_phrase_collocations(spark, SMALL).collect())) == brute.phrases(docs)


def test_collocations_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(C, "_COMPARED_BYTES", 5_000)
    draw = random.Random(5)
    words = ["ant", "bee", "cat's", "dög", "e", "f-g", "123"]
    rows = [(i, "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ", ", "\n"]) for _ in range(90)), draw.choice(["en", "und", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = C.collocations(df, min_count=9, top=50)
    assert sorted(map(tuple, got.collect())) == brute.phrases([(r[2], r[1]) for r in rows], 9, 50)


def test_collocations_of_odd_and_no_rows(spark, odd, empty):
    got = C.collocations(odd, min_count=4)
    assert sorted(map(tuple, got.collect())) == brute.phrases([(r[2], r[1]) for r in ODD_ROWS], 4)
    assert C.collocations(empty).count() == 0


def test_automata():
    draw = random.Random(1)
    bags = [Counter(tuple(draw.choices("abc", k=draw.randint(1, 4))) for _ in range(n)) for n in (1, 30, 200)]

    def build(bag):
        alphabet, label = encode(pa.array([w.encode() for s in bag for w in s], pa.large_binary()))
        rows, at = np.full((len(bag), 4), -1, np.int32), 0
        for i, s in enumerate(bag):
            rows[i, : len(s)], at = label[at : at + len(s)], at + len(s)
        return Automaton.build(alphabet, rows, np.array(list(bag.values()), np.int64))

    def read(a):
        strings, weight = a.strings()
        return {tuple(a.alphabet[x].decode() for x in s if x >= 0): w for s, w in zip(strings, weight) if w}

    parts = [Automaton.unpack(*build(b).pack()) for b in bags]
    assert [read(p) for p in parts] == [dict(b) for b in bags]
    whole = Automaton.union(parts)
    assert read(whole) == dict(sum(bags, Counter()))
    asked = build(Counter([("a",), ("a", "b"), ("c", "z"), ("z",), ("b", "b", "b", "b")]))
    met = [whole.weight[d][s] if s >= 0 else 0 for d, states in enumerate(whole.compose(asked)) for s in states]
    strings, _ = asked.strings()
    for s, f in zip(strings, met):
        assert f == sum(bags, Counter())[tuple(asked.alphabet[x].decode() for x in s if x >= 0)]


def test_quality_of_held_out_rows(spark):
    sf = SMALL.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in Q.op13_quality_classifier(spark, sf).collect()]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_ignores_held_out_labels(spark, odd, empty):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    other = labels.withColumn("quality", F.when(K.learnable(), F.col("quality")).otherwise(1 - F.col("quality")))
    first, second = (sorted(map(tuple, K.quality_scores(docs, y).collect())) for y in (labels, other))
    assert first == second and {r[1] for r in first} == {True, False}
    scored = K.quality_scores(odd, labels).collect()
    assert len(scored) == len(ODD_ROWS) and not any(r["held_out"] for r in scored if r["doc_id"] is None)
    assert {r["score"] for r in K.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert K.quality_scores(empty, labels).count() == 0


def test_pooled_vectors_do_not_depend_on_cuts(monkeypatch):
    raw = ("One two, three THREE!! 44 times\n" * 50 + "x").encode()
    vectors = K.index_vectors().astype(np.float32)
    borders = np.array([0, 700, 700, len(raw)])
    whole = K._pooled(np.frombuffer(raw, np.uint8), borders, vectors)
    total = np.zeros((K.ROWS, K.DIMENSIONS), np.int64)
    K._context_sums(*K.tokens(np.frombuffer(raw, np.uint8), borders), K.index_vectors(), total)
    monkeypatch.setattr(K, "_TOKENS", 3)
    assert np.allclose(whole, K._pooled(np.frombuffer(raw, np.uint8), borders, vectors), atol=1e-5) and not whole[1].any()
    again = np.zeros_like(total)
    K._context_sums(*K.tokens(np.frombuffer(raw, np.uint8), borders), K.index_vectors(), again)
    assert (total == again).all() and total.any()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(np.int64)
    held = np.arange(400) % 5 == 0
    net = K.fit_network(x, y, held)
    assert net.temperature > 1 and K._loss(net.logits(x[held]) / net.temperature, y[held]) < K._loss(net.logits(x[held]), y[held])
    assert set(K.fit_network(x, np.ones(400, np.int64), held).scores(x).round(6)) == {round(401 / 402, 6)}

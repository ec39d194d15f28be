"""The operators against their plain versions, on a supplied table and on rows made to be awkward."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from rows import SMALL, empty, odd  # noqa: F401

from panelspark.llm import decontaminate as D
from panelspark.llm import html_text as H
from panelspark.llm import language_id as L
from panelspark.llm import minhash_dedup as M
from panelspark.llm import packing as P
from panelspark.llm import personal_data as N
from panelspark.llm import queries as Q
from panelspark.llm import suffix_dedup as X
from panelspark.llm import token_counts as C
from panelspark.llm import topk_search as K
from panelspark.llm.substring_dedup import substring_dedup


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_substring_dedup(spark, docs):
    got = by_id(Q.op1_substring_dedup(spark, SMALL), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(docs)


def test_suffix_dedup(spark, docs):
    got = by_id(Q.op3_suffix_array_dedup(spark, SMALL), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix(docs)


def test_near_duplicates(spark, docs):
    got = by_id(Q.op5_minhash_dedup(spark, SMALL), "n_shingles", "component_id", "kept")
    assert got == brute.near(docs)


def test_decontaminate(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = by_id(Q.op8_decontaminate(spark, SMALL), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.leaks(docs, items) and any(r[-1] for r in got.values())


def test_decontaminate_in_several_passes(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = {r["doc_id"]: r for r in D.decontaminate(rows, items).collect()}
    monkeypatch.setattr(D, "PASS_BYTES", 4000)
    assert D.benchmark_passes(items, "item_id", "text") > 1
    assert {r["doc_id"]: r for r in D.decontaminate(rows, items).collect()} == whole


def test_proximity(spark):
    rows = spark.createDataFrame([(1, "x c b a y"), (2, "a x x x x x b c"), (3, "a b"), (4, "b c a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    found = D.find_matches(D.build_index(rows), items, slop=2)
    kinds = defaultdict(set)
    for r in found.filter(F.size("items") > 0).collect():
        kinds[r["kind"]].add(r["doc_id"])
    assert kinds == {"proximity": {1, 4}}


def test_token_counts(spark, docs):
    sp, _ = C._splicer(C.MODEL, None)
    got = by_id(Q.op2_token_counts(spark, SMALL), "n_bytes", "n_tokens", "over_limit")
    assert got == {d: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in docs}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", "  ", " ", "\n", "é", "▁", "日本", "1234", ".", "x y z "]), min_size=30, max_size=200))
def test_spliced_counts_equal_whole(parts):
    text = "".join(parts)
    sp, splicer = C._splicer(C.MODEL, None)
    assert splicer.tokens(text, 40, 8) == len(sp.encode(text))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(C.model_path("byte_bpe_50k.json"))
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in docs}
    rows = Q.op4_best_fit_packing(spark, SMALL).collect()
    seen, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and 0 < r["length"] <= 2048
        seen[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, pieces in seen.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == len(ids[d])
        assert all(p[2] == 2048 for p in pieces[1:]) and (len(pieces) == 1 or len(ids[d]) > 2048)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(seen) == set(ids) and len(fill) <= -(-sum(map(len, ids.values())) // 2048) + 2


def test_packing_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ITEMS", 50)
    monkeypatch.setattr(P, "HAND_ON", 20)
    items = spark.range(2000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1500)) + 1).alias("length"))
    out = P.pack(items).collect()
    fill = defaultdict(list)
    for r in out:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert len(out) == 2000 and len(fill) <= 1.08 * sum(r["length"] for r in out) / 2048


def test_special_string_is_one_token():
    assert P.token_ids("a <|endoftext|> b<|endoftext|>").tolist() == [64, 220, 50256, 275, 50256, 0]


def test_top_k(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    m = np.floor(256 * np.array([r["embedding"] for r in rows], float)).astype(np.int64)
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        score = m @ m[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        want |= {(ids[i], n + 1, ids[j], score[j]) for n, j in enumerate(order)}
    assert {tuple(r) for r in Q.op6_top_k(spark, SMALL).collect()} == want


def test_top_k_blocks_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_VECTORS", 7)
    monkeypatch.setattr(K, "BLOCK_QUERIES", 3)
    rows = [(i, [float(i % 3), -float(i % 2), 0.5]) for i in range(40)]
    rows += [(100, None), (None, [1.0, 1.0, 1.0]), (101, [1.0, None, 1.0]), (102, [float("nan"), 1.0, 1.0]), (103, []), (104, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = K.top_k(df, df.filter("vec_id % 5 = 0"), k=4)
    got = defaultdict(list)
    for r in sorted(map(tuple, out.collect())):
        got[r[0]].append(r[2:])
    m = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:40]}
    want = {q: sorted(((i, int(v @ m[q])) for i, v in m.items() if i != q), key=lambda x: (-x[1], x[0]))[:4] for q in m if q % 5 == 0}
    assert got == want
    assert K.top_k(df.filter("vec_id < 0"), df.filter("vec_id < 0")).isEmpty()


def test_html_region():
    weights = {"word": 0.9, "p": 0.0, "/p": 0.0, "div": -5.0, "/div": -5.0, "article": -100.0, "/article": -100.0}
    page = """<html><head><title>no</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy it now
    please</div><article><h1>T &amp; x</h1><script>var t="</p>";</script><p>One   two<br>three<p>Be.<aside>no</aside>
    <form>no <input></form></article><section id="comments"><p>I like this very much indeed</p></section><footer>f</footer>"""
    assert H.main_text(page, weights) == "T & x\nOne two three\nBe."
    assert H.main_text(None, weights) == H.main_text("", {}) == H.main_text("<!-- open", {}) == ""
    assert H.main_text("a &lt; b &#233; &am", {}) == "a < b é &am"


def test_html_pages(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in Q.op7_html_text(spark, SMALL).collect():
        inner = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = L.learn(docs)
    assert set(learned) == {"de", "en", "es", "fr"} and max(map(len, learned.values())) <= L.DICTIONARY_BYTES
    out = L.language_id(docs, learned).filter(L.held_out())
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    # what a row says of itself is no input
    blind = docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert L.learn(blind) == learned


def test_personal_data(spark, docs):
    got = {r["doc_id"]: (r["base"], r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]) for r in N.find_personal_data(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert {d: b for d, (b, _) in got.items()} == {d: brute.private(t) for d, t in docs}
    assert all(n == (b.count(",") + 1 if b else 0) for b, n in got.values())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@-_ +0123459()é", max_size=60))
def test_patterns(text):
    assert N.listed(N.base_spans(text)) == brute.private(text)


def test_disclosing_terms(spark):
    """A term that comes with a value in different passages goes; common words and one repeated passage don't."""
    rows = [(i, f"in part {i} we saw zorblatt write to boss@corp.example.com on day {i} of it") for i in range(6)]
    rows += [(10 + i, "always the same unusualword next to call +1 (499) 555-6503 here") for i in range(6)]
    rows += [(100 + i, f"we saw nothing on day {i} of it and write to nobody") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in N.find_personal_data(df).collect()}
    terms = {text[int(s) : int(e)] for d, text in rows for k, s, e in (x.split(":") for x in out[d].split(",") if x) if k == "term"}
    assert terms == {"zorblatt"}
    clean = {r["doc_id"]: r["text"] for r in N.sanitise(df).collect()}
    assert clean[0] == "in part 0 we saw  write to <EMAIL> on day 0 of it" and clean[100] == rows[12][1]


def test_odd_rows(spark, odd):
    """No operator fails or loses a row on missing values, blank and very long texts, ties, repeats and clashing names."""
    n = odd.count()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    sub = substring_dedup(odd).collect()
    assert len(sub) == n and sum(r["n_removed"] for r in sub if r["doc_id"] == 8) > 50_000
    assert all(r["n_removed"] > 40 for r in sub if r["doc_id"] == 2) and all(r["n_removed"] == 0 for r in sub if r["doc_id"] == 1)
    suf = X.suffix_dedup(odd).collect()
    assert len(suf) == n and [r["n_removed"] for r in suf if r["doc_id"] == 7] == [brute.suffix([(7, texts[9][1])])[7][1]]
    assert [r["n_removed"] for r in suf if r["doc_id"] == 8] == [len(texts[10][1])]
    sp, _ = C._splicer(C.MODEL, None)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in C.token_counts(odd).collect()) == Counter((d, len(sp.encode(t or ""))) for d, t in texts)
    assert Counter(r["doc_id"] for r in P.pack_documents(odd).filter("piece = 0").collect()) == Counter(d for d, _ in texts)
    near = M.near_duplicates(odd).collect()
    assert Counter(r["doc_id"] for r in near) == Counter(d for d, _ in texts)
    comp = {r["doc_id"]: r["component_id"] for r in near}
    assert comp[8] == 7 and comp[2] == 1 and comp[3] == 3 and comp[None] is None
    items = odd.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 1 or doc_id is null or text is null")
    hit = D.decontaminate(odd, items).collect()
    assert len(hit) == n and {r["doc_id"] for r in hit if r["n_hit"]} == {1, 2, None}
    lang = L.language_id(odd, L.learn(odd))
    assert lang.count() == n and {r["lang_pred"] for r in lang.filter("text IS NULL OR trim(text) = ''").collect()} == {"und"}
    found = {r["doc_id"]: r["base"] for r in N.find_personal_data(odd).collect()}
    assert found[10] == brute.private(texts[12][1]) and found[10].count(":") == 8
    safe = N.sanitise(odd)
    assert safe.columns == odd.columns and safe.count() == n


def test_empty_tables(spark, empty):
    for out in (
        substring_dedup(empty),
        X.suffix_dedup(empty),
        C.token_counts(empty),
        P.pack_documents(empty),
        M.near_duplicates(empty),
        D.decontaminate(empty, empty.withColumnRenamed("doc_id", "item_id")),
        L.language_id(empty, L.learn(empty)),
        N.find_personal_data(empty),
        N.sanitise(empty),
        H.extract_text(pages := empty.withColumnRenamed("text", "html"), H.learn_weights(pages)),
    ):
        assert out.collect() == []


def test_empty_benchmark(spark, docs, empty):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = D.decontaminate(rows, empty.withColumnRenamed("doc_id", "item_id")).collect()
    assert len(out) == len(docs) and not any(r["n_hit"] for r in out)


def test_many_edited_copies(spark):
    """A large group of edited copies gives the links that all pairs would."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(M.near_duplicates(df, shingle=3, percent=85), "n_shingles", "component_id", "kept")
    assert got == brute.near(rows)

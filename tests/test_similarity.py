"""TF-IDF weights and greedy near-duplicate removal against brute force."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import similarity as S


def brute_vectors(titles):
    docs = []
    for t in titles:
        w = re.findall(r"(?u)\b\w\w+\b", t.lower())
        docs.append(Counter(w + [" ".join(p) for p in zip(w, w[1:])]))
    df = Counter(t for d in docs for t in d)
    out = []
    for d in docs:
        v = {t: (1 + math.log(c)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in d.items()}
        n = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / n for t, x in v.items()} if n else {})
    return out


def brute_keep(rows, threshold):
    kept = set()
    for g in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        vec = brute_vectors([r[2] for r in part])
        keep = []
        for j in range(len(part)):
            if not any(sum(x * vec[j].get(t, 0) for t, x in vec[i].items()) >= threshold for i in keep):
                keep.append(j)
        kept |= {part[j][1] for j in keep}
    return kept


def test_weights(spark):
    titles = ["Profit rises at firm", "profit falls at Firm", "a b", "firm firm firm wins"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "g long, id long, title string")
    got = {(r["id"], r["term"]): r["w"] for r in S.tfidf(df, "g", "id", "title").collect()}
    want = {(i, t): w for i, v in enumerate(brute_vectors(titles)) for t, w in v.items()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_term_limit_keeps_most_frequent(spark):
    df = spark.createDataFrame([(1, 1, "aa aa bb bb cc"), (1, 2, "aa bb dd")], "g long, id long, title string")
    got = {r["term"] for r in S.tfidf(df, "g", "id", "title", (1, 1), 2).collect()}
    assert got == {"aa", "bb"}


def test_greedy_matches_brute_force(spark):
    rows, k = [], 0
    for g in (1, 2):
        for b in range(4):
            words = [f"word{b}{i}" for i in range(10)]
            for v in range(9):
                w = list(words)
                for s in range(v % 4):
                    w[(v + 3 * s) % 10] = f"swap{(v * s) % 5}"
                rows.append((g, k, " ".join(w)))
                k += 1
    rows += [(1, 900, "!"), (1, 901, "?"), (2, 902, rows[40][2])]
    df = spark.createDataFrame(rows, "g long, id long, title string")
    for threshold in (0.6, 0.85):
        got = {r["id"] for r in S.leader_dedup(df, "g", "id", "title", threshold).collect()}
        assert got == brute_keep(rows, threshold)


def test_whole_table(small):
    rows = small.articles.select("company_id", "id", "title")
    got = {r["id"] for r in S.leader_dedup(rows, "company_id", "id", "title").collect()}
    assert got == brute_keep([tuple(r) for r in rows.collect()], 0.85)


def test_chain_keeps_both_ends(spark):
    a, b, c = "aa bb cc dd ee ff gg hh", "aa bb cc dd ee ff gg zz", "aa bb cc dd ee ff yy zz"
    df = spark.createDataFrame([(1, 1, a), (1, 2, b), (1, 3, c)], "g long, id long, title string")
    v = brute_vectors([a, b, c])
    sim = lambda i, j: sum(x * v[j].get(t, 0) for t, x in v[i].items())
    threshold = (min(sim(0, 1), sim(1, 2)) + sim(0, 2)) / 2
    out = S.near_duplicates(df, "g", "id", "title", threshold).collect()
    assert [(r["id"], r["leader"]) for r in out] == [(2, 1)]
    assert out[0]["cosine"] == pytest.approx(sim(0, 1))


def test_pairs_match_brute_force(spark):
    titles = ["aa bb cc dd ee ff gg hh", "aa bb cc dd ee ff gg zz", "aa bb cc dd ee ff gg hh", "xx yy", "aa bb cc dd ee ff gg zz kk"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "g long, id long, title string")
    v = brute_vectors(titles)
    dot = lambda i, j: sum(x * v[j].get(t, 0) for t, x in v[i].items())
    want = {(i, j): dot(i, j) for i in range(5) for j in range(i + 1, 5) if dot(i, j) >= 0.5 and i != 2 and j != 2}
    got = {(r["i"], r["j"]): r["cosine"] for r in S.near_duplicate_pairs(df, "g", "id", "title", 0.5).collect()}
    assert want and got == pytest.approx(want)


def test_all_pairs_follow_from_classes_and_pairs(spark, monkeypatch):
    """Every close pair of rows, copies included; long lists of a term are cut into blocks of three texts."""
    monkeypatch.setattr(S, "LIST_BLOCK", 3)
    words = [f"word{i}" for i in range(12)]
    titles = [" ".join(words[: 9 + k % 3] + [f"tail{k % 5}"]) for k in range(30)] + ["xx yy"] * 3 + [" ".join(words)] * 4
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "g long, id long, title string")
    v = brute_vectors(titles)
    dot = lambda i, j: sum(x * v[j].get(t, 0) for t, x in v[i].items())
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if dot(i, j) >= 0.8}
    members = {}
    for r in S.vector_classes(df, "g", "id", "title").collect():
        members.setdefault(r["rep"], []).append(r["id"])
        assert r["n"] == sum(titles[r["id"]] == t for t in titles)
    got = {(min(a, b), max(a, b)) for ids in members.values() for a in ids for b in ids if a != b}
    for r in S.near_duplicate_pairs(df, "g", "id", "title", 0.8).collect():
        got |= {(min(a, b), max(a, b)) for a in members[r["i"]] for b in members[r["j"]]}
    assert got == want


def test_many_copies_give_few_pairs(spark):
    df = spark.range(400).select(F.lit(1).alias("g"), "id", F.lit("the same headline again").alias("title"))
    out = S.near_duplicates(df, "g", "id", "title")
    assert out.count() == 399 and out.filter("leader = 0").count() == 399


def test_weights_of_texts_in_several_rows_and_blocks(spark, monkeypatch):
    """Rows that share group and id are one text, whose pairs don't cross rows; blocks of counts end between texts."""
    monkeypatch.setattr(S, "_BLOCK", 3)
    monkeypatch.setattr(S, "_TEXTS", 2)
    rows = [(1, 1, "aa bb aa bb"), (1, 1, "bb cc"), (1, 2, "bb cc dd"), (None, 3, "aa bb"), (1, None, "dd ee"), (1, 4, None), (2, 1, "aa")]
    df = spark.createDataFrame(rows, "g long, id long, title string")
    got = {(r["g"], r["id"], r["term"]): (r["df"], r["w"]) for r in S.tfidf(df, "g", "id", "title").collect()}
    tf = {
        (1, 1): {"aa": 2, "bb": 3, "cc": 1, "aa bb": 2, "bb aa": 1, "bb cc": 1},
        (1, 2): {"bb": 1, "cc": 1, "dd": 1, "bb cc": 1, "cc dd": 1},
        (1, None): {"dd": 1, "ee": 1, "dd ee": 1},
        (2, 1): {"aa": 1},
    }
    docs, want = {1: 5, 2: 1}, {}
    for (g, i), terms in tf.items():
        df = {t: sum(t in x for (h, _), x in tf.items() if h == g) for t in terms}
        v = {t: (1 + math.log(c)) * (math.log((1 + docs[g]) / (1 + df[t])) + 1) for t, c in terms.items()}
        want |= {(g, i, t): (df[t], pytest.approx(x / math.sqrt(sum(y * y for y in v.values())))) for t, x in v.items()}
    assert got == want


def test_weights_collect_no_arrays(spark, capsys):
    """The rows of a text are dealt to one task before they are put together, and the weights need no arrays at all."""
    df = spark.createDataFrame([(1, 1, "aa bb"), (1, 2, "aa cc")], "g long, id long, title string")
    S.tfidf(df, "g", "id", "title").explain()
    assert "collect_list" not in capsys.readouterr().out
    S.vectors(df, "g", "id", "title").explain()
    plan = capsys.readouterr().out
    # read from the top: both halves of the aggregate come before the exchange by group and id
    assert plan.index("partial_collect_list") < plan.index("Exchange hashpartitioning(g#")


def test_block_vectors_match_brute_force(spark, monkeypatch):
    """Blocks and buckets of a few words: terms of several blocks, rows of one text, and rows without terms, id or group."""
    for name, value in (("_WORDS", 5), ("_TEXTS", 2), ("_BUCKET", 3)):
        monkeypatch.setattr(S, name, value)
    rows = [(1, 1, "aa bb aa bb"), (1, 1, "bb cc"), (1, 2, "Bb cc dd"), (None, 3, "aa bb"), (1, None, "dd ee"), (1, 4, None), (2, 1, "aa"), (2, 2, "a b")]
    rows += [(1, 10 + k, f"aa bb cc tail{k % 4} end{k}") for k in range(20)] + [(2, 30, "aa bb"), (2, 31, "aa bb")]
    rows += [(1, 10 + k, f"aa bb cc tail{k % 4} end{k}") for k in range(19, -1, -2)]  # these come twice, far apart
    df = spark.createDataFrame(rows, "g long, id long, title string").repartition(3)
    docs, tf = Counter(r[0] for r in rows), {}
    for g, i, title in rows:
        w = re.findall(r"(?u)\b\w\w+\b", (title or "").lower())
        if g is not None and w:
            tf.setdefault((g, i), Counter()).update(w + [" ".join(p) for p in zip(w, w[1:])])
    want = {}
    for (g, i), terms in tf.items():
        n = {t: sum(t in x for (h, _), x in tf.items() if h == g) for t in terms}
        x = {t: (1 + math.log(c)) * (math.log((1 + docs[g]) / (1 + n[t])) + 1) for t, c in terms.items()}
        want[g, i] = sorted((n[t], x[t] / math.sqrt(sum(y * y for y in x.values()))) for t in terms)
    found = S.hashed_vectors(df, "g", "id", "title").collect()
    got = {(r["g"], r["id"]): sorted((e["df"], e["w"]) for e in r["v"]) for r in found}
    assert got.keys() == want.keys() and len(found) == len(got)
    for k, v in want.items():
        assert [x for x, _ in got[k]] == [x for x, _ in v] and [x for _, x in got[k]] == pytest.approx([x for _, x in v])
    assert all([(e["df"], e["term"]) for e in r["v"]] == sorted((e["df"], e["term"]) for e in r["v"]) for r in found)
    same = {(r["g"], r["id"]): r["rep"] for r in S.vector_classes(df, "g", "id", "title").collect()}
    assert same[2, 31] == 30 and all(same[k] == k[1] for k in same if k != (2, 31))


def test_pairs_store_no_counts_by_term_and_text(spark, monkeypatch):
    """The counts of terms are stored and dealt as arrays, not as a row per term and text."""
    stored = []
    monkeypatch.setattr(S, "checkpointed", lambda df, real=S.checkpointed: stored.append(df.columns) or real(df))
    df = spark.createDataFrame([(1, i, f"aa bb cc dd ee ff gg hh x{i % 2}") for i in range(6)], "g long, id long, title string")
    S.near_duplicates(df, "g", "id", "title").collect()
    assert stored and ["g", "id", "term", "tf"] not in stored


def test_pairs_are_compared_in_blocks(spark, monkeypatch):
    """A vector goes to the block of a hub once, not a row per term to every pair; hubs of many texts are cut into parts."""
    monkeypatch.setattr(S, "_COMPARED", 60)
    stored = []
    monkeypatch.setattr(S, "checkpointed", lambda df, real=S.checkpointed: stored.append(df.columns) or real(df))
    words = [f"word{i}" for i in range(12)]
    titles = [" ".join([f"w{k // 10}", *words[: 9 + k % 3], f"tail{k}"]) for k in range(40)] + ["alone here", "no pair"]
    rows = [(g, i, t) for g in (1, 2) for i, t in enumerate(titles)]  # ids are those of a group
    df = spark.createDataFrame(rows, "g long, id long, title string")
    v = brute_vectors(titles)
    dot = lambda i, j: sum(x * v[j].get(t, 0) for t, x in v[i].items())
    want = {(g, i, j): dot(i, j) for g in (1, 2) for i in range(len(v)) for j in range(i + 1, len(v)) if dot(i, j) >= 0.5}
    for vecs in (S.hashed_vectors(df, "g", "id", "title"), S.vectors(df, "g", "id", "title", spelled=True)):
        found = S.near_pairs(vecs, "g", "id", 0.5).collect()
        assert len(found) == len(want) > 50 and {(r["g"], r["i"], r["j"]): r["cosine"] for r in found} == pytest.approx(want)
    assert ["g", "id", "term", "w"] not in stored


def test_stable_order_of_large_and_equal_numbers():
    rng = np.random.default_rng(7)
    for most in (1, 300, 1 << 16, 1 << 40):
        a, b = rng.integers(0, most, 5000), rng.integers(0, 3, 5000)
        assert (S._stable_order(a, b) == np.lexsort((a, b))).all()
    assert len(S._stable_order(np.zeros(0, np.int64))) == 0


def disk_in_use(spark, monkeypatch, run):
    """Bytes of a table of texts, and the most that stored tables and shuffles take after any stored step and after the last one."""
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(5000)]
    rows = [(k % 3, k, " ".join(words[int(draw.random() ** 2 * 5000)] for _ in range(200))) for k in range(3000)]
    rows += [(g, k + 5000, title + " and more") for g, k, title in rows[:100]] + [(g, k + 9000, title) for g, k, title in rows[:50]]
    df = S.checkpointed(spark.createDataFrame(rows, "g long, id long, title string"))
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    shuffles = lambda: {f: os.path.getsize(f) for f in files() if "/shuffle_" in f and os.path.exists(f)}
    before, stored, most = set(shuffles()), [0], [0]

    def note():
        most[0] = max(most[0], stored[0] + sum(n for f, n in shuffles().items() if f not in before))

    def checkpointed(df, real=S.checkpointed):
        out = real(df)
        stored[0] += sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        note()
        return out

    monkeypatch.setattr(S, "checkpointed", checkpointed)
    run(df).write.format("noop").mode("overwrite").save()
    note()
    return sum(len(r[2]) for r in rows), most[0]


@pytest.mark.parametrize("name", ["tfidf", "vector_classes", "near_duplicate_pairs", "near_duplicates", "leader_dedup"])
def test_disk_stays_near_the_text(spark, monkeypatch, name):
    """No term of a text is stored or dealt as a row or a number of its own, and shuffles go with the step that wrote them."""
    text, most = disk_in_use(spark, monkeypatch, lambda df: getattr(S, name)(df, "g", "id", "title"))
    assert most < 2 * text, f"{most / text:.2f} times the text"


@pytest.mark.parametrize("ngram", [(1, 3), (2, 2), (1, 1)])
def test_weights_of_blocks_and_rounds_match_brute_force(spark, monkeypatch, ngram):
    """Blocks and buckets of a few words in three rounds, rows that share a text, and rows without words, id or group."""
    for name, value in (("_WORDS", 7), ("_TEXTS", 2), ("_BUCKET", 3), ("_BLOCK", 4)):
        monkeypatch.setattr(S, name, value)
    rows = [("a", "1", "Aa bb aa bb cc"), ("a", "1", "bb cc"), (None, "3", "aa bb"), ("a", None, "dd ee"), ("a", "4", None), ("b", "1", "aa"), ("b", "2", "a b")]
    rows += [("a", f"k{k}", f"aa bb cc tail{k % 4} \u00e9t\u00e9 \u6f22\u5b57 end{k % 7}") for k in range(20)] + [("b", "5", "aa bb"), ("b", "6", "aa bb")]
    df, tf, docs = spark.createDataFrame(rows, "g string, id string, title string").repartition(3), {}, Counter(r[0] for r in rows)
    for g, i, title in rows:
        w = re.findall(r"(?u)\b\w\w+\b", (title or "").lower())
        grams = [" ".join(p) for n in range(ngram[0], ngram[1] + 1) for p in zip(*(w[k:] for k in range(n)))]
        if g is not None and grams:
            tf.setdefault((g, i), Counter()).update(grams)
    want = {}
    for (g, i), terms in tf.items():
        n = {t: sum(t in x for (h, _), x in tf.items() if h == g) for t in terms}
        x = {t: (1 + math.log(c)) * (math.log((1 + docs[g]) / (1 + n[t])) + 1) for t, c in terms.items()}
        want |= {(g, i, t): (n[t], pytest.approx(x[t] / math.sqrt(sum(y * y for y in x.values())))) for t in terms}
    found = S.tfidf(df, "g", "id", "title", ngram).collect()
    assert len(found) == len(want) and {(r["g"], r["id"], r["term"]): (r["df"], r["w"]) for r in found} == want


def test_packed_numbers():
    for x in ([], [0], [255], [1, 256, 65535, 1 << 40], list(range(1000))):
        assert S._unpacked(S._packed(np.array(x, np.int64))).tolist() == x

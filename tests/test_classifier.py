"""The headline classifier against dense least loss, and its folds."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import headline_classifier as H

SCHEMA = "id long, title string, label string, source string"


def dense(rows, reg):
    """Newton's method on TF-IDF of words and pairs; (probability of a title) and the least loss."""
    docs = []
    for _, title, _, _ in rows:
        w = [x for x in re.split(r"\W+", (title or "").lower()) if x]
        docs.append(Counter(w + list(zip(w, w[1:]))))
    vocab = {t: i for i, t in enumerate(sorted({t for d in docs for t in d}, key=str))}
    df = Counter(t for d in docs for t in d)
    x = np.zeros((len(rows), len(vocab) + 1))
    x[:, -1] = 1
    for i, d in enumerate(docs):
        for t, c in d.items():
            x[i, vocab[t]] = c * np.log((len(rows) + 1) / (df[t] + 1)) / np.sqrt(sum(d.values()))
    y = np.array([r[2] == "relevant" for r in rows], float)
    wi, wr = len(y) / (2 * (1 - y).sum()), len(y) / (2 * y.sum())
    w = np.where(y == 1, min(wr, 1.5 * wi), wi) * np.array([5.0 if r[3] == "gold_manual" else 1.0 for r in rows])
    pen = np.full(x.shape[1], reg)
    pen[-1] = 0
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        g = x.T @ (w * (p - y)) / w.sum() + pen * beta
        hess = (x.T * (w * p * (1 - p))) @ x / w.sum() + np.diag(pen + 1e-12)
        beta -= np.linalg.solve(hess, g)
    return 1 / (1 + np.exp(-x @ beta))


def sample():
    rng = np.random.default_rng(4)
    words = np.array("gain loss firm rise fall deal court wins opens ends".split())
    rows = []
    for i in range(80):
        title = " ".join(rng.choice(words, 6))
        good = ("gain" in title) + ("rise" in title) + rng.normal() > 1
        rows.append((i, title, "relevant" if good else "irrelevant", "gold_manual" if i % 7 == 0 else "llm_v2"))
    return rows


def test_solution_equals_dense_newton(spark):
    rows = sample()
    model, dealt = H.fit_classifier(spark.createDataFrame(rows, SCHEMA), folds=4, reg=(0.1, 0.02))
    assert set(model.f1) == {0.1, 0.02} and model.f1[model.regularisation] == max(model.f1.values())
    got = {r["id"]: r["probability"] for r in model.scored(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = dense(rows, model.regularisation)
    assert [got[r[0]] for r in rows] == pytest.approx(list(want), abs=5e-3)
    # each fold's model is that of the other rows
    fold = {r["id"]: r["fold"] for r in dealt.collect()}
    one = [r for r in rows if fold[r[0]] != 2]
    got = {r["id"]: r["probability"] for r in model.scored(dealt.withColumn("two", F.lit(2)), "two").collect()}
    assert [got[r[0]] for r in one] == pytest.approx(list(dense(one, model.regularisation)), abs=5e-3)


def test_classifier_scores_rows_it_has_not_seen(spark):
    """A word of one row alone tells its label only to a model that was fitted to that row."""
    rows = [(i, f"same word{i}", "relevant" if i % 2 else "irrelevant", "llm_v2") for i in range(12)]
    out = H.held_out_scores(spark.createDataFrame(rows, SCHEMA), folds=2, features=1 << 12, reg=(0.1,)).collect()
    assert sorted(r["id"] for r in out) == list(range(12))
    assert any((r["label"] == "relevant") != (r["prediction"] == 1.0) for r in out)


def test_odd_rows(spark):
    rows = [(1, None, "relevant", "a"), (2, "", "irrelevant", None), (3, "x", "other", "a"), (4, "x y", None, "a"), (5, "x y", "relevant", "gold_manual")]
    out = H.held_out_scores(spark.createDataFrame(rows, SCHEMA), folds=2, reg=(0.1,)).collect()
    assert sorted(r["id"] for r in out) == [1, 2, 5]
    assert H.held_out_scores(spark.createDataFrame([], SCHEMA), folds=2, reg=(0.1,)).count() == 0
    same = [(i, f"word {i}", "relevant", "a") for i in range(6)]
    assert all(r["prediction"] == 1.0 for r in H.held_out_scores(spark.createDataFrame(same, SCHEMA), folds=2, reg=(0.1,)).collect())


def test_titles_are_split_once(spark, monkeypatch):
    """The stored term numbers serve the folds, the fits, the choice of the regularisation and the scores."""
    calls, real = [], H.terms
    monkeypatch.setattr(H, "terms", lambda *a: calls.append(a) or real(*a))
    rows = sample()
    out = H.held_out_scores(spark.createDataFrame(rows, SCHEMA), folds=4, reg=(0.1, 0.02)).collect()
    assert len(calls) == 1 and len(out) == len(rows)


def test_small_blocks_and_the_f1_of_the_scores(spark, monkeypatch):
    """Blocks of a few texts give the same solution; the F1 of the choice is that of the rows' scores by fold."""
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    whole, _ = H.fit_classifier(df, folds=4, reg=(0.1,))
    monkeypatch.setattr(H, "_blocks", _cut_blocks(20))
    model, dealt = H.fit_classifier(df, folds=4, reg=(0.1,))
    assert model.f1[0.1] == pytest.approx(whole.f1[0.1]) and np.allclose(model.coefficients, whole.coefficients, atol=1e-6)
    each = {}
    for r in model.scored(dealt, "fold").collect():
        hit = each.setdefault(r["fold"], [0, 0])
        hit[0] += r["prediction"] == 1.0 and r["label"] == "relevant"
        hit[1] += (r["prediction"] == 1.0) != (r["label"] == "relevant")
    assert model.f1[0.1] == pytest.approx(np.mean([2 * t / max(1, 2 * t + w) for t, w in each.values()]))


def _cut_blocks(most):
    real = H._blocks

    def cut(batches):
        H._BLOCK_TERMS = most
        yield from real(batches)

    return cut

"""The toxicity score: held-out accuracy, the model's probabilities against a plain recursion, odd rows."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditloom.llm import queries, toxicity
from auditloom.llm.quality import calibrate

SF = os.environ.get("TEST_LARGE_DIR", "/root/testdata/sf0.1")


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1.0
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_accuracy(spark):
    scored = queries.QUERIES["op11_kneser_ney_toxicity"](spark, SF)
    rows = scored.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    y = rows["toxic"].to_numpy()
    assert auc(rows["score"].to_numpy(), y) > 0.96
    assert rows["predicted"][y == 1].mean() > 0.75 and rows["predicted"][y == 0].mean() < 0.02
    assert ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()


def brute(words, counts):
    """P(letter | context) by class: own counts of six letters, shared Kneser-Ney counts below."""
    k, d = toxicity.ORDER, toxicity.DISCOUNT
    own, sequences = [Counter(), Counter()], set()
    for w, n in zip(words, counts.T, strict=True):
        x = "\x02" * (k - 1) + w + "\x03"
        for i in range(k, len(x) + 1):
            sequences.add(x[i - k : i])
            for c in (0, 1):
                own[c][x[i - k : i]] += n[c]
    shared, longer = {}, sequences
    for order in range(k - 1, 0, -1):
        shared[order] = Counter(s[1:] for s in longer)
        longer = set(shared[order])

    def of(table, s, low):
        same = {t: n for t, n in table.items() if t[:-1] == s[:-1] and n}
        total = sum(same.values())
        return (max(same.get(s, 0) - d, 0) + d * len(same) * low) / total if total else low

    def lower(s):
        p = 1 / toxicity.LETTERS
        for order in range(1, k):
            p = of(shared[order], s[-order:], p)
        return p

    def ratio(w):
        x = "\x02" * (k - 1) + w + "\x03"
        total = 0.0
        for i in range(k, len(x) + 1):
            p = [of(own[c], x[i - k : i], lower(x[i - k : i])) for c in (0, 1)]
            total += math.log(p[1]) - math.log(p[0])
        return math.log(1 - toxicity.SHARE + toxicity.SHARE * math.exp(min(total, 60)))

    return ratio


def test_model_against_a_plain_recursion():
    words = ["the", "then", "idiot", "idiots", "thin", "été", "étés", "a", "clown", "ordinary"]
    counts = np.array([[50, 20, 1, 0, 9, 4, 0, 80, 0, 7], [6, 2, 9, 3, 0, 0, 2, 9, 5, 0]], float)
    model, ratio = toxicity._tables(words, counts), brute(words, counts)
    for w in [*words, "idiotic", "clowns", "zebra", "th", "étant"]:
        letters = toxicity.spelling([w])
        got = model.words(letters, *toxicity._bounds(letters))
        assert got == pytest.approx([ratio(w)], abs=1e-5), w
    assert ratio("idiot") > 1 > 0.1 > abs(ratio("zebra"))


def test_features_are_sums_over_words():
    model = toxicity._tables(["good", "bad"], np.array([[9, 1], [1, 9]], float))
    texts = ["Bad, BAD good!", "", "...", "bad\nunseen 12 x3y", "ŉ İ é"]
    letters = toxicity.spelling([texts[0]])
    assert toxicity.words_of(texts[3]) == ["bad", "unseen", "x", "y"]
    each = model.words(letters, *toxicity._bounds(letters))
    got = model.features(texts)
    assert got[0] == pytest.approx(np.log(each.sum() / (3 + toxicity.PRIOR_WORDS) - np.log1p(-toxicity.SHARE) + toxicity.LEAST))
    assert got[1] == got[2] and np.isfinite(got).all()
    assert model.features([texts[3]])[0] == pytest.approx(got[3])


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, 0, 0), (None, 1, 1), (8, 0, 0), (8, 0, 1), (12, 0, 1), (6, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["score"])
    assert len(by[3]) == 1 and by[4] == by[5] == by[10]
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    alone = toxicity.fit(odd, labels.where("toxic = 1"))
    assert {round(r["score"], 6) for r in toxicity.score(odd, alone).collect()} == {round(1 / (1 + math.exp(-alone.intercept)), 6)}
    assert calibrate(np.array([0.0, 0.1, 1.0, 1.1]), np.array([0.0, 0.0, 1.0, 1.0]), np.ones(4))[0] > 0

import math
import random
import re

import numpy as np
import pytest

from panelcast.llm import toxicity
from panelcast.llm.common import RollingHash

BAD = ["grub", "slud", "vark"]


def corpus(n, seed):
    rng = random.Random(seed)
    docs = []
    for k in range(n):
        words = [f"word{int(rng.expovariate(0.02))}" for _ in range(rng.randint(5, 120))]
        grade = rng.choice([0, 0, 0, 1, 2])
        for _ in range(grade * 2):
            words.insert(rng.randrange(len(words)), rng.choice(BAD if grade == 1 else [b + "ling" for b in BAD]))
        docs.append((k, " ".join(words), grade))
    return docs


def test_held_out_grades(spark):
    docs = corpus(700, 1)
    table = spark.createDataFrame([(k, t, "x") for k, t, _ in docs], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(k, g) for k, _, g in docs[:500]], "doc_id long, grade int")
    model = toxicity.fit(table, labels)
    assert np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [(got[k], g) for k, _, g in docs[500:]]
    assert np.mean([r.rejected == (g > 0) for r, g in held]) > 0.95
    mean = [np.mean([r.severity for r, g in held if g == v]) for v in (0, 1, 2)]
    assert mean[0] < mean[1] < mean[2]
    kept = toxicity.drop_toxic(table, model)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.rejected}


def test_weights_are_shared_and_likelihood_gradient_is_right():
    rng = np.random.default_rng(0)
    rows, cols = np.repeat(np.arange(300), 3), rng.integers(0, 6, 900)
    x = np.zeros((300, 6))
    x[rows, cols] = 1
    keep = np.unique(rows * 6 + cols)
    rows, cols = keep // 6, keep % 6
    y = np.clip((x @ np.array([2, -2, 0, 0, 1, 0]) + rng.logistic(size=300)).round().astype(int), 0, 2)
    w, t = toxicity.fit_ordinal(rows, cols, y, 6, 3, l1=1e-4, steps=3000)

    def loss(w, t):
        c = np.column_stack([np.zeros(300), *(1 / (1 + np.exp(-(a - x @ w))) for a in t), np.ones(300)])
        return -np.log(np.diff(c, axis=1)[np.arange(300), y]).mean() + 1e-4 * np.abs(w).sum()

    best = loss(w, t)
    for _ in range(200):
        assert loss(w + rng.normal(size=6) * 0.05, t + rng.normal(size=2) * 0.05) > best - 1e-4


@pytest.mark.parametrize("labelled", [[], [(1, 0), (2, None), (None, 2), (99, 2)]])
def test_few_labels_nulls_and_empties(spark, labelled):
    table = spark.createDataFrame([(1, "fine"), (2, None), (3, ""), (3, ""), (None, "word")], "doc_id long, text string")
    model = toxicity.fit(table, spark.createDataFrame(labelled, "doc_id long, grade int"))
    rows = toxicity.score(table, model).collect()
    assert len(rows) == 5 and not any(r.rejected for r in rows)
    assert toxicity.score(table.limit(0), model).count() == 0


def test_the_sample_is_bounded_after_the_join(spark):
    same = spark.range(20_000).selectExpr("1L AS doc_id", "concat('word', id % 7000, ' bad') AS text")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, grade int")
    sets = toxicity.labelled_sets(same, labels, 2).collect()
    assert len(sets) == 2 and all(r.grade == 1 for r in sets)
    again = toxicity.labelled_sets(same.unionByName(same), labels, 20_000)
    assert again.count() == 7000


def plain_severity(model, text):
    """Score and expected grade of one text, word by word."""
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    known = set()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", low):
        known |= {hash_of(w), *(hash_of(w[:n]) ^ n for n in toxicity.PREFIXES)}
    score = sum(weight.get(h, 0.0) for h in known)
    return sum(1 / (1 + math.exp(-(score - t))) for t in model.thresholds)


def hash_of(word):
    data = np.frombuffer(word, np.uint8)
    return int(RollingHash(data).of(np.array([0]), np.array([len(data)]))[0])


def test_scores_match_a_plain_sum(spark):
    docs = [*corpus(200, 5), (900, None, 0), (901, "", 0), (902, "Grub GRUBLING slud-ding é grub " * 2000, 0), (3, "vark again", 0)]
    table = spark.createDataFrame([(k, t, 7) for k, t, _ in docs], "doc_id long, text string, severity int")
    model = toxicity.fit(table, spark.createDataFrame([(k, g) for k, _, g in docs[:200]], "doc_id long, grade int"))
    want = sorted((k, plain_severity(model, t)) for k, t, _ in docs)
    rows = sorted((r.doc_id, r.severity, r.grade, r.rejected) for r in toxicity.score(table, model).collect())
    assert [r[0] for r in rows] == [w[0] for w in want]
    assert [r[1] for r in rows] == pytest.approx([w[1] for w in want])
    assert all(g == math.floor(s + 0.5) and x == (s >= toxicity.REJECT_AT) for _, s, g, x in rows)

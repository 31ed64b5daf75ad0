import random
import re

import pytest

from panelcast.llm.components import components
from panelcast.llm.jaccard import bands_and_rows, drop_near_duplicates, jaccard_join

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, n=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs, threshold=0.8):
    classes = {}
    for k, t in docs:
        if k is not None:
            classes.setdefault(grams(t), []).append(k)
    rep = {g: min(v) for g, v in classes.items()}
    links = {g: [h for h in classes if h != g and g and len(g & h) >= threshold * len(g | h) - 1e-9 and g & h] for g in classes}
    root = {}
    for g in classes:
        seen, todo = {g}, [g]
        while todo:
            for h in links[todo.pop()]:
                if h not in seen:
                    seen.add(h)
                    todo.append(h)
        root[g] = min(rep[h] for h in seen)
    return sorted((k, rep[grams(t)], len(links[grams(t)]), root[grams(t)]) for k, t in docs if k is not None)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(5)
    docs = []
    for _ in range(12):
        base = [f"v{rng.randrange(400)}é" for _ in range(rng.choice([8, 60, 200]))]
        docs += [" ".join(base), " ".join(base).upper().replace("É", "é")] + [edited(rng, base, rng.randrange(0, 6)) for _ in range(rng.randrange(0, 9))]
    docs += ["", None, "...", "one", "One!", "two words", "a b c d e", "a b c d e", " ".join(f"x{k}" for k in range(9000))]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [1_000_000, 150])
def test_all_links_and_groups_are_found(spark, block):
    docs = corpus()
    table = spark.createDataFrame([(k, t, "c", 1) for k, t in docs] + [(3, dict(docs)[3], "c", 1), (None, "one", "", 2)], "doc_id long, text string, class_id string, unit int")
    got = [r for r in jaccard_join(table, block_ngrams=block).collect() if r.doc_id is not None]
    assert sorted({(r.doc_id, r.class_id, r.n_links, r.group_id) for r in got}) == brute(docs)
    assert len(got) == len(docs) + 1
    kept = drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {g for *_, g in brute(docs)} | {None}


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (7, 7), (101, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100}


def test_components_of_a_large_star_and_many_pairs(spark):
    edges = [(k, 5) for k in range(100, 3100)] + [(5, 2)] + [(10_000 + 2 * k, 10_001 + 2 * k) for k in range(2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 2 for k in (2, 5, *range(100, 3100))} | {10_000 + k: 10_000 + k - k % 2 for k in range(4000)}
    assert got == want


def test_bands_reach_the_target_recall():
    b, r = bands_and_rows(0.8, 1e-5)
    assert (1 - 0.8**r) ** b <= 1e-5


def test_each_row_is_judged_by_its_own_text(spark):
    a, b, c, d = (" ".join(f"{p}{k}" for k in range(60)) for p in "abcd")
    near = lambda t: t + " end"
    # id 5 bears four texts, one of them near a lower id; rows without an id repeat and are near each other
    rows = [(1, a), (5, near(a)), (5, b), (5, c), (5, "one more text"), (7, near(b)), (8, near(c)), (9, "alone"), (9, "alone"), (None, d), (None, near(d)), (None, near(d)), (None, near(c))]
    table = spark.createDataFrame([(k, t, j % 2) for j, (k, t) in enumerate(rows)], "doc_id long, text string, other int")
    links = sorted(((r.doc_id, r.class_id, r.class_size, r.n_links, r.group_id) for r in jaccard_join(table).collect()), key=str)
    want = [(1, 1, 1, 1, 1), (5, 5, 1, 1, 1), (5, 5, 1, 1, 5), (5, 5, 1, 1, 5), (5, 5, 1, 0, 5), (7, 7, 1, 1, 5), (8, 8, 2, 1, 5), (9, 9, 2, 0, 9), (9, 9, 2, 0, 9), (None, None, 1, 1, None), (None, None, 2, 1, None), (None, None, 2, 1, None), (None, 8, 2, 1, 5)]
    assert links == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(table).collect()), key=str)
    ids = [k for k, _ in kept]
    assert [x for x in kept if x[0] is not None] == sorted([(1, a), (5, b), (5, c), (5, "one more text"), (9, "alone")], key=str)
    assert ids.count(None) == 2 and (None, near(c)) in kept

import hashlib
import random
import re

import pytest

from panelcast.llm.decontaminate import contamination, drop_contaminated, matches

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def longest_of(doc_id, text, items):
    """Words, place and item of the longest match."""
    best = min(((-n, i, k, j) for _, k, i, j, n in brute_matches([(doc_id, text)], items)), default=(0, None, None))
    return (-best[0], *best[1:3])


def brute(docs, items):
    windows = []
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        windows += [(str(k), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(k)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), *longest_of(doc_id, text, items)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    vocab = ["a", "b", "c", "dé", "É", "x1", "über"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 5, 13, 20, 40]))) for k in range(12)] + [(90, None), (91, "..."), (92, ""), (9, "Same, item"), (9, "same item")]
    docs = [(k, text(rng.randint(0, 300))) for k in range(12)]
    docs += [(50 + k, text(100) + ". " + t + "! " + text(50)) for k, (_, t) in enumerate(items) if t]
    return docs + [(200, None), (201, ""), (202, "SAME\x00item"), (202, "SAME\x00item"), (None, "same item"), (203, "—…")], items


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_matches_brute_force_in_one_or_many_blocks(spark, block):
    docs, items = cases()
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string")
    got = sorted((tuple(r) for r in contamination(d, b, block_bytes=block).collect()), key=str)
    assert got == brute(docs, items)
    bad = {r[0] for r in got if r[5]}
    kept = drop_contaminated(d, b, block_bytes=block)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((k for k, _ in docs if k not in bad), key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert contamination(d, b).count() == 0
    one = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in contamination(one, b).collect()] == [(1, 2, 0, 0)]


@pytest.mark.parametrize("block", [8 << 20, 10])
def test_rows_that_share_an_id_are_judged_one_by_one(spark, block):
    rows = [(1, "same item"), (1, "clean words"), (1, None), (None, "same item"), (None, "other words"), (2, "same item"), (2, "same item"), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, "same item"), (2, "never met")], "item_id long, text string")
    kept = sorted((tuple(r) for r in drop_contaminated(d, b, block_bytes=block).collect()), key=str)
    assert kept == sorted((r for r in rows if r[1] != "same item"), key=str)


def brute_matches(docs, items):
    out = []
    for doc_id, text in docs:
        w = words(text)
        for item, t in items:
            v = words(t)
            for i in range(len(w)):
                for j in range(len(v)):
                    if w[i] == v[j] and not (i and j and w[i - 1] == v[j - 1]):
                        n = 0
                        while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                            n += 1
                        if n >= min(13, len(v)):
                            out.append((doc_id, str(item), i, j, n))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_longest_matches_and_their_places(spark, block):
    docs, items = cases()
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, place int")
    b = spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string")
    got = sorted((tuple(r) for r in matches(d, b, block_bytes=block).collect()), key=str)
    assert got == brute_matches(docs, items)
    assert max(r[4] for r in got) > 13
    assert matches(d.limit(0), b).count() == 0 and matches(d, b.limit(0)).count() == 0

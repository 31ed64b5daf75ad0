import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelcast.llm import suffixes
from panelcast.llm.queries import op10_suffix_array_dedup


def brute(docs, length):
    raws = [(k, (t or "").encode()) for k, t in docs]
    seen = Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for k, r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        hit = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(r, hit.tolist(), strict=True) if not g)
        runs = int(np.sum(np.diff(np.concatenate([[0], hit.astype(int)])) == 1))
        out.append((k, len(r), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abñ") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(6, 60)) for _ in range(5)]
    docs = []
    for _ in range(25):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randint(5, 300)], text(rng.randint(0, 20))]
        docs.append("".join(parts))
    base = text(120)
    docs += [base[:50] + "X" + base[50:], base[:300] + "Y" + base[301:], base, base, "ab" * 150, "z" * 100, "", None, "short", "short"]
    return list(enumerate(docs)) + [(3, docs[3]), (None, "null id " * 20)]


@pytest.mark.parametrize(("seed", "length", "gram", "unit", "hot", "wide"), [(1, 40, 8, 8 << 20, 1 << 20, 1 << 20), (2, 40, 8, 900, 2, 1 << 20), (3, 33, 5, 2000, 4, 1), (4, 64, 16, 8 << 20, 1, 2), (5, 40, 8, 900, 1, 0)])
def test_matches_brute_force(spark, seed, length, gram, unit, hot, wide):
    docs = corpus(seed)
    table = spark.createDataFrame([(k, t, 1, "h") for k, t in docs], "doc_id long, text string, n_bytes int, h string").repartition(3)
    rows = suffixes.remove_repeats(table, length, gram, keep_bytes=True, unit_bytes=unit, hot=hot, wide=wide).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in rows), key=str)
    assert got == brute(docs, length)
    assert any(0 < r[2] < r[1] for r in got)


def test_given_table(spark, data_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op10_suffix_array_dedup(spark, data_dir).collect()), key=str)
    assert got == [r[:5] for r in brute(docs, 200)]


def test_ranks():
    rows = np.random.default_rng(0).integers(0, 3, (500, 25)).astype(np.uint64)
    rows[100:200] = rows[:100]
    want = {r: k for k, r in enumerate(sorted({tuple(x) for x in rows.tolist()}))}
    assert suffixes.rank_rows(rows).tolist() == [want[tuple(x)] for x in rows.tolist()]


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_triples_are_in_the_order_of_the_bytes_that_strings_share():
    rng = np.random.default_rng(2)
    buf = np.concatenate([rng.integers(0, 256, 3000).astype(np.uint8), np.zeros(24, np.uint8)])
    places = np.arange(2900)
    for gram in (5, 16, 32):
        keys = np.column_stack(suffixes._triple(buf, places, gram))
        want = sorted(places.tolist(), key=lambda p: (bytes(buf[p : p + min(gram, 24)]), p))
        assert np.lexsort((places, *keys.T[::-1])).tolist() == want

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelcast.llm import ppm


def brute_trie(texts, order):
    trie = defaultdict(Counter)
    for t in texts:
        seq = [0] * order + list(t) + [256]
        for p in range(order, len(seq)):
            for k in range(order + 1):
                trie[tuple(seq[p - k : p])][seq[p]] += 1
    return trie


def brute_log10(trie, text, order):
    seq, total = [0] * order + list(text) + [256], 0.0
    for p in range(order, len(seq)):
        excluded = set()
        for k in range(order, -1, -1):
            seen = {s: c for s, c in trie.get(tuple(seq[p - k : p]), {}).items() if s not in excluded}
            if not seen:
                continue
            n, q = sum(seen.values()), len(seen)
            half = 0 if k == 0 and len(trie[()]) == 257 else 0.5
            if seq[p] in seen:
                total += math.log10((seen[seq[p]] - half) / n)
                break
            total += math.log10(half * q / n)
            excluded |= set(seen)
        else:
            total -= math.log10(257 - len(trie.get((), {})))
    return total


def texts():
    rng = random.Random(2)
    words = ["the", "thing", "other", "Ça", "né", "x", "THE", "zebra"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) + rng.choice(["", "\n", "\t!"])) for k in range(60)]
    return docs + [(60, None), (61, ""), (62, "\x00\x01"), (63, "only here \U0001f600"), (64, "word " * 3000), (5, docs[5][1])]


@pytest.mark.parametrize("block", [24 << 20, 500])
def test_scores_match_a_plain_trie(spark, block):
    docs = texts()
    table = spark.createDataFrame([(k, t, 1, "g") for k, t in docs], "doc_id long, text string, block int, gram string")
    rows = ppm.ppm_scores(table, ppm.crc_fold(), block_bytes=block, unit_bytes=2 * block).collect()
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs}
    train = [(t or "").encode() for k, t in docs if not held[k]]
    trie = brute_trie(train, ppm.ORDER)
    count = Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(count.values()), len(count)
    text = dict(docs)
    assert len(rows) == len(docs)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        tokens = [*raw.lower().split(), None]
        assert r.held_out == held[r.doc_id] and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(count[w] > 0 for w in tokens))
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score == pytest.approx(brute_log10(trie, raw, ppm.ORDER), rel=1e-9)


def test_probabilities_of_all_next_symbols_sum_to_one():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 103, 400).astype(np.uint8)
    keys, counts = np.unique(ppm.keys_of(data, np.array([0, 150, 400]))[0], return_counts=True)
    low = ppm.shared_levels(keys, counts, ppm.ORDER)
    for ctx in (b"aabca", b"zzzab", b"zzzza", b"zzzzz", bytes(5)):
        c = int.from_bytes(ctx, "big")
        pair = (keys // 512) & 0xFFFFFF == c & 0xFFFFFF
        trie = ppm.Trie(keys[pair], counts[pair], low)
        p = 10 ** trie.log10(c * 512 + np.arange(257, dtype=np.int64))
        assert p.sum() == pytest.approx(1)


def test_nothing_to_learn_from_and_empty_table(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(1, "ab"), (None, None)], "doc_id long, text string")
    got = sorted(r.score for r in ppm.ppm_scores(table, F.lit(True)).collect())
    assert got == pytest.approx([-3 * math.log10(257), -math.log10(257)])
    assert ppm.ppm_scores(table.limit(0), F.lit(False)).count() == 0


def test_packed_lists_come_back():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1000):
        keys = np.unique(np.concatenate([rng.integers(0, 1 << 49, n), [ppm.END_WORD][:n], rng.integers(-(1 << 63), 0, n)]))
        assert np.array_equal(ppm.unpacked(ppm.packed(keys), len(keys)), keys)


def test_tally_adds_up_whatever_its_parts_are():
    rng = np.random.default_rng(3)
    tally, want = ppm.Tally(wait=50), Counter()
    for _ in range(40):
        keys, counts = np.unique(rng.integers(0, 300, rng.integers(0, 60)), return_counts=True)
        tally.add(keys, counts)
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    keys, counts = tally.merge()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()


def test_lookup_table():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 41, 5000))
    asked = np.random.default_rng(1).choice(keys, 20000)
    assert np.array_equal(keys[ppm.Lookup(keys).rows(asked)], asked)

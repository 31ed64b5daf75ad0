import hashlib
import random

import numpy as np
import pytest

from panelcast.llm import fingerprints as fp
from panelcast.llm.common import RollingHash


def brute_features(raw, rarity):
    data = np.frombuffer(raw, np.uint8)
    if not raw:
        return np.zeros(0, np.uint64)
    if len(raw) < fp.WINDOW:
        return RollingHash(data).of(np.array([0]), np.array([len(raw)]))
    score = [sum(int(rarity[raw[i] * 256 + raw[i + 1]]) for i in range(s, s + fp.WINDOW - 1)) for s in range(len(raw) - fp.WINDOW + 1)]
    chosen = [s for s in range(len(score)) if score[s] == max(score[max(0, s - fp.REACH) : s + fp.REACH + 1])]
    return RollingHash(data).of(np.array(chosen), np.array(chosen) + fp.WINDOW)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghiélñ") for _ in range(rng.randint(2, 9)))
    docs = [" ".join(word() for _ in range(rng.choice([3, 40, 200, 900]))) for _ in range(30)]
    docs += ["", None, "short", "x", "ab " * 400, docs[0], docs[0], "😀😀😀😀é"]
    return [(k * 3, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("range_bytes", [16 << 20, 4000, 300])
def test_against_brute_force(spark, range_bytes):
    docs = corpus()
    table = spark.createDataFrame([(k, t, "c", True) for k, t in docs], "doc_id long, text string, part string, head boolean").repartition(3)
    rarity = fp.rarity_table(fp.pair_counts(table))
    got = {r.doc_id: r for r in fp.fingerprints(table, range_bytes).collect()}
    assert len(got) == len(docs)
    digest = {}
    for n, (k, t) in enumerate(docs):
        text, following = t or "", docs[(n + 1) % len(docs)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = got[k]
        a, b, c = (fp._filters(brute_features(x.encode(), rarity)) for x in (text, edited, following))
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == a.tobytes().hex() and r.edited_fingerprint == b.tobytes().hex()
        assert r.near_edited == pytest.approx(fp.likeness(a, b)) and r.near_next == pytest.approx(fp.likeness(a, c))
        assert digest.setdefault(text, r.fingerprint) == r.fingerprint
        if len(text) > 400 and text != following:
            assert r.near_edited > 0.5 and r.near_next < 0.2


def test_pair_counts(spark):
    table = spark.createDataFrame([("abab",), (None,), ("",), ("a",), ("ba",)], "text string")
    counts = fp.pair_counts(table)
    assert counts.sum() == 4 and counts[97, 98] == 2 and counts[98, 97] == 2


def test_repeated_ids_null_ids_and_empty_table(spark):
    table = spark.createDataFrame([(None, "a" * 50), (1, "same text " * 9), (1, "same text " * 9), (1, "other text " * 9), (None, "b")], "doc_id long, text string")
    rows = fp.fingerprints(table).collect()
    assert len(rows) == 5 and all(0 <= r.near_next <= 1 for r in rows)
    assert fp.fingerprints(table.limit(0)).count() == 0
    one = fp.fingerprints(table.limit(1)).first()
    assert one.near_next == 1.0


def test_likeness_bounds():
    rng = np.random.default_rng(0)
    a, b = (fp._filters(rng.integers(0, 1 << 63, 900).astype(np.uint64)) for _ in range(2))
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) < 0.1 and fp.likeness(a, b) == fp.likeness(b, a)
    assert fp.likeness(a[:0], a) == 0 and fp.likeness(a[:0], a[:0]) == 1

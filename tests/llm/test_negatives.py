import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm.negatives import Columns, _dump, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=10, positives=5, negatives=5):
    ok = []
    for vec_id, vec, label in rows:
        if label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            ok.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vec], label))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1], strict=False))
    by = lambda t: (-t[0], t[1] is None, t[1] or 0)
    for i, a in enumerate(ok):
        if a[0] is None or a[0] % every:
            continue
        pos = sorted(((score(a, b), b[0]) for j, b in enumerate(ok) if j != i and b[2] == a[2]), key=by)[:positives]
        neg = sorted(((score(a, b), b[0]) for b in ok if b[2] != a[2]), key=by)
        for ps, pid in pos:
            inside = [(s, n) for s, n in neg if 80 * ps <= 100 * s <= 100 * ps][:negatives]
            out += [(a[0], pid, k + 1, n, ps, s) for k, (s, n) in enumerate(inside)]
    return sorted(out, key=str)


def got(df, every=10, **kw):
    return sorted((tuple(r) for r in hard_negatives(df, F.col("vec_id") % every == 0, **kw).collect()), key=str)


def table(n, dims, seed, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    return [(k, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize(("dims", "blocks"), [(24, 1 << 20), (24, 5000), (3, 700)])
def test_equals_a_plain_scan(spark, dims, blocks):
    rows = table(300, dims, dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df, block_bytes=blocks, group_bytes=1000) == plain(rows)


def test_ties_repeats_and_hot_vectors(spark):
    rows = table(80, 6, 1) + [(1000 + k, [0.5] * 6, k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(df, block_bytes=800) == plain(rows)
    twice = spark.createDataFrame([(10, [1.0], 0), (10, [1.0], 0), (11, [1.0], 1)], SCHEMA)
    assert got(twice) == [(10, 10, 1, 11, 65536, 65536)] * 2


def test_rows_that_take_no_part(spark):
    good = table(60, 4, 2)
    bad = [(500, None, 1), (510, [1.0, None, 0.0, 0.0], 1), (520, [float("nan")] * 4, 1), (530, [float("inf"), 0.0, 0.0, 0.0], 1), (540, [1.0] * 4, None), (None, [0.4, 0.4, 0.1, 0.2], 0), (550, [], 1), (560, [0.3, 0.2], 2)]
    df = spark.createDataFrame([(*r, "x") for r in good + bad], f"{SCHEMA}, block string")
    assert got(df) == plain(good + bad)


def test_empty_and_lonely(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, [1.0], 1), (1, [-1.0], 1), (2, [1.0], 2)], SCHEMA)) == []


def test_bounds_leave_out_candidates_but_no_result():
    rng = np.random.default_rng(3)
    cols = rng.integers(-100, 100, (32, 4000), dtype=np.int32)
    cols[:, :40] = 90
    block = Columns(_dump(cols=cols, ids=np.arange(4000), null=np.zeros(4000, bool), label=np.zeros(4000, np.int64), anchor=np.zeros(4000, bool)))
    q = rng.integers(-100, 100, 32)
    exact = q @ cols.astype(np.int64)
    seen = []
    whole = Columns._may_count

    def spy(lower, upper, windows, k):
        keep = whole(lower, upper, windows, k)
        assert (upper >= lower).all()
        seen.append(keep.mean())
        return keep

    Columns._may_count = staticmethod(spy)
    try:
        for lo, hi in ((None, None), (int(np.sort(exact)[-50]), int(np.sort(exact)[-20]))):
            (rows, scores), = block.bond(q, np.ones(4000, bool), [(lo, hi)], 5)
            inside = [i for i in np.lexsort((np.arange(4000), -exact)) if lo is None or lo <= exact[i] <= hi][:5]
            assert rows.tolist() == inside and (scores == exact[rows]).all()
    finally:
        Columns._may_count = staticmethod(whole)
    assert min(seen) < 0.5

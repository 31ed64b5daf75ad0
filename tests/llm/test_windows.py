import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import windows
from panelcast.llm.windows import dedup_windows

SCHEMA = "doc_id long, text string"


def plain(rows, window):
    """Every window in a dictionary, documents in order of id."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone[i : i + window] = [True] * window
            seen.add(g)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(n, seed, vocabulary=40):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}é"
    passages = [[word() for _ in range(rng.choice((6, 9, 14, 40, 90)))] for _ in range(8)]
    rows = []
    for k in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(30))]
        rows.append((k * 3 - n, rng.choice((" ", "\n", " \t ")).join(w)))
    return rows


@pytest.mark.parametrize("window", [2, 7, 13, 20])
def test_equals_a_plain_scan(spark, window):
    rows = corpus(80, window)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(dedup_windows(df, window)) == plain(rows, window)


def test_many_blocks_and_units_give_the_same(spark):
    rows = corpus(120, 5, 15)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(dedup_windows(df, 20, block_bytes=1500, unit_bytes=2500)) == plain(rows, 20)


def test_null_empty_long_and_clashing_columns(spark):
    long = " ".join(f"x{k % 977}" for k in range(60_000))
    rows = [(None, "a " * 50), (3, None), (4, ""), (5, " \n "), (6, "one two"), (7, long), (None, None), (-2, "b " * 19), (1, "a " * 30)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], f"{SCHEMA}, block string, n_words int")
    assert got(dedup_windows(df)) == plain(rows, 20)


def test_repeated_rows_and_ids(spark):
    one = " ".join(f"p{k}" for k in range(45))
    other = one + " and more"
    df = spark.createDataFrame([(1, one)] * 6 + [(2, other)], SCHEMA)
    out = got(dedup_windows(df, block_bytes=300))
    assert sorted(r[2] for r in out if r[0] == 1) == [0, 45, 45, 45, 45, 45]
    assert [r[2] for r in out if r[0] == 2] == [45]
    same_id = got(dedup_windows(spark.createDataFrame([(9, one), (9, other), (None, one)], SCHEMA)))
    assert sorted(r[2] for r in same_id if r[0] == 9) in ([0, 45], [0, 45]) and [r[2] for r in same_id if r[0] is None] == [45]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedup_windows(df).count() == 0 and dedup_windows(df).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_levels_double_up_to_the_window():
    assert windows.levels(20) == [5, 10, 20] and windows.levels(13) == [7, 13] and windows.levels(4) == [4]
    assert all(b <= 2 * a for n in range(2, 300) for a, b in zip(windows.levels(n), windows.levels(n)[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60), st.integers(0, 63))
def test_packed_numbers_round_trip(values, shift):
    x = np.unique(np.array(values, dtype=np.uint64) >> np.uint64(shift))
    assert (windows.unpack_deltas(windows.pack_deltas(x)) == x).all()
    if len(x):
        assert (windows.unpack_keys(windows.pack_keys(x[::-1])) == x[::-1]).all()


def test_texts_are_shuffled_once(spark):
    plan = dedup_windows(spark.createDataFrame(corpus(20, 1), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan

import hashlib
import random
import zlib

import pytest

from panelcast.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rem(c, n):
    return c - n * int(c / n)


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - rem(c, 5), [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append((c, d == len(seq)))
    children, leaves, saved = ({k: 0 for k in nodes} for _ in range(3))
    for k, members in nodes.items():
        if k:
            children[k[:-1]] += 1
    for k, members in nodes.items():
        mine = (len(members) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += mine
    low = {k: min(c for c, _ in m) for k, m in nodes.items()}
    sha = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest()
    return sorted(((low[k], len(k), low[k[:-1]] if k else None, len(m), children[k], leaves[k], saved[k], sha(m)) for k, m in nodes.items()), key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in conversation_trie(df, **kw).collect()), key=str)


def dialogues(n, seed, longest=12, words=2):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-n, 2 * n), n):
        start = rng.choice((0, 0, 3))
        rows += [(c, start + k, ("user", "assistant")[k % 2], "x" * rng.randrange(words)) for k in range(rng.randrange(1, longest))]
    return rows


@pytest.mark.parametrize("height", [2, 3, 16])
def test_equals_a_dictionary_of_prefixes(spark, height):
    rows = dialogues(90, height)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3), height=height) == plain(rows)


def test_deep_conversations_in_several_rounds(spark):
    rows = [(c, k, "user", f"{k if c < 3 or k < 40 else (k, c)}") for c in range(5) for k in range(70 + 30 * c)]
    random.Random(1).shuffle(rows)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(6), height=3) == plain(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, 0, "user", "gone"), (10, None, None, "a"), (10, 0, "user", None), (11, 0, "user", "b"), (11, 0, "assistant", "b"), (11, 0, "user", "a"), (12, 3, "user", "é" * 3), (12, 3, "user", "é" * 3), (13, 2, "u", "long " * 30_000)]
    rows += [(14, k, "r" * 40 + str(k % 2), "t") for k in (1, 1, 2)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], f"{SCHEMA}, depth int, n_convs double")
    assert got(df) == plain(rows)


def test_turnless_and_absent_bases(spark):
    # conversations shorter than what they share with a base that is absent have no turns
    rows = [(c, 0, "user", "hi") for c in (1, 2, 3, 4, 6, 7, 8)]
    want = plain(rows)
    assert any(r[1] == 0 and r[4] < 7 for r in want)
    assert got(spark.createDataFrame(rows, SCHEMA)) == want


def test_common_first_turn_and_conversation(spark):
    rows = [(c, k, "user", f"same {k}") for c in range(0, 1500, 5) for k in range(9)] + dialogues(60, 8)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []

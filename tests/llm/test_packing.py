import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import packing
from panelcast.llm.queries import op8_best_fit_packing, vocabulary_path

DOCS = "doc_id long, text string, length string, part string"
TEXTS = ["plain words here", "", None, " leading", "two  spaces", "tab\tand \nline", "it's <|endoftext|> x", "é ü ñ ça", "word " * 3000, "12 34,5 !!", "same", "same", "a\n\n b"]


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path()).encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_are_those_of_the_plain_tokenizer_and_sequences_are_whole(spark):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(TEXTS)], DOCS)
    rows = packing.best_fit_packing(docs, vocabulary_path()).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for k, text in enumerate(TEXTS):
        ids = reference_ids(text)
        parts = sorted(by_doc[k], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert parts[0].start == 0 and sum(p.length for p in parts) == len(ids)
        assert all(p.length == 2048 for p in parts[1:])
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start : p.start + p.length], "<u4").tobytes())
    whole(rows, 2048)


@pytest.mark.parametrize("text", ["a" + " " * 1_200_000 + "b", "a" + "\n" * 1_000_000, "x" + " \t" * 600_000 + "b", "a" * 300_000])
def test_very_long_runs_have_the_ids_of_the_plain_tokenizer(text):
    encode = packing.encoder(vocabulary_path())
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_text_of_long_blanks_is_packed(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_200_000 + "b", "x", "y"), (2, "short", "x", "y")], DOCS)
    rows = packing.best_fit_packing(docs, vocabulary_path()).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == len(reference_ids("a" + " " * 1_200_000 + "b"))
    whole(rows, 2048)


def whole(rows, capacity):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=0, max_size=60))
def test_plan_places_every_piece_once(lengths):
    patterns = packing.plan(Counter(lengths), 40)
    placed = Counter()
    for items, n in patterns:
        assert n > 0 and sum(items) <= 40
        for x in items:
            placed[x] += n
    assert placed == Counter(lengths)


def exact(items, cap):
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in {v: i for i, v in enumerate(bins)}.values():
            if bins[b] + items[k] <= cap:
                bins[b] += items[k]
                go(k + 1, bins)
                bins[b] -= items[k]
        bins.append(items[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    rng = random.Random(7)
    for _ in range(60):
        items = sorted((rng.randint(3, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, left = packing.reduce_by_dominance(Counter(items), 20)
        rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + (exact(rest, 20) if rest else 0) == (exact(items, 20) if items else 0)


def test_given_table(spark, data_dir):
    rows = op8_best_fit_packing(spark, data_dir).collect()
    n = whole(rows, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty_and_null(spark, rows):
    out = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary_path()).collect()
    assert [(r.length, r.offset) for r in out] == [(1, 0)] * len(rows)

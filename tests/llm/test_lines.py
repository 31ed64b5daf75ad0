import random
import time

import pytest
from pyspark.sql import functions as F

from panelcast.llm.lines import dedup_lines


def brute(docs):
    """Every two lines that also stand earlier, as stretches of five words or more."""
    first = {}
    for k, t in sorted(set((k, t) for k, t in docs if t is not None), key=lambda x: (x[0] is not None, x)):
        lines = t.split("\n")
        for i in range(len(lines) - 1):
            first.setdefault((lines[i], lines[i + 1]), (k, t, i))
    out = []
    for k, t in docs:
        if t is None:
            out.append((k, None, 0, 0, 0))
            continue
        lines, chunks = t.split("\n"), []
        for i in range(len(lines) - 1):
            if first[lines[i], lines[i + 1]] != (k, t, i):
                if chunks and chunks[-1][1] == i:
                    chunks[-1][1] = i + 1
                else:
                    chunks.append([i, i + 1])
        chunks = [(a, b) for a, b in chunks if sum(len(x.split()) for x in lines[a : b + 1]) >= 5]
        gone = {i for a, b in chunks for i in range(a, b + 1)}
        out.append((k, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone), len(chunks)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    passages = [[f"passage {p} line {k}" for k in range(12)] for p in range(4)]
    docs = []
    for k in range(40):
        own = [f"doc {k} line {j}" for j in range(rng.randrange(0, 8))]
        at = rng.randrange(len(own) + 1)
        docs.append((k, "\n".join(own[:at] + rng.choice(passages) + own[at:])))
    docs += [(50, "\n".join(["same"] * 40)), (51, ""), (52, None), (53, "one line"), (54, "one line"), (55, "\n\n\n"), (56, "\n\n\n"), (57, docs[0][1]), (57, docs[0][1]), (None, docs[1][1])]
    table = spark.createDataFrame([(k, t, 9, "z") for k, t in docs], "doc_id long, text string, n_lines int, key string")
    out = dedup_lines(table)
    assert set(out.columns) == {"doc_id", "text", "n_lines", "key", "n_removed", "n_removed_chunks"}
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, r.n_removed_chunks) for r in out.collect()), key=str)
    assert got == brute(docs)
    assert any(r[3] for r in got)


def removed(spark, texts):
    rows = dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (r.n_removed, r.n_removed_chunks) for r in rows}


def test_an_inserted_line_cuts_a_chunk_at_that_line_alone(spark):
    lines = [f"some line number {k}" for k in range(200)]
    got = removed(spark, ["\n".join(lines), "\n".join([*lines[:90], "new", *lines[90:]]), "\n".join(["x", *lines[3:50], "y"])])
    assert got == {0: (0, 0), 1: (200, 2), 2: (47, 1)}


def test_short_passages_are_found_whole(spark):
    passage = ["two lines of some words", "that many documents share"]
    got = removed(spark, ["\n".join([f"start {k}", *passage, f"end {k}"]) for k in range(50)])
    assert got == {0: (0, 0)} | {k: (2, 1) for k in range(1, 50)}


def test_blank_lines_and_brackets_stay(spark):
    got = removed(spark, [f"first {k}\n\n\nsecond {k}\n  }}\n}}\n\n" for k in range(20)])
    assert set(got.values()) == {(0, 0)}


def test_no_python_in_the_plan_and_empty_table(spark):
    out = dedup_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_chunk_that_most_documents_hold_is_dealt_out(spark):
    rng = random.Random(7)
    hot = [f"everyone has line {k}" for k in range(30)]
    docs = [(k, "\n".join([f"own {k} {j}" for j in range(rng.randrange(3))] + hot + [f"end {k}"])) for k in range(300)]
    docs += [(1000 + k, "\n".join([f"rare {k // 2} line {j}" for j in range(20)])) for k in range(3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, r.n_removed_chunks) for r in dedup_lines(table).collect()), key=str)
    assert got == brute(docs)


def test_long_texts_of_short_lines_take_linear_time(spark):
    lines = [f"l{k}" for k in range(20_000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(["x", *lines])), (3, "\n".join(lines[5000:]))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    began = time.time()
    rows = dedup_lines(table).collect()
    assert time.time() - began < 12
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, r.n_removed_chunks) for r in rows), key=str) == brute(docs)


@pytest.mark.parametrize("ids", [(1, 2, 3), (7, 7, 7), (None, None, None)])
def test_documents_that_share_an_id_are_told_apart(spark, ids):
    header = "\n".join(f"header line {k}" for k in range(40))
    rows = [(i, f"{header}\ntail {k} a\ntail {k} b") for k, i in enumerate(ids)]
    got = sorted(r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [0, 40, 40]


def test_twenty_thousand_null_ids_take_linear_time(spark):
    shared = "\n".join(f"shared {k} line" for k in range(12))
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(shared + "\n"), F.concat_ws("\n", *[F.concat(F.col("id"), F.lit(f" own {k}")) for k in range(4)])).alias("text"))
    began = time.time()
    out = dedup_lines(rows).agg(F.count("*"), F.sum((F.col("n_removed") > 0).cast("int"))).first()
    assert out[0] == 20_000 and out[1] == 19_999 and time.time() - began < 60


def test_a_row_on_a_third_of_all_rows(spark):
    text = "\n".join(f"row {k}" for k in range(30))
    rows = [(5, text)] * 400 + [(k, f"own {k}\nnext {k}") for k in range(100, 900)] + [(6, text + "\nmore")]
    out = {}
    for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect():
        out.setdefault(r.doc_id, set()).add(r.n_removed)
    assert out[5] == {0} and out[6] == {30} and out[100] == {0}

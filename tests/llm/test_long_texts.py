"""One text that is longer than a task's slice, beside short ones and nulls, through every operator on texts."""

import random

import pytest

from panelcast.llm import decontaminate, fingerprints, jaccard, lines, packing, ppm, secrets, suffixes, toxicity
from panelcast.llm.common import SLICE_BYTES
from panelcast.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = [f"w{k}é" for k in range(5000)]
    long = "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(50_000))
    assert len(long.encode()) > SLICE_BYTES
    rows = [(1, long, "a", None), (2, "short one", None, 3), (3, None, "b", None), (4, long[:400], "c", 4), (2, "short one", None, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


def test_every_operator(spark, docs):
    text = docs.filter("doc_id = 1").first().text
    n = docs.count()
    bench = spark.createDataFrame([(7, text[1000:1300])], "item_id long, text string")
    hit = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert hit[1].n_hit >= 30 and not hit[1].contaminated and hit[2].n_hit == 0
    cut = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    assert cut[1].n_removed >= 400 and cut[4].n_removed == cut[4].n_bytes and cut[2].n_removed == 0
    assert lines.dedup_lines(docs).count() == n
    joined = {r.doc_id: r for r in jaccard.jaccard_join(docs).collect()}
    assert joined[1].n_links == 0 and joined[2].class_size == 2
    marks = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert marks[1].near_edited > 0.6 and marks[3].fingerprint == ""
    placed = [r for r in packing.best_fit_packing(docs, vocabulary_path()).collect() if r.doc_id == 1]
    assert sum(r.length for r in placed) > 100_000 and all(r.length == 2048 for r in placed if r.piece)
    scores = {r.doc_id: r for r in ppm.ppm_scores(docs, ppm.crc_fold()).collect()}
    assert scores[1].n_tokens == len(text.split()) + 1 and scores[1].score < 0
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == n
    assert secrets.candidates(docs).count() == 0

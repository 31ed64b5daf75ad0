import corpus_pipeline
from panelcast.llm import decontaminate, packing, toxicity
from panelcast.llm.common import load
from panelcast.llm.queries import vocabulary_path
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as near
from tests.llm.test_lines import brute as lines


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage_against_brute_force_on_its_own_input(spark, data_dir):
    docs = load(spark, data_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    stage = dict(corpus_pipeline.STAGES)

    calm = stage["toxicity"](spark, docs, data_dir)
    model = toxicity.fit(docs, toxicity.grade_labels(load(spark, data_dir, "labels")))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.rejected}
    assert calm.schema == docs.schema
    assert {r.doc_id for r in calm.collect()} == {r.doc_id for r in docs.collect()} - bad
    labels = load(spark, data_dir, "labels").collect()
    assert not {r.doc_id for r in labels if r.toxic == 0} & bad

    pairs = [(r.doc_id, r.text) for r in calm.collect()]
    deduped = stage["line dedup"](spark, calm, data_dir)
    assert deduped.columns == docs.columns
    want = {k: t for k, t, n, gone, _ in lines(pairs) if not (gone and gone == n)}
    assert {r.doc_id: r.text for r in deduped.collect()} == want
    assert all(r.n_chars == len(r.text) for r in deduped.collect())

    pairs = [(r.doc_id, r.text) for r in deduped.collect()]
    alone = stage["n-gram Jaccard join"](spark, deduped, data_dir)
    assert {r.doc_id for r in alone.collect()} == {g for *_, g in near(pairs)}

    pairs = [(r.doc_id, r.text) for r in alone.collect()]
    items = [(r.item_id, r.text) for r in load(spark, data_dir, "benchmark").collect()]
    clean = stage["benchmark decontamination"](spark, alone, data_dir)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in contaminated(pairs, items) if not r[5]}

    packed = stage["best-fit packing"](spark, clean, data_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    assert decontaminate.WINDOW == 13 and packing.CAPACITY == 2048 and vocabulary_path()

    final = corpus_pipeline.run(spark, data_dir)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in final.collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed.collect())


def test_line_dedup_stage_keeps_other_columns_and_needs_no_counts(spark):
    text = "\n".join(f"a line of its own {k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, 7), (2, "first\n" + text, 8), (3, text, 9), (4, None, 1), (5, "", 2)], "doc_id long, text string, n_lines int")
    out = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    want = {k: t for k, t, n, gone, _ in lines([(r.doc_id, r.text) for r in docs.collect()]) if not (gone and gone == n)}
    assert {k: r.text for k, r in out.items()} == want and len(out[2].text) < len(text)
    assert all(out[r.doc_id].n_lines == r.n_lines for r in docs.collect() if r.doc_id in out)

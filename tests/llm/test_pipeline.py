import corpus_pipeline
from geoweave.llm import bpe, common, registry
from geoweave.llm.common import stored


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, sf), "test-stage")
        seen.append([r.doc_id for r in docs.select("doc_id").collect()])
        if i < 4:
            assert docs.columns == columns
    assert set(seen[2]) <= set(seen[1]) <= set(seen[0]) <= ids and len(set(seen[2])) == len(seen[2])
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].count(x) for x in set(seen[3])) <= 2
    assert sorted(seen[4]) == sorted(seen[3])
    assert corpus_pipeline.run(spark, sf).count() == len(seen[4])


def test_stages_on_edge_cases(spark, docs, empty):
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, d, "/root/testdata/sf0.001").columns == d.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.STAGES[1][1](spark, d, "").collect())
    assert kept == [(False, 2), (False, 5), (False, 6), (False, 7), (False, 8), (False, 11), (True, 0)]
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, empty.select(*d.columns), "/root/testdata/sf0.001").count() == 0


def test_one_row_of_each_group_stays(spark):
    """Null ids with different and with equal texts, rows that repeat, one id with two texts, a null id on the longest of a group."""
    words = {c: " ".join(f"{c}{(i * 37) % 101}x{i}" for i in range(40)) for c in "pqrstuv"}
    rows = [(None, words["p"]), (None, words["q"]), (None, words["r"]), (None, words["r"])]
    rows += [(1, words["s"])] * 3 + [(2, words["t"]), (2, words["u"]), (3, words["v"]), (None, words["v"] + "  ")]
    d = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = sorted(words.values())
    exact = stored(corpus_pipeline.distinct(spark, d, ""), "test-stage")
    assert sorted(r.text.strip() for r in exact.collect()) == want
    assert [r.doc_id for r in exact.collect() if r.text.startswith("v")] == [None]
    for docs in (d, exact):
        near = stored(corpus_pipeline.dissimilar(spark, docs, ""), "test-stage")
        assert sorted(r.text.strip() for r in near.collect()) == want
    copies = sorted(r.text.strip() for r in corpus_pipeline.mixed(spark, near, "").collect())
    assert set(copies) == set(want) and max(map(copies.count, want)) <= 2


def test_stages_decide_rows_not_ids(spark):
    """Rows that share ids with other texts, and columns that clash with those of the helpers."""
    rows = [(1, "aa aa b"), (2, "bb bb c"), (2, "aa aa b"), (3, "cc cc d"), (3, "dd dd e"), (None, "ee ee f")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, _row long, _times int, _id long, _nth int, kept boolean, copies int, times int"
    d = spark.createDataFrame([(i, t, "en", "s", len(t), 1, 2, 3, 4, False, 0, 0) for i, t in rows], columns).repartition(2)
    exact = corpus_pipeline.distinct(spark, d, "")
    assert exact.columns == d.columns and sorted(r.text for r in exact.collect()) == sorted({t for _, t in rows})
    assert {(r.doc_id, r._row, r.kept) for r in exact.collect()} == {(1, 1, False), (2, 1, False), (3, 1, False), (None, 1, False)}
    near = corpus_pipeline.dissimilar(spark, d, "")
    assert near.columns == d.columns and sorted(r.text for r in near.collect()) == sorted({t for _, t in rows})
    mixed = corpus_pipeline.mixed(spark, exact, "")
    assert mixed.columns == d.columns and 5 <= mixed.count() <= 10


def test_run_deletes_what_it_has_stored(spark):
    before = len(common._made)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(common._made) == before + 1 and out.count() > 0


def test_registry_names():
    assert sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for n in sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0])) if n.startswith("op")]
    assert len(registry.QUERIES) == 10 and set(registry.ORACLE) <= set(registry.QUERIES)
    assert bpe.default_path().endswith(".json")

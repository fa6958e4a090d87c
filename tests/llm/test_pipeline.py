"""The stages of the pipeline, each against a plain version on its own input."""

import corpus_pipeline
from test_llm_helpers import labels_table, mixed_documents
from turnwise.llm import minhash, pii, substrings


def test_stages(spark, tmp_path):
    docs, sf = mixed_documents(spark), str(tmp_path)
    labels_table(spark).write.parquet(f"{sf}/labels.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, sf).persist()
    assert clean.columns == names
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert gone == {i for i in range(0, 240, 8)}
    single = steps["near_duplicates"](spark, clean, sf).persist()
    want = {i for i, (_, c) in minhash.brute([(r.doc_id, r.text) for r in clean.collect()]).items() if c == i}
    assert single.columns == names and {r.doc_id for r in single.collect()} == want and len(want) < clean.count()
    cut = steps["repeats"](spark, single, sf).persist()
    plain = substrings.brute([(r.doc_id, r.text) for r in single.collect()])
    before = {r.doc_id: r for r in single.collect()}
    assert cut.columns == names and any(n for _, n, _ in plain.values())
    for r in cut.collect():
        assert r.text == (plain[r.doc_id][2].decode() if plain[r.doc_id][1] else before[r.doc_id].text) and r.n_chars == len(r.text or "") and r.source == before[r.doc_id].source
    private = steps["personal_data"](spark, cut, sf).persist()
    assert private.columns == names
    for r, s in zip(private.orderBy("doc_id").collect(), cut.orderBy("doc_id").collect(), strict=True):
        assert r.text == (s.text and pii.redact(s.text, pii.find_spans(s.text)))
    pieces = steps["packing"](spark, private, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in private.collect()}
    assert corpus_pipeline.run(spark, sf).count() == pieces.count()


def test_empty_documents(spark, tmp_path):
    docs, sf = mixed_documents(spark).where("false"), str(tmp_path)
    labels_table(spark).write.parquet(f"{sf}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert not docs.count()


def test_nulls_and_repeated_rows(spark, tmp_path):
    sf = str(tmp_path)
    labels_table(spark).where("false").write.parquet(f"{sf}/labels.parquet")
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", None, 3), (3, "w " * 5000, "en", "a", 10000), (3, "w " * 5000, "en", "a", 10000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'k' as chunk", "'p' as predicted", "'_' as _text", "1 as component_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.count() == 5, name
        assert "chunk" in docs.columns and {r.predicted for r in docs.collect()} == {"p"}
    pieces = corpus_pipeline.pack(spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {None, 1, 2, 3} and sum(r.length for r in pieces if r.doc_id in (1, 2)) == 2
    assert sum(r.length for r in pieces if r.doc_id == 3) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 3)

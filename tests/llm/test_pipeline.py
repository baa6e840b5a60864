import corpus_pipeline
from decisionlake.llm import queries
from tests.llm.conftest import SF, WORD
from tests.llm.test_similarity import gone_lines, near


def test_stages(spark, documents, tmp_path):
    columns, docs = documents.columns, documents
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, docs)
        assert name == "best-fit packing" or docs.columns == columns
    before, after = seen["line dedup"]
    texts = [(r.doc_id, r.text) for r in before.collect()]
    gone = gone_lines(texts)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in texts}
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = seen["n-gram Jaccard join"]
    classes = near([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {d for d, (c, *_) in classes.items() if c == d}
    before, after = seen["personal data"]
    assert after.count() == before.count()
    before, after = seen["best-fit packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert sum(r.length for r in corpus_pipeline.run(spark, SF).collect()) == sum(r.length for r in after.collect())


def test_quality_stage_keeps_words(spark, documents):
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, documents, SF).collect()}
    for r in documents.collect():
        assert r.doc_id not in kept or len(WORD.findall(r.text)) >= 50


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))

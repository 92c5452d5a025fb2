"""The pipeline's stages: columns, decisions, and the result of the whole."""

import corpus_pipeline
from sequora.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and docs.count() <= n
        n = docs.count()
    texts = [r.text for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    last = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert last == {r.doc_id: len(bpe.encode(r.text or "")) for r in docs.collect()}
    assert sorted(last) == sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())


def test_stages_on_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, copies, repeated rows and clashing columns go through all stages; so does an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    columns = docs.columns
    extra = spark.createDataFrame([(None, None), (None, ""), (1, "word " * 9000), (1, "word " * 9000), (2, "x")], "doc_id long, text string")
    for c, kind in docs.dtypes:
        if c not in extra.columns:
            extra = extra.withColumn(c, extra.doc_id.cast(kind))
    rows = docs.unionByName(extra.select(*columns)).selectExpr("*", "1 as maybe", "2 as good", "3 as said")
    for table in (rows, rows.limit(0)):
        held, n = table, table.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, SF).cache()
            assert held.columns == rows.columns and held.count() <= n
            n = held.count()
        assert corpus_pipeline.STAGES[-1][1](spark, held, SF).count() == n

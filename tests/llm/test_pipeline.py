"""The pipeline: every stage on the sf0.001 documents, decisions checked stage by stage."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from structlab.llm.jaccard_join import jaccard_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            assert 0 < out.count() <= before
        if name == "exact":
            assert out.count() == out.select("text").distinct().count() == docs.select("text").distinct().count()
        if name == "near":
            kept = jaccard_components(docs).select("component").distinct().count()
            assert out.count() == kept
            assert jaccard_components(out).filter("row_id <> component").count() == 0
        if name == "mix":
            assert out.select("doc_id").distinct().count() <= docs.count()
        if name == "pack":
            assert out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0
        docs = out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_texts_that_share_an_id(spark, kind):
    """Different texts of one id are no copies: each goes through exact and near by its own text."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(5, x), (5, y), (5, y), (3, x + " end"), (10, y), (9, z), (-2, z + " end"), (None, "no id"), (None, "nor this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    out = corpus_pipeline.exact(spark, docs, "")
    seen = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    # Of the three copies of y the row with the largest id stays ("5" is the largest string).
    y_id = "10" if kind == "long" else "5"
    assert seen(out) == sorted([("5", x), (y_id, y), ("3", x + " end"), ("9", z), ("-2", z + " end"), ("None", "no id"), ("None", "nor this")])
    docs = spark.createDataFrame([(5, x), (5, y), (5, y), *rows[3:4], *rows[5:]], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    out = corpus_pipeline.exact(spark, docs, "")
    assert seen(out) == sorted([("5", x), ("5", y), ("3", x + " end"), ("9", z), ("-2", z + " end"), ("None", "no id"), ("None", "nor this")])
    out = corpus_pipeline.near(spark, out, "")
    assert out.columns == docs.columns
    assert seen(out) == sorted([("5", y), ("3", x + " end"), ("-2", z + " end"), ("None", "no id"), ("None", "nor this")])

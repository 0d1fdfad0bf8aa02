"""The pipeline's stages against what the operators decide, and its odd rows."""

from __future__ import annotations

import pytest

import corpus_pipeline
from lumenvec.llm import decontaminate, near_dup, quality, tree_bpe
from lumenvec.llm.common import table
from lumenvec.llm.tokens import encoder, vocabulary_path


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    model = quality.fit(docs, table(spark, sf, "labels"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    want = [
        lambda d: ids(quality.score(d, model).where("predicted = 1")),
        lambda d: ids(near_dup.near_duplicates(d, 5, 80).where("kept")),
        lambda d: ids(decontaminate.decontaminate(d, table(spark, sf, "benchmark")).where("n_hit = 0")),
        ids,
    ]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want, strict=True):
        before = expected(docs)
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert ids(out) == before and before
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = out
    e = encoder(vocabulary_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(e._whole(texts[r.doc_id] or "")) for r in out.collect())


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(rows) < table(spark, sf, "documents").count() and len({r.doc_id for r in rows}) == len(rows)


@pytest.mark.parametrize("k", range(4))
def test_odd_rows(spark, sf, k):
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, "x" * 50_000, "en", "s", 1), (3, "x" * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf)
    assert out.count() <= len(rows)
    if k < 3:
        assert out.columns == docs.columns
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("k", range(3))
def test_clashing_names(spark, sf, k):
    """Columns with the names that stages use inside change nothing."""
    docs = table(spark, sf, "documents")
    names = ["_hit", "_gone", "_digest", "_text", "_c0", "rep", "set", "segment", "y", "fold", "x"]
    wide = docs.selectExpr("*", *(f"'v' as `{n}`" for n in names))
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, wide, sf)
    assert out.columns == wide.columns
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect())


def test_digests_name_their_columns(spark, sf):
    docs = table(spark, sf, "documents").limit(3)
    assert tree_bpe.digests(tree_bpe.encode_documents(docs, vocabulary_path("word_bpe_49k.json")), "ids").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "leaves", "ids"]

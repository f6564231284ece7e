"""The pipeline against its stages applied plainly, and the registered queries."""

import corpus_pipeline
import pytest
from lexistrata.llm import langid, pii, quality, queries
from tests.llm.test_neardup import plain_keep

D = "/root/testdata/sf0.001"


def test_pipeline_matches_plain(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = docs.collect()
    model = langid.Model(langid.train(docs))
    found = model.rows([r.text for r in rows])
    rows = [r for r, (lang, _, _, familiar) in zip(rows, found, strict=True) if lang != "und" and familiar]
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    rows = [r for r in rows if quality.profile(r.text, quality.Limits(), squeeze)[-1]]
    rows = [rows[i] for i in plain_keep([(r.doc_id, r.text) for r in rows])]

    from lexistrata.llm.tokenstore import tokens

    encode = tokens(queries.tokenizer_path()).encode
    want = sorted((r.doc_id, len(encode(pii.mask(r.text))) // 4 + 1) for r in rows)
    got = corpus_pipeline.run(spark, D).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want
    assert 0 < len(want) < docs.count()


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").selectExpr("*", "1 as n_tokens", "'x' as kept", "2 as row", "3 as p", "4 as q")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, D).columns == docs.columns
        assert stage(spark, docs.filter("doc_id < 0"), D).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, D).count() > 0


def test_oracles_name_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())

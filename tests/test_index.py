"""The token index against the same questions put to the texts."""

import random

import pytest
from lexistrata.operators import index, keyness, search, trend
from lexistrata.schema import corpus_from_documents
from pyspark.sql import functions as F

WORDS = ["la", "de", "De", "ley", "leyes", "año", "x1", "the", "of", "casa", "él"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS[: 2 + k % 10]) for _ in range(rng.randrange(40))) + rng.choice(["", ".", "\nla la la"]) for k in range(200)] + [None, "", "de la " * 3000]
    rows = [(i, t, "en" if i % 3 else "es", f"s{i % 5}", 0) for i, t in enumerate(texts)]
    return corpus_from_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)).cache()


@pytest.fixture(scope="module")
def built(corpus, tmp_path_factory):
    return index.build(corpus, str(tmp_path_factory.mktemp("index")))


def test_postings_hold_every_place(corpus, built):
    want = {(r.id, t, k) for r in corpus.select("id", search.index_tokens(F.col("speech")).alias("tokens")).collect() for k, t in enumerate(r.tokens)}
    got = built.postings.select("token", "id", "tf", F.explode("at").alias("k")).collect()
    assert {(r.id, r["token"], r.k) for r in got} == want and len(got) == len(want)
    assert built.postings.filter(F.size("at") != F.col("tf")).count() == 0


@pytest.mark.parametrize("query", ['"de la"', '"la la"', '"la la la"', 'casa + "de la ley"', 'ley | "of the" | "la de la de"', "nada", '"nada de"'])
def test_queries_match_the_texts(corpus, built, query):
    want = {r.id: r.score for r in search.scores(corpus, query).collect()}
    got = {r.id: r.score for r in built.scores(query).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r.id for r in built.match(query).collect()} == want.keys()


@pytest.mark.parametrize("order", ["relevance", "date_asc", "date_desc", "length_desc", "length_asc"])
def test_pages_match_the_texts(corpus, built, order):
    query, chosen = 'ley | "de la"', corpus.filter("id % 3 > 0")
    for some in (None, chosen):
        assert built.search(corpus, query, 15, 4, order, some).orderBy("id").collect() == search.search(corpus, query, 15, 4, order, some).orderBy("id").collect()
    assert built.id_list(query, order).collect() == search.id_list(corpus, query, order).collect()
    assert built.id_list(query, order, 7).count() == 7


def test_pages_read_no_text_to_rank(corpus, built):
    plan = built.id_list('"de la"', "length_desc")._jdf.queryExecution().executedPlan().toString()
    assert "speech" not in plan and "forward" in plan and "tokens" not in plan.split("ReadSchema")[-1]


def test_trend_and_keyness_match_the_texts(corpus, built):
    for raws in (["la", '"de la"', "ley*", '"la la"'], ["ley*", "cas*"], ["casa"]):
        terms = trend.read_terms(raws)
        order = ["term", "month"]
        assert built.monthly(corpus, terms).orderBy(*order).collect() == trend.monthly(corpus, terms).orderBy(*order).collect()
    ids = corpus.filter("id % 4 = 0").select("id")
    rounded = lambda df: {(r.term, r.freq, r.ref, round(r.g2, 8), r.badge) for r in df.collect()}
    options = {"min_freq": 1, "threshold": 0.1, "stop_words": frozenset()}
    assert rounded(built.keyness(ids, **options)) == rounded(keyness.keyness(corpus, ids, **options)) != set()

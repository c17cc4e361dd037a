"""Search of a batch in one pass: against scores of every chunk, ties, parts, blocks, requests that are too many; no index is written."""

import pytest
from pyspark.sql import functions as F

from stackmill import registry
from stackmill.operators import batchsearch as X
from stackmill.operators import search as S
from stackmill.operators import termindex
from tests.test_termindex import chunks

REQUESTS = [(90, "Part 1"), (91, "doc-7"), (92, "unheard"), (93, ""), (94, "the the of"), (95, None)]
rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def given(spark):
    frame, texts = chunks(spark)
    # the same text again and again: ties beyond the cut
    frame = frame.unionByName(spark.range(1000, 1040).select(F.col("id").alias("chunk_id"), F.lit("the w1 w2 tie").alias("text"), F.lit("of").alias("caption"), F.lit(None).cast("string").alias("section"), F.lit("doc-x").alias("name")))
    return frame.repartition(5).cache(), spark.createDataFrame([*enumerate(texts[:30]), *REQUESTS, (96, "tie")], "query_id long, query string")


@pytest.mark.parametrize("dense, at_once, held", [(256, 256, 200_000), (2, 7, 5), (0, 1, 1)])
def test_all_fields_are_exact(spark, given, tmp_path, monkeypatch, dense, at_once, held):
    for name, value in (("DENSE", dense), ("QUERIES_AT_ONCE", at_once), ("_HELD", held)):
        monkeypatch.setattr(X, name, value)
    frame, asked = given
    got = S.top_k(X.best(X.matched(frame, asked, f"file://{tmp_path}/m", termindex.ANALYSED, keywords=True), 10), 10)
    fields = {"text": S.bm25(frame, asked), "caption": S.bm25(frame, asked, "caption"), "section": S.keyword_field(frame, asked, "section"), "name": S.keyword_field(frame, asked, "name")}
    want = S.best_fields(fields, 10).filter("query_id <> 93")
    assert rows(got) == rows(want)
    assert [r[2] for r in rows(got) if r[0] == 96] == list(range(1000, 1010)) and not [r for r in rows(got) if r[0] in (92, 93, 95)]


def test_parts_have_their_own_frequencies(given):
    frame, asked = given
    strict, broad = S.best_text(frame, asked, 3, (F.col("chunk_id") % 3 == 0, None))
    assert rows(strict) == rows(S.top_k(S.bm25(frame.filter("chunk_id % 3 = 0"), asked), 3))
    assert rows(broad) == rows(S.top_k(S.bm25(frame, asked), 3))


def test_too_many_requests_are_searched_all_the_same(given, monkeypatch):
    frame, asked = given
    want = rows(S.best_text(frame, asked, 3)[0])
    monkeypatch.setattr(X, "MOST_ASKED", 3)
    assert X.matched(frame, asked, "file:///not/written", {"text": 1.0}) is None
    assert rows(S.best_text(frame, asked, 3)[0]) == want


def test_no_requests(spark, given):
    assert S.best_text(given[0], spark.createDataFrame([(1, "")], "query_id long, query string"), 3)[0].collect() == []


@pytest.mark.parametrize("name", ["h02_bm25", "h11_merge_batch", "h12_duplicates", "h07_relaxation", "x2_relaxed_batch", "h06_retrieve_once", "e13_result_listing", "g03_rerank", "g03_rarity_rerank"])
def test_no_postings_are_written_or_shuffled(spark, sf_dir, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("postings of all chunks")

    monkeypatch.setattr(termindex, "write", refuse)
    monkeypatch.setattr(S, "bm25", refuse)
    monkeypatch.setattr(S, "_STORED", {})
    cut, chunk = [], S.chunk
    monkeypatch.setattr(S, "chunk", lambda docs: cut.append(docs) or chunk(docs))
    assert registry.queries()[name](spark, sf_dir).count()
    # the whole table is cut once; what is loaded afterwards, from documents with hits only
    assert all("Join" in d._jdf.queryExecution().analyzed().toString() for d in cut[1:])


@pytest.mark.parametrize("at_once", [256, 3])
def test_vectors_are_exact(spark, monkeypatch, at_once):
    import random

    rng = random.Random(3)
    monkeypatch.setattr(X, "QUERIES_AT_ONCE", at_once)
    odd = [None, [], [0.0] * 8, [1.0] * 5, [1.0, None] + [2.0] * 6, [1.0] * 8, [1.0] * 8, [2.0] * 8, [-1.0] * 8]
    made = [*odd, *([rng.gauss(0, 1) for _ in range(8)] for _ in range(300)), *([1.0] * 8 for _ in range(20))]
    vectors = spark.createDataFrame(list(enumerate(made)), "chunk_id long, embedding array<float>").repartition(6)
    asked = spark.createDataFrame(list(enumerate(made[:14])), "query_id long, vector array<float>")
    assert rows(S.top_k(X.nearest(vectors, asked, 10, 100), 10)) == rows(S.vector_top_k(vectors, asked, 10))
    assert X.nearest(vectors, asked, 10, 5) is None and X.nearest(vectors, asked.limit(0), 10, 5).collect() == []


@pytest.mark.parametrize("name", ["h04_rrf", "h05_hybrid", "h08_load_ranked"])
def test_pairs_of_vectors_are_not_rows(spark, sf_dir, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(S, "vector_top_k", refuse)
    monkeypatch.setattr(termindex, "write", refuse)
    monkeypatch.setattr(S, "_STORED", {})
    assert registry.queries()[name](spark, sf_dir).count()

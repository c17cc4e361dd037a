"""The stored index: search over it against scores of every chunk, keyword fields, buckets that are read."""

import random

import pytest

from stackmill.operators import search as S
from stackmill.operators import termindex as X

SCHEMA = "chunk_id long, text string, caption string, section string, name string"


def chunks(spark, n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a"] * 3 + [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4)])
    text = lambda k: " ".join(word() for _ in range(rng.randrange(k)))
    rows = [(i, text(60), text(6), rng.choice([None, "", "Part 1", "Part 2"]), f"doc-{i // 4}") for i in range(n)]
    return spark.createDataFrame([*rows, (n, "", "", None, None)], SCHEMA), [r[1] for r in rows if r[1]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    frame, texts = chunks(spark)
    return X.write(frame, f"file://{tmp_path_factory.mktemp('index')}", buckets=32), frame, texts


@pytest.mark.parametrize("probe", [5_000, 20])
def test_search_is_exact(spark, index, tmp_path, monkeypatch, probe):
    monkeypatch.setattr(X, "PROBE", probe)
    stored, frame, texts = index
    asked = spark.createDataFrame([*enumerate(texts[:30]), (90, "Part 1"), (91, "doc-7"), (92, "unheard"), (93, ""), (94, "the the of")], "query_id long, query string")
    got = S.top_k(X.search(stored, asked, 10, f"file://{tmp_path}"), 10)
    fields = {"text": S.bm25(frame, asked), "caption": S.bm25(frame, asked, "caption"), "section": S.keyword_field(frame, asked, "section"), "name": S.keyword_field(frame, asked, "name")}
    want = S.best_fields(fields, 10).filter("query_id <> 93")  # an empty request has no hits, not those with empty fields
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())
    assert {r[0] for r in rows(got)} == {r[0] for r in rows(want)}
    assert rows(got) == rows(want)
    assert {r[3] for r in rows(got) if r[0] == 90} >= {X.KEYWORD["section"]} and not [r for r in rows(got) if r[0] in (92, 93)]


def test_positions(spark, index):
    found = index[0].postings.filter("field = 'text' and term = 'the' and chunk_id = 3").select("tf", "positions").first()
    text = index[1].filter("chunk_id = 3").first()["text"].split()
    places = [k for k, w in enumerate(text) if w == "the"]
    assert (found is None and not places) or (found["tf"], found["positions"]) == (len(places), places)


def test_reads_only_asked_buckets(spark, index):
    stored = index[0]
    asked = X.asked_terms(stored, spark.createDataFrame([(1, "the of")], "query_id long, query string"), X.ANALYSED)
    opened = X.opened(stored, asked)
    assert 0 < len({f.split("bucket=")[1].split("/")[0] for f in opened.inputFiles()}) <= 32
    assert "PartitionFilters: [bucket" in opened._jdf.queryExecution().toString()


def test_changed_table_is_indexed_again(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    for text in ("one two", "three four five"):
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(path)
        terms = {r["term"] for r in S.stored_index(spark, str(tmp_path)).terms.filter("field = 'text'").collect()}
        assert terms == set(text.split())

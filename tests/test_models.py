"""Injected models: one load a worker, batches, order of ties, odd texts and scores."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from stackmill.operators import models as M


def test_one_load_a_worker_and_small_batches(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        with open(log, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def encode(texts):
            with open(log, "a") as f:
                f.write(f"batch {len(texts)}\n")
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    texts = spark.range(0, 200, 1, 20).select("id", F.when(F.col("id") % 10 != 0, F.repeat(F.lit("é"), F.col("id").cast("int"))).alias("text"))
    for _ in range(2):
        out = texts.select("id", M.encoded(F.col("text"), f"lengths {log}", load).alias("v")).collect()
        assert {r["id"]: r["v"] for r in out} == {i: [float(i if i % 10 else 0), 1.0] for i in range(200)}
    lines = [line.split() for line in open(log)]
    loads = collections.Counter(pid for kind, pid in lines if kind == "load")
    # forty tasks ran: each worker process has loaded the model once
    assert loads and set(loads.values()) == {1} and len(loads) < 40
    assert max(int(n) for kind, n in lines if kind == "batch") == M.ENCODE_BATCH
    assert texts.limit(0).select(M.encoded(F.col("text"), f"lengths {log}", load)).count() == 0


def test_wrong_number_of_vectors_is_an_error(spark):
    with pytest.raises(Exception, match="gave 0 vectors for 1 texts"):
        spark.createDataFrame([("a",)], "text string").select(M.encoded(F.col("text"), "none", lambda: lambda texts: [])).collect()


def test_order_of_injected_scores(spark):
    scores = {"best": 2.0, "tie": 1.0, "nan": float("nan"), "": -1.0}
    hits = spark.createDataFrame([(1, r, r, t) for r, t in enumerate(["nan", "tie", None, "tie", "best"])], "query_id long, rank int, chunk_id long, text string")
    queries = spark.createDataFrame([(1, "q"), (2, "without hits")], "query_id long, query string")
    out = M.rerank_with(hits, queries, "table", lambda: lambda pairs: [scores[t] for _, t in pairs], 5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == [4, 1, 3, 2, 0] and [r["rank"] for r in out] == [0, 1, 2, 3, 4]


def test_rarer_terms_weigh_more(spark):
    hits = spark.createDataFrame([(1, 0, 10, "common words"), (1, 1, 11, "Rare, rare"), (1, 2, 12, None), (2, 0, 10, "common words")], "query_id long, rank int, chunk_id long, text string")
    asked = spark.createDataFrame([(1, "common", 0.5), (1, "words", 0.5), (1, "rare", 3.0)], "query_id long, term string, idf double")
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in M.rerank_by_rarity(hits, asked).collect()}
    assert got == {(1, 0): (11, 0.75), (1, 1): (10, 0.25), (1, 2): (12, 0.0), (2, 0): (10, 0.0)}

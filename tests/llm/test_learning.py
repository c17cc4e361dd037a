"""The two classifiers: held-out accuracy, and defined results for odd inputs."""

import zlib

from stackmill.llm import pu_quality as P, toxicity as X
from stackmill.llm.common import table

ODD = [None, "", "   ", "x" * 200_000, "you idiot", "you idiot"]


def split(rows, labels, column, n, rest):
    truth = {r["doc_id"]: r[column] for r in labels}
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % n == rest]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == rest) for r in rows)
    return [(truth[r["doc_id"]], r["predicted"]) for r in held if r["doc_id"] in truth]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = P.op2_pu_quality(spark, sf).collect()
    pairs = split(rows, table(spark, sf, "labels").collect(), "quality", 3, 1)
    assert len(pairs) > 80 and sum(a == b for a, b in pairs) / len(pairs) >= 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = X.op7_toxicity(spark, sf).collect()
    pairs = split(rows, table(spark, sf, "labels").collect(), "toxic", 5, 0)
    toxic = [b for a, b in pairs if a]
    assert sum(a == b for a, b in pairs) / len(pairs) >= 0.95 and sum(toxic) / len(toxic) >= 0.8


def test_odd_inputs(spark, docs_of):
    docs = docs_of(ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        assert P.quality_scores(docs, labels).count() == len(ODD)
        assert X.toxicity_scores(docs, labels).count() == len(ODD)
    assert {r["score"] for r in P.quality_scores(docs, none).collect()} == {0.5}
    assert P.quality_scores(docs.limit(0), some).count() == 0 and X.toxicity_scores(docs.limit(0), some).count() == 0


def test_nnpu_prior_and_risk():
    import numpy as np

    rng = np.random.default_rng(0)
    positive = rng.normal(1.5, 1, (800, 2)).astype(np.float32)
    mixed = np.concatenate([rng.normal(1.5, 1, (600, 2)), rng.normal(-1.5, 1, (400, 2))]).astype(np.float32)
    model = P.fit_nnpu(positive, mixed, 0.6)
    good, bad = model.score(rng.normal(1.5, 1, (500, 2)).astype(np.float32)), model.score(rng.normal(-1.5, 1, (500, 2)).astype(np.float32))
    assert (good >= 0.5).mean() > 0.85 and (bad < 0.5).mean() > 0.85
    assert abs(P.estimate_prior(positive, mixed) - 0.6) < 0.05


def test_grammar_scores_clauses():
    g = X.Grammar({"idiot": 2.0, "clown": 1.0, "réeux*": 1.5})
    score = lambda t: sum(g.clause_scores(t.encode())[0])
    assert score("you idiot") > score("idiot") > score("not an idiot") > 0
    assert score("he said you idiot") < score("you idiot") and score("nobody here") == 0
    assert score("Réeuxpa!") == 1.5 and len(g.clause_scores(b"idiot. fine. clown\nidiot")[0]) == 3
    assert score("not. idiot") == score("idiot")  # a modifier acts in its own clause


def test_prior_needs_no_negative_label(spark, docs_of):
    """The prior comes from positives and unlabelled rows: changing or dropping negative labels changes no score."""
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    got = {r["doc_id"]: r["score"] for r in P.quality_scores(docs, labels).collect()}
    assert got == {r["doc_id"]: r["score"] for r in P.quality_scores(docs, labels.filter("quality = 1")).collect()}


def test_clashing_names(spark):
    """Columns of the names that the operators add or use inside are the user's own and change nothing."""
    docs = spark.createDataFrame([(i, f"text {i} of many words", "x", i, "mine") for i in range(8)], "doc_id long, text string, x string, quality int, toxic string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    out = P.quality_scores(docs, labels)
    assert out.columns == [*docs.columns, "score"] and {(r["x"], r["toxic"]) for r in out.collect()} == {("x", "mine")}
    assert X.toxicity_scores(docs, labels).count() == 8

"""Encoders and scorers that the caller brings, run in Arrow batches, and the scorer that is used without one.

A model is given as a name and a function that loads it. A worker process loads a name once and keeps it for all tasks that it
runs, so a model that takes long to load or much memory is paid for by worker, not by task or batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.functions import text as T
from stackmill.operators import answers, layout, termindex
from stackmill.operators import search as S
from stackmill.plans import views

#: Texts that an encoder gets at once, and pairs that a scorer gets at once.
ENCODE_BATCH, SCORE_BATCH = 8, 16

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]
Scorer = Callable[[list[tuple[str, str]]], Sequence[float]]

#: The models of this worker process.
_LOADED: dict[str, Callable] = {}


def model(name: str, load: Callable[[], Callable]) -> Callable:
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def encoded(text: Column, name: str, load: Callable[[], Encoder], batch: int = ENCODE_BATCH) -> Column:
    """G1. The vectors of texts by an injected encoder; a null text is encoded as an empty one. An encoder that gives another
    number of vectors than it got texts is an error."""

    @F.pandas_udf("array<double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model(name, load)
        for series in texts:
            given, out = series.fillna("").tolist(), []
            for at in range(0, len(given), batch):
                part = given[at : at + batch]
                vectors = encode(part)
                if len(vectors) != len(part):
                    raise ValueError(f"{name} gave {len(vectors)} vectors for {len(part)} texts")
                out += [np.asarray(v, np.float64) for v in vectors]
            yield pd.Series(out, dtype=object)

    return run(text)


def scored(query: Column, text: Column, name: str, load: Callable[[], Scorer], batch: int = SCORE_BATCH) -> Column:
    """G3. Scores of pairs by an injected scorer; nulls are scored as empty texts. Another number of scores is an error."""

    @F.pandas_udf("double")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = model(name, load)
        for queries, texts in pairs:
            given, out = list(zip(queries.fillna(""), texts.fillna(""))), []
            for at in range(0, len(given), batch):
                part = given[at : at + batch]
                scores = score(part)
                if len(scores) != len(part):
                    raise ValueError(f"{name} gave {len(scores)} scores for {len(part)} pairs")
                out += [float(s) for s in scores]
            yield pd.Series(out, dtype="float64")

    return run(query, text)


def best_scored(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, score and others -> the k best of each query numbered anew, by score, then the old rank; those without a
    score, or with one that is no number, come last."""
    number = F.when(~F.isnan("score"), F.col("score"))
    return S.first_rows(hits.withColumnRenamed("rank", "old_rank"), Window.partitionBy("query_id").orderBy(number.desc_nulls_last(), "old_rank"), k)


def rerank_with(hits: DataFrame, queries: DataFrame, name: str, load: Callable[[], Scorer], k: int = S.FINAL_K) -> DataFrame:
    """G3. hits: query_id, rank, chunk_id, text. queries: query_id, query. The k best by an injected scorer."""
    pairs = hits.join(S.small(queries.select("query_id", "query")), "query_id")
    return best_scored(pairs.withColumn("score", F.round(scored(F.col("query"), F.col("text"), name, load), 9)), k)


def rerank_by_rarity(hits: DataFrame, asked: DataFrame, k: int = S.FINAL_K) -> DataFrame:
    """G3, without a model. asked: query_id, term, idf, the known terms of each query. A text's score is the share of the idf of the
    query's terms that it has; only hits are cut into terms."""
    total = asked.groupBy("query_id").agg(F.sum("idf").alias("total"))
    terms = hits.select("query_id", "chunk_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    met = terms.join(asked.select("query_id", "term", "idf"), ["query_id", "term"]).groupBy("query_id", "chunk_id").agg(F.sum("idf").alias("had"))
    out = hits.join(met, ["query_id", "chunk_id"], "left").join(total, "query_id", "left")
    return best_scored(out.withColumn("score", F.round(F.coalesce(F.col("had") / F.col("total"), F.lit(0.0)), 9)).drop("had", "total"), k)


# --- queries -----------------------------------------------------------------------------------------------------------


def _terms(text: str) -> list[str]:
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t]


def load_hashed_encoder(dims: int = answers.VECTOR_DIMS) -> Encoder:
    """The default encoder (answers.hashed_vector) as a model to inject."""

    def encode(texts: list[str]) -> list[np.ndarray]:
        slots = [[int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % dims for t in _terms(text)] for text in texts]
        return [np.bincount(np.array(s, np.int64), minlength=dims) for s in slots]

    return encode


def load_overlap_scorer() -> Scorer:
    """Share of a query's terms that a text has, as a model to inject."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        sets = [(set(_terms(q)), set(_terms(t))) for q, t in pairs]
        return [len(q & t) / len(q) if q else 0.0 for q, t in sets]

    return score


def _loaded_hits(spark, sf_dir, m=None) -> DataFrame:
    return S.hit_chunks(spark, sf_dir, S._text_hits(spark, sf_dir, S.RETRIEVE_K, m), S.RETRIEVE_K).select("query_id", "rank", "chunk_id", "text")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def g01_injected_encoder(spark, sf_dir):
    """The vectors of all lines by an encoder in Python."""
    v = views.body_blocks(spark, sf_dir).withColumn("v", encoded(F.col("text"), "hashed-terms", load_hashed_encoder))
    return v.select("doc_id", "block_no", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def g03_injected_scorer(spark, sf_dir):
    """The hits of each request put in order by a scorer in Python."""
    return _ranked(rerank_with(_loaded_hits(spark, sf_dir), views.queries(spark, sf_dir), "term-overlap", load_overlap_scorer))


def g03_rarity_rerank(spark, sf_dir):
    """The hits of each request put in order by the rarity of the terms they share with it."""
    m = S.matched_fields(spark, sf_dir)
    asked = termindex.asked_terms(S.stored_index(spark, sf_dir), views.queries(spark, sf_dir), {"text": 1.0}) if m is None else m.known("text")
    return _ranked(rerank_by_rarity(_loaded_hits(spark, sf_dir, m), asked))


QUERIES = {f.__name__: f for f in (g01_injected_encoder, g03_injected_scorer, g03_rarity_rerank)}

ORACLES = {
    "g01_injected_encoder": answers.ORACLES["g01_hashed_vectors"],
    "g03_injected_scorer": layout.ORACLES["g03_rerank"],
    "g03_rarity_rerank": S._sql(
        "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) - 1 AS rank FROM (SELECT th.query_id, th.rank AS old, th.chunk_id, round(coalesce(had, 0) / total, 9) AS score FROM th LEFT JOIN sc USING (query_id, chunk_id) JOIN tt USING (query_id))) WHERE rank < 3",
        more={
            "th": S._HITS["th"],
            "tk": f"SELECT DISTINCT chunk_id, unnest({S._TERMS.format('text')}) AS term FROM ch",
            "df": "SELECT term, count(*) AS df FROM tk GROUP BY term",
            "aq": f"SELECT DISTINCT query_id, unnest({S._TERMS.format('query')}) AS term FROM v_queries",
            "ai": "SELECT query_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM aq JOIN df USING (term) CROSS JOIN (SELECT count(*) AS n FROM ch)",
            "tt": "SELECT query_id, sum(idf) AS total FROM ai GROUP BY query_id",
            "sc": "SELECT query_id, chunk_id, sum(idf) AS had FROM th JOIN tk USING (chunk_id) JOIN ai USING (query_id, term) GROUP BY ALL",
        },
    ),
}

"""Quality classifier by positive-unlabelled learning.

``text_features`` turns every whole text into a few rates (symbols, digits, capitals, repeated words and lines, word
lengths, ...). ``fit_nnpu`` minimises the non-negative unbiased risk

    pi * R+(positives, +1) + max(0, R(unlabelled, -1) - pi * R(positives, -1))

with the logistic loss over a thermometer coding of the features; positives are trusted documents, the unlabelled set is
web text with no label, and pi is the class prior. Negative labels are never read: the prior is
estimated from positives and unlabelled rows (``estimate_prior``). The fit sees at most FIT_ROWS positives and FIT_ROWS unlabelled rows
(a documented bound, chosen by hash); features and scores cover all rows.

Defined cases: null and empty texts have all-zero features and are scored like any other; without positives every score
is 0.5; repeated ids are scored each and weigh as often in the fit; a null id is never held out; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.llm.common import crc_fold, hashed_sample, table

FIT_ROWS = 20_000
FEATURES = ("symbols", "bars", "marks", "digits", "capitals", "capital_words", "non_ascii", "word_length", "long_words", "distinct", "neighbours", "top_word", "dup_lines", "lines", "stops", "words")
_SYMBOLS, _MARKS, _DIGITS = b"#*$%&<>^~`_=+{}[]\\@", b"!?", b"0123456789"
_UPPER = bytes(range(0x41, 0x5B))
_HIGH = bytes(range(0x80, 0x100))
_CAPITAL = re.compile(rb"(?:^|\s)[A-Z]")
_STOP = re.compile(rb"[a-z\x80-\xff][.!?](?:\s|$)")


def features(data: bytes) -> list[float]:
    """FEATURES of one UTF-8 text."""
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    size, n = len(data), len(words)
    without = lambda drop: size - len(data.translate(None, drop))
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = sum(map(len, words))
    return [
        without(_SYMBOLS) / chars,
        data.count(b"|") / chars,
        without(_MARKS) / chars,
        without(_DIGITS) / chars,
        without(_UPPER) / chars,
        len(_CAPITAL.findall(data)) / n,
        without(_HIGH) / chars,
        chars / n,
        sum(1 for w in counts if len(w) > 20) / len(counts),
        len(counts) / n**0.8,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        len(lines) / n,
        len(_STOP.findall(data)) / n,
        float(np.log1p(n)),
    ]


def _rows(texts: pa.Array) -> list[list[float]]:
    return [features(t.as_buffer().to_pybytes()) if t.is_valid else [0.0] * len(FEATURES) for t in texts]


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, text -> x (array of FEATURES)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_rows(batch.column(0)), pa.list_(pa.float32()))], ["x"])

    return docs.select("text").mapInArrow(run, "x array<float>")


class PUModel:
    """Linear over thermometer codes of the features: for each, whether it exceeds each of a few quantiles."""

    def __init__(self, cuts: list[np.ndarray], weights: np.ndarray, bias: float):
        self.cuts, self.weights, self.bias = cuts, weights, bias

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[:, k, None] > c) for k, c in enumerate(self.cuts)], axis=1).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = self.code(x) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cuts(x: np.ndarray, n: int = 24) -> list[np.ndarray]:
    q = np.r_[np.linspace(0.01, 0.99, n), 0.002, 0.998]
    return [np.unique(np.quantile(x[:, k], q).astype(np.float32)) for k in range(x.shape[1])]


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> PUModel:
    """Full-batch Adam on the non-negative risk. Where the estimated negative part falls below zero, the step instead
    pushes that part back up, as the non-negative estimator prescribes."""
    both = np.concatenate([positive, unlabelled])
    model = PUModel(_cuts(both), np.zeros(0), 0.0)
    p, u = model.code(positive), model.code(unlabelled)
    w, b = np.zeros(p.shape[1]), float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        # with the logistic loss, d loss(z, +1) / dz = sigmoid(z) - 1 and d loss(z, -1) / dz = sigmoid(z)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        if negative >= 0:
            dp, du = prior * (gp - 1 / len(zp)) - prior * gp, gu
        else:
            dp, du = prior * gp, -gu
        grad = np.r_[p.T @ dp + u.T @ du + l2 * w, dp.sum() + du.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return PUModel(model.cuts, w, float(b))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, from positives and unlabelled rows alone. One half of the rows fits a
    plain model of positive against unlabelled, the other half is scored: above any threshold stand at least prior times
    the share of positives that stand there, so the least ratio of the two shares bounds the prior, and meets it where
    hardly a negative is left. The threshold is where that ratio with its sampling error (Hoeffding, 0.9) is least."""
    model = fit_nnpu(positive[::2], unlabelled[::2], 0.5)
    p, u = model.score(positive[1::2]), model.score(unlabelled[1::2])
    if not len(p) or not len(u):
        return 0.5
    at = np.unique(p)
    above = lambda s: 1 - np.searchsorted(np.sort(s), at, side="left") / len(s)
    share_p, share_u = above(p), above(u)
    slack = np.sqrt(np.log(40) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((share_u + slack) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.99))


def _matrix(docs: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Features of the documents with the given ids (at most FIT_ROWS ids, so they may be broadcast)."""
    rows = text_features(docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")).limit(most).toPandas()["x"]
    return np.array(rows.tolist(), np.float32).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, trained: "F.Column", fit_rows: int = FIT_ROWS) -> PUModel | None:
    """trained: condition on doc_id for rows whose labels may be read. None without positives. Only the sampled texts are
    turned into features."""
    known = labels.filter(trained & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if known.filter("quality = 1").isEmpty():
        return None
    positive = _matrix(docs, hashed_sample(known.filter("quality = 1"), "doc_id", fit_rows), 2 * fit_rows)
    unlabelled = _matrix(docs, hashed_sample(docs.select("doc_id").filter(trained), "doc_id", fit_rows), 2 * fit_rows)
    if not len(positive) or not len(unlabelled):
        return None
    return fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, model: PUModel | None, name: str = "score") -> DataFrame:
    """docs with a score column added, in one pass over the texts and without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    columns, where = docs.columns, docs.columns.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent.value is None:
                s = np.full(batch.num_rows, 0.5)
            else:
                s = sent.value.score(np.array(_rows(batch.column(where)), np.float32).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*columns, name])

    return docs.mapInArrow(run, schema)


def in_training(doc_id) -> "F.Column":
    return F.coalesce(crc_fold(doc_id, 3) != 1, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs with the score of every document."""
    return score(docs, fit(docs, labels, in_training(F.col("doc_id"))), name)


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_pu_quality": op2_pu_quality}

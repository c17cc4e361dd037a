"""Toxicity by a weighted finite-state pattern grammar.

Words are classified into symbols: insult (with a weight), threat, target, negation, reported speech. Insult words are
accepted by a learned lexicon of whole words and stems (a stem accepts every word that begins with it); the other classes
are short fixed lists. Small transducers read the symbols of one clause: the insult and threat machines emit weights, the
target, negation and reported-speech machines scale what is emitted while they are in their active state. ``compose``
builds the product machine, so a clause is scored in one pass and an insult counts by the clause it stands in. A document
is summarised by its clause scores (total, best, density, matched clauses) and calibrated by logistic regression.

Learning reads at most FIT_ROWS labelled rows, chosen by hash (a documented bound); half of them (by hash) give the
lexicon, counted as one Spark aggregation over word and stem occurrences by document, the other half the calibration.
Every text is scored whole.

Defined cases: null and empty texts match nothing and get the calibration's base rate; without toxic labels every score
is the base rate; repeated ids are scored each; a null id is never held out; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.llm.common import crc_fold, hashed_sample, table

FIT_ROWS = 40_000
#: Most entries of the lexicon; lengths of stems.
LEXICON, STEMS = 4000, (4, 5, 6, 7)
CACHE = 1_000_000
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
WORDS = {
    THREAT: "kill hurt destroy beat punch shoot stab hang burn töten umbringen schlagen verletzen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself he she him her they them du dich dir ihr euch tu te toi vous usted tú ti vosotros él ella",
    NEGATION: "not no never none isn't aren't wasn't don't nicht kein keine nie jamais pas aucun nunca ningún",
    REPORT: "said says told tells wrote claimed called quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}
#: What ends a clause, when a word ends in it.
ENDS = ".!?;:,"
_STRIP = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»„“”‘’¿¡…"


class Machine:
    """A transducer over symbols: moves maps (state, symbol) to the next state (staying is the default), emit maps
    (state, symbol) to a weight source or a factor."""

    def __init__(self, moves: dict, emits: frozenset = frozenset(), factor: dict | None = None):
        self.moves, self.emits, self.factor = moves, emits, factor or {}


INSULTS = Machine({}, frozenset([INSULT]))
THREATS = Machine({}, frozenset([THREAT]))
#: A target anywhere before makes what follows stronger.
TARGETS = Machine({(0, TARGET): 1}, factor={1: 1.3})
#: A negation weakens the next three words.
NEGATIONS = Machine({(s, y): (3 if y == NEGATION else max(0, s - 1)) for s in range(4) for y in range(6)}, factor={1: 0.5, 2: 0.5, 3: 0.5})
#: Reported speech weakens the rest of its clause.
REPORTS = Machine({(0, REPORT): 1}, factor={1: 0.6})


def compose(*machines: Machine) -> tuple[dict, dict]:
    """Product machine: (state, symbol) -> state, and (state, symbol) -> factor for symbols that some machine emits.
    States are numbered as reached from the start, 0."""
    emits = frozenset().union(*(m.emits for m in machines))
    start = (0,) * len(machines)
    number, todo, moves, factors = {start: 0}, [start], {}, {}
    while todo:
        state = todo.pop()
        for symbol in range(6):
            to = tuple(m.moves.get((s, symbol), s) for m, s in zip(machines, state))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            moves[number[state], symbol] = number[to]
            if symbol in emits:
                f = 1.0
                for m, s in zip(machines, state):
                    f *= m.factor.get(s, 1.0)
                factors[number[state], symbol] = f
    return moves, factors


class Grammar(dict):
    """piece of text between white space -> (symbol, weight, ends a clause), remembered; built from a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.fixed = {w: symbol for symbol, words in WORDS.items() for w in words.split()}
        self.moves, self.factors = compose(INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS)

    def __missing__(self, piece: bytes) -> tuple[int, float, bool]:
        text = piece.decode(errors="replace").lower()
        word = text.strip(_STRIP)
        symbol, weight = OTHER, 0.0
        for unit in units(word):
            if (w := self.lexicon.get(unit)) is not None:
                symbol, weight = INSULT, w
                break
        else:
            if (fixed := self.fixed.get(word)) is not None:
                symbol, weight = fixed, float(fixed == THREAT)
        out = (symbol, weight, text[-1] in ENDS)
        if len(self) >= CACHE:
            self.clear()
        self[piece] = out
        return out

    def clause_scores(self, data: bytes) -> tuple[list[float], int]:
        """Scores of the clauses in which something was matched, and the number of words. A line end also ends a clause."""
        scores, total, insult = [], 0, (INSULT, THREAT)
        for line in data.split(b"\n"):
            codes = list(map(self.__getitem__, line.split()))
            total += len(codes)
            places = [i for i, c in enumerate(codes) if c[0] in insult]
            done = -1
            for at in places:
                if at <= done:
                    continue
                start = at
                while start > 0 and not codes[start - 1][2]:
                    start -= 1
                state, score, i = 0, 0.0, start
                while True:
                    symbol, weight, ends = codes[i]
                    if weight:
                        score += weight * self.factors[state, symbol]
                    state = self.moves[state, symbol]
                    if ends or i + 1 == len(codes):
                        break
                    i += 1
                done = i
                scores.append(score)
        return scores, total

    def summary(self, data: bytes) -> list[float]:
        scores, n = self.clause_scores(data)
        total = sum(scores)
        return [float(np.log1p(max(total, 0))), max(scores, default=0.0), 100 * total / (n + 20), float(np.log1p(len(scores))), float(np.log1p(n)), float(len(scores) > 0)]


SUMMARY = 6


def units(word: str) -> list[str]:
    """What may accept a word: itself, then its stems from the longest."""
    return [word, *(word[:k] + "*" for k in reversed(STEMS) if len(word) > k)]


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """sample: text, toxic. Weighted acceptors: log odds of documents with a unit being toxic, for units seen often enough."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, all_ = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = {w.strip(_STRIP) for w in set((text.as_py() or "").lower().split())}
                found = {u for w in words if w for u in units(w)}
                all_.update(found)
                if label:
                    toxic.update(found)
        keys = list(all_)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([all_[k] for k in keys], pa.int64())], ["unit", "t", "n"])

    totals = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    if not totals["t"] or totals["t"] == totals["n"]:
        return {}
    t_all, rest = totals["t"], totals["n"] - totals["t"]
    least = max(4, int(0.003 * t_all))
    weight = F.log((F.col("t") + 0.3) / (t_all + 1.0)) - F.log((F.col("n") - F.col("t") + 0.3) / (rest + 1.0))
    counts = sample.select("text", "toxic").mapInArrow(counted, "unit string, t long, n long").groupBy("unit").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    top = counts.filter(F.col("t") >= least).withColumn("w", weight).filter("w > 1.0").orderBy(F.desc(F.col("t") * F.col("w")), "unit").limit(LEXICON)
    return {r["unit"]: r["w"] for r in top.collect()}


#: Features of a summary whose weight may not be negative: more matches never make a text less toxic.
RISING = (0, 1, 2, 3, 5)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias last), means and scales; Newton steps with a ridge. Rising features that would get a negative weight
    are left out and the rest is fitted again."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    used = np.ones(a.shape[1], bool)
    while True:
        w = np.zeros(a.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a[:, used] @ w[used], -30, 30)))
            g = a[:, used].T @ (p - y) + l2 * w[used]
            h = (a[:, used] * (p * (1 - p))[:, None]).T @ a[:, used] + (l2 + 1e-6) * np.eye(int(used.sum()))
            move = np.linalg.solve(h, g)
            w[used] -= move
            if np.abs(move).max() < 1e-6:
                break
        wrong = [k for k in RISING if k < x.shape[1] and w[k] < 0]
        if not wrong:
            return w, mean, scale
        used[wrong] = False


def summaries(docs: DataFrame, lexicon: dict[str, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, x (clause summary) and the columns to keep."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(sent.value)
        for batch in batches:
            rows = [grammar.summary(t.as_buffer().to_pybytes()) if t.is_valid else [0.0] * SUMMARY for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), *batch.columns[2:]], ["doc_id", "x", *keep])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, f"doc_id long, x array<double>{kinds}")


def in_training(doc_id) -> "F.Column":
    return F.coalesce(crc_fold(doc_id, 5) != 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, trained: "F.Column", fit_rows: int = FIT_ROWS):
    """(lexicon, calibration), learned from labelled rows for which trained holds."""
    known = labels.filter(trained & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = hashed_sample(known, "doc_id", fit_rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    half = F.xxhash64(F.col("doc_id"), F.lit("half")) % 2 == 0
    lexicon = learn_lexicon(sample.filter(half))
    rows = summaries(sample.filter(~half), lexicon, ("toxic",)).select("x", "toxic").toPandas()
    y = rows["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        base = np.zeros(SUMMARY + 1)
        rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
        base[-1] = np.log(rate / (1 - rate))
        return lexicon, (base, np.zeros(SUMMARY), np.ones(SUMMARY))
    return lexicon, fit_logistic(np.array(rows["x"].tolist()), y)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score for all documents."""
    lexicon, (w, mean, scale) = fit(docs, labels, in_training(F.col("doc_id")))
    out = summaries(docs, lexicon)
    z = F.lit(float(w[-1]))
    for k in range(SUMMARY):
        z = z + (F.col("x")[k] - float(mean[k])) / float(scale[k]) * float(w[k])
    return out.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))).alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}

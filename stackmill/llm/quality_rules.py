"""Quality rules with risk-controlled thresholds, by DataFrame functions only.

``base_counts`` counts words, characters, symbols, repeated lines and repeated 3-word windows of every whole text.
``rule_metrics`` derives the rates that the rules cut. ``learn_cutoffs`` takes a labelled holdout and selects, for every
stratum and rule, the tightest cutoff whose false-rejection rate (good documents over the cutoff) is provably small: the
exact (Clopper-Pearson) upper bound at the error level of the test must stay under ``risk``. Cutoffs of one rule are
tested from the loosest to the tightest, stopping at the first failure (fixed-sequence testing, which needs no further
correction); the error level ``delta`` and the risk are split evenly over the rules, and the error level also over the
strata (Bonferroni), so that with confidence 1 - delta no stratum loses more than ``risk`` of its good documents.
``apply_rules`` rejects a document over any cutoff of its stratum.

Defined cases: null or empty texts have no words and fail the base rule; a null stratum is a stratum of its own; a
stratum without enough labels to prove any cutoff gets none and loses no document to the rules; equal metrics fall on the
same side of a cutoff; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.llm.common import stash, table, words_of

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: Rules (metric names) and the cutoffs tried for each, from the loosest to the tightest.
RULES = ("symbol_rate", "dup_line_rate", "repeat_rate")
GRID = (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)
RISK, DELTA = 0.15, 0.05


def window_hashes(words: Column, n: int = 3) -> Column:
    """A 64-bit hash for each run of n words; equal hashes within one text stand for equal runs."""
    return F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text (and what else is there) -> the same columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rtrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    placed = docs.withColumn("_w", words_of(F.col("text"))).withColumn("_l", lines).withColumn("_h", window_hashes(F.col("_w")))
    placed = placed.withColumn("_s", F.sort_array("_h"))
    # most texts have few windows or none that occur again; only those that do pay for a sort with places
    placed = placed.withColumn("_d", F.filter("_s", lambda h, i: (i > 0) & (h == F.get(F.col("_s"), i - 1))))
    placed = placed.withColumn(
        "_p",
        F.when(F.size("_d") > 0, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda x, j: F.coalesce(F.get(F.col("_p"), j)["h"] == x["h"], F.lit(False))
    placed = placed.withColumn("_q", F.sort_array(F.transform(F.filter("_p", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    covered = F.when(F.col("_q").isNull(), F.lit(0)).otherwise(
        F.aggregate(
            F.transform("_q", lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_q"), j + 1) - p, F.lit(3)))),
            F.lit(0),
            lambda a, x: a + x,
        )
    )
    n = F.size("_w").cast("long")
    counted = placed.select(
        *docs.columns,
        n.alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rule_metrics(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return (
        counts.withColumn("symbol_rate", ratio("n_symbols", "word_chars"))
        .withColumn("dup_line_rate", ratio("n_dup_lines", "n_lines"))
        .withColumn("repeat_rate", ratio("n_repeat_words", "n_words"))
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial, exactly but for rounding: the terms follow from each other and are summed as logarithms."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        high = F.greatest(term, acc["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(term, acc["sum"]) - high))).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.exp(F.aggregate(terms, start, step)["sum"]))


def proven(k: Column, n: Column, risk: float, level: Column) -> Column:
    """Whether the Clopper-Pearson upper bound of k false rejections among n, at error ``level`` (below a half), is at most
    ``risk``. More than n * risk rejections never prove it, so their terms are not summed."""
    return (n > 0) & (k <= n * risk) & (binomial_cdf(F.when(k <= n * risk, k).otherwise(F.lit(0)), n, risk) <= level)


def holdout_counts(holdout: DataFrame, stratum: str) -> DataFrame:
    """stratum, n good documents, and for every rule and cutoff the good documents over it: one row per stratum."""
    over = [F.count_if(F.col(r) > c).alias(f"{r}_{j}") for r in RULES for j, c in enumerate(GRID)]
    return holdout.groupBy(stratum).agg(F.count("*").alias("n"), *over)


def learn_cutoffs(counts: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum and for every rule its cutoff (null: the rule is not used there), from the rows of ``holdout_counts``."""
    counts = stash(counts, "rule-holdout")
    level, share = F.lit(delta / max(1, counts.count() * len(RULES))), risk / len(RULES)

    def cutoff(rule: str) -> Column:
        tightest = F.lit(None).cast("double")
        for j in reversed(range(len(GRID))):  # tested from the loosest, up to the first failure
            tightest = F.when(proven(F.col(f"{rule}_{j}"), F.col("n"), share, level), F.coalesce(tightest, F.lit(GRID[j])))
        return tightest

    return stash(counts.select(stratum, *[cutoff(r).alias(r) for r in RULES]), "rule-cutoffs")


def apply_rules(metrics: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Adds kept: false if base_failed or any metric lies over its cutoff."""
    cut = cutoffs.select(F.col(stratum).alias("_st"), *[F.col(r).alias(f"_cut_{r}") for r in RULES])
    cut = F.broadcast(cut) if cut.limit(MANY_STRATA + 1).count() <= MANY_STRATA else cut
    joined = metrics.join(cut, metrics[stratum].eqNullSafe(cut["_st"]), "left")
    over = [F.coalesce(F.col(r) > F.col(f"_cut_{r}"), F.lit(False)) for r in RULES]
    bad = over[0]
    for x in over[1:]:
        bad = bad | x
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad).drop("_st", *[f"_cut_{r}" for r in RULES])


#: Strata beyond this many are not broadcast: they are joined by a shuffle.
MANY_STRATA = 10_000


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """All documents with counts, metrics and kept. Counts are made once and written; labels are joined to counts, not to texts."""
    counted = stash(base_counts(docs.select("doc_id", "text", stratum)).drop("text"), "rule-counts")
    metrics = rule_metrics(counted)
    good = labels.filter(F.col("quality") == 1).select("doc_id").distinct()
    holdout = metrics.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    return apply_rules(metrics, learn_cutoffs(holdout_counts(holdout, stratum), stratum, risk, delta), stratum)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op4_quality_rules": op4_quality_rules}

"""Mixing sources to target weights by temperature.

The weight of a source is its token share raised to an exponent and normalised: exponent 1 keeps the shares, 0 makes all
sources equal. ``solve_exponent`` bisects the exponent so that the weights reach a target entropy, and raises it as far as
needed to keep every source's repetition (budget x weight over its tokens) under a limit. The weights are realised as
budgeted block permutations: the documents of a source are dealt by hash into blocks of BLOCK_DOCS or more; a source gets as
many full passes over its blocks as its token budget holds, then blocks in permuted order, and of the block in which the
budget ends the documents in hash order that still fit. A source's decision is three numbers (passes, cut block, cut
hash), so documents are decided where they are read, by one small table of sources, and nothing is sorted as a whole.
Each pass has its own permutation of the blocks (``copies_of``).

Defined cases: a null source is a source of its own; null and empty texts have no tokens and follow their source's
passes; a source without any token has weight zero and is left out, but under budget "whole" its documents come once;
equal rows hash alike and are taken or left together within a pass; an empty table gives no rows; ``mix`` gives all columns
back as they were, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackmill.llm.common import stash, table

BLOCK_DOCS, SEED = 1024, 17
#: Sources up to which their table is broadcast, and their tokens are on the driver while the exponent is sought.
MANY_SOURCES = 100_000
#: Target entropy as a place between the natural entropy (0) and that of equal weights (1); most passes over a source.
FLATTEN, MAX_REPEAT = 0.5, 4.0


class Shares:
    """Token shares of the sources: their number, least and greatest, and for an exponent x the sums of share^x and of
    share^x * ln(share). ``sums`` is a function of x."""

    def __init__(self, total: float, least: float, greatest: float, n: int, sums: Callable[[float], tuple[float, float]]):
        self.total, self.least, self.greatest, self.n, self.sums = total, least, greatest, n, sums

    def entropy(self, x: float) -> float:
        z, s = self.sums(x)
        return math.log(z) - x * s / z

    def whole_budget(self, x: float) -> float:
        """The least budget with which every source gets a full pass: the greatest source needs most."""
        return self.total * self.sums(x)[0] * self.greatest ** (1 - x)

    def worst_repeat(self, x: float, budget: float | None) -> float:
        """Passes over the source that is repeated most: the least one."""
        z = self.sums(x)[0]
        spent = self.total * z * self.greatest ** (1 - x) if budget is None else budget
        return spent * self.least ** (x - 1) / (z * self.total)


def shares_of(tokens: Sequence[int]) -> Shares | None:
    """Of token counts; sources without tokens have no share."""
    total = sum(tokens)
    shares = [t / total for t in tokens if t > 0]

    def sums(x: float) -> tuple[float, float]:
        raw = [p**x for p in shares]
        return math.fsum(raw), math.fsum(r * math.log(p) for r, p in zip(raw, shares))

    return Shares(float(total), min(shares), max(shares), len(shares), sums) if shares else None


def shares_in(stats: DataFrame) -> Shares | None:
    """The same of a table (tokens), by aggregates."""
    stats = stats.filter("tokens > 0")
    row = stats.agg(F.sum("tokens").alias("t"), F.min("tokens").alias("a"), F.max("tokens").alias("b"), F.count("*").alias("n")).first()
    if not row["n"]:
        return None
    share = F.col("tokens") / F.lit(float(row["t"]))

    def sums(x: float) -> tuple[float, float]:
        raw = F.pow(share, F.lit(x))
        return tuple(stats.agg(F.sum(raw), F.sum(raw * F.log(share))).first())

    return Shares(float(row["t"]), row["a"] / row["t"], row["b"] / row["t"], row["n"], sums)


def _bisect(holds, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """Smallest exponent at which holds is true; it is false below and true above, and true at high."""
    if holds(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def solve_exponent(shares: Shares | None, budget: float | None, target_entropy: float | None = None, max_repeat: float | None = None) -> float:
    """Entropy falls and the greatest repetition falls as the exponent rises from 0 to 1. budget None: the whole budget. A
    limit that not even exponent 1 meets (a budget over max_repeat times all tokens) gives exponent 1."""
    if shares is None:
        return 1.0
    exponent = 0.0
    if target_entropy is not None:
        exponent = _bisect(lambda x: x >= 1.0 or shares.entropy(x) <= target_entropy)
    if max_repeat is not None:
        exponent = max(exponent, _bisect(lambda x: x >= 1.0 or shares.worst_repeat(x, budget) <= max_repeat))
    return exponent


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place_hash() -> Column:
    """Non-negative hash that deals a document into a block and orders it there."""
    return F.xxhash64(F.col("doc_id"), F.col("source"), F.lit(SEED)).bitwiseAND(F.lit((1 << 63) - 1))


def plan(counted: DataFrame, budget: float | str = "total", flatten: float = FLATTEN, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """counted: source, n_tokens, h for every document. budget: tokens, "total" (as many as there are) or "whole" (every
    source gets a full pass at least, so that no document is lost). One row a source: weight, exponent, target_tokens, passes, blocks,
    cut_block, cut_hash."""
    stats = stash(counted.groupBy("source").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")), "mix-sources")
    few = stats.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES
    shares = shares_of([r["tokens"] for r in stats.filter("tokens > 0").select("tokens").collect()]) if few else shares_in(stats)
    small = F.broadcast if few else lambda df: df
    spent = None if budget == "whole" else (shares.total if shares else 0.0) if budget == "total" else float(budget)
    natural, level = (shares.entropy(1.0), math.log(shares.n)) if shares else (0.0, 0.0)
    exponent = solve_exponent(shares, spent, natural + flatten * (level - natural), max_repeat)
    if spent is None:
        spent = shares.whole_budget(exponent) if shares else 0.0
    total, z = (shares.total, shares.sums(exponent)[0]) if shares else (1.0, 1.0)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    target = F.col("weight") * F.lit(spent)
    if budget == "whole":
        target = F.greatest(target, F.col("tokens").cast("double"))  # but for rounding it is
    sources = stats.withColumn("weight", weight).withColumn("target_tokens", target).withColumn("exponent", F.lit(exponent))
    # a source without a token gets one pass where every document has to stay, else none
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("target_tokens") / F.col("tokens"))).otherwise(1 if budget == "whole" else 0).cast("long")
    # blocks grow with the root of a source, so that neither their number nor what is in one grows with it
    size = F.greatest(F.lit(float(BLOCK_DOCS)), F.ceil(F.sqrt("docs")).cast("double"))
    sources = sources.withColumns({"passes": passes, "blocks": F.ceil(F.col("docs") / size).cast("long")})
    sources = stash(sources.withColumn("rest", F.when(F.col("tokens") > 0, F.col("target_tokens") - F.col("passes") * F.col("tokens")).otherwise(-1.0)), "mix-weights")
    here = lambda df: small(df.select(F.col("source").alias("_s"), *[x for x in df.columns if x != "source"]))
    same = F.col("source").eqNullSafe(F.col("_s"))
    dealt = counted.join(here(sources.select("source", "blocks", "rest")), same).drop("_s").withColumn("block", F.col("h") % F.col("blocks"))
    totals = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    run = totals.withColumn("upto", F.sum("t").over(Window.partitionBy("source").orderBy("block"))).withColumn("before", F.col("upto") - F.col("t"))
    cut = run.filter("upto > rest").groupBy("source").agg(F.min_by(F.struct("block", "before"), "block").alias("c")).select("source", "c.block", "c.before")
    cut = stash(cut, "mix-cuts")  # a row a source
    inside = dealt.join(here(cut.withColumnRenamed("block", "_b")), same & (F.col("block") == F.col("_b"))).drop("_s")
    fits = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h")) + F.col("before") <= F.col("rest")
    last = inside.withColumn("fits", fits).filter("fits").groupBy("source").agg(F.max("h").alias("cut_hash"))
    out = sources.join(here(cut.withColumnRenamed("block", "cut_block")), same, "left").drop("_s", "before")
    out = out.join(here(last), same, "left").drop("_s", "rest", "docs", "tokens")
    # no block over the rest: only rounding can make that so, and then every block fits
    return stash(out.withColumns({"cut_block": F.coalesce("cut_block", "blocks"), "cut_hash": F.coalesce("cut_hash", F.lit(-1))}), "mix-plan")


_ADDED = ("weight", "target_tokens", "mix_block", "n_copies")


def _copies(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """row (the document as it is), doc_id, source and what ``with_copies`` adds."""
    docs = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    p = sources.select(F.col("source").alias("_s"), "weight", "target_tokens", "passes", "blocks", "cut_block", "cut_hash")
    p = F.broadcast(p) if p.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES else p
    joined = docs.join(p, docs["source"].eqNullSafe(p["_s"]), "left").withColumn("h", place_hash()).withColumn("mix_block", F.col("h") % F.col("blocks"))
    more = (F.col("mix_block") < F.col("cut_block")) | ((F.col("mix_block") == F.col("cut_block")) & (F.col("h") <= F.col("cut_hash")))
    more = more & (F.col("weight") > 0)
    return joined.select(
        "row", "doc_id", "source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("target_tokens", F.lit(0.0)).alias("target_tokens"),
        "mix_block", F.coalesce(F.col("passes") + more.cast("long"), F.lit(0).cast("long")).alias("n_copies"),
    )


def _passes(copies: DataFrame) -> DataFrame:
    played = copies.filter("n_copies > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    return played.withColumn("mix_order", F.xxhash64("source", "mix_block", "mix_pass", F.lit(SEED)))


def with_copies(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs (doc_id, source, ...) with weight, target_tokens, mix_block and n_copies, which replace columns of these names;
    documents of left-out sources get 0."""
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in _ADDED]
    return _copies(docs, sources).select(*own, *_ADDED)


def counted_docs(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, h, written to the shared folder: texts are counted once."""
    return stash(docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"), place_hash().alias("h")), "mix-counts")


def copies_of(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each pass over each document, with what ``with_copies`` adds, mix_pass and mix_order (replacing columns of
    these names): sorting by mix_pass, then mix_order plays a source's passes, each in its own permutation of the blocks."""
    added = (*_ADDED, "mix_pass", "mix_order")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    return _passes(_copies(docs, sources)).select(*own, *added)


def mix(docs: DataFrame, budget: float | str = "total", flatten: float = FLATTEN, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """The mixed documents, with all their own columns as they were: a document comes as often as it has copies."""
    copies = _passes(_copies(docs, plan(counted_docs(docs), budget, flatten, max_repeat)))
    return copies.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counted_docs(table(spark, sf_dir, "documents"))
    return copies_of(counted.drop("h"), plan(counted)).select("doc_id", "source", "n_tokens", "weight", "target_tokens", "n_copies", "mix_pass", "mix_block", "mix_order")


QUERIES = {"op8_mixing": op8_mixing}

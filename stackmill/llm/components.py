"""Connected components by DataFrame functions: alternating large-star and small-star steps over an edge list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.llm.common import checkpointed


def _state(edges: DataFrame) -> tuple:
    # order-free fingerprint of the edge set: rows and a sum of hashes (as decimal, so it cannot overflow)
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, fit: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    both = fit(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = fit(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    met = fit(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))
    return fit(met.distinct())


def _small_star(edges: DataFrame, fit: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = fit(down.groupBy("u").agg(F.min("v").alias("m")))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return fit(fit(linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")).distinct())


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, task_rows: int | None = None) -> DataFrame:
    """node, component (the smallest node reachable) for every node that has an edge to another.

    The number of rounds grows with the logarithm of the longest chain; every round is cut by a checkpoint in the shared
    folder. Null ends and loops are ignored; repeated edges count once; an empty edge list gives no rows. With task_rows, a
    round has a task for so many edges, not one for each of the session's shuffle partitions.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = checkpointed(edges)
    before = _state(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        tasks = before[0] // task_rows + 1 if task_rows else None
        fit = lambda df, n=tasks: df.coalesce(n) if n else df
        edges = checkpointed(_small_star(_large_star(fit(edges), fit), fit))
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").unionByName(roots.select(F.col("component").alias("node"), "component").distinct())

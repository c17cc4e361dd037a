"""Conversation prefix trie with totals of subtrees by centroid decomposition.

``turn_places`` numbers the turns of every conversation by a sort that Spark deals out by range, so that one conversation may
hold much of all rows. A node is the sequence of a conversation's first turns; it is known by the exclusive or of two 64-bit
hashes of (place, role, text) over the turns so far, which is built by windows over at most BLOCK turns and the totals of the blocks before.
From then on a node has the name (conv_id, depth), where conv_id is its smallest member.

``subtree_totals`` is the rollup, for any forest of parent edges. Every node has a weight, and what a node's subtree weighs is known from
its members alone (a member weighs one for each node of its conversation from here on), without a rollup. A component of
total weight W has as its centroid the deepest node whose subtree in the component weighs at least W / 2; the nodes of that kind are exactly
the path from the centroid to the top. Taking the centroid out leaves its children's subtrees, each of less than W / 2, and
the rest above it. The totals of the children's components and the centroid's own values, added to every node of that path, are the
balanced rollup: each pair of a node and an ancestor is counted at the one level at which they part. Components of
more than IN_TASK nodes are split by joins, one level after another, each level a written table; smaller ones are dealt out whole and
are split to the end within a task, all components of a task at once.

Defined cases: null roles and texts are empty; rows with a null conv_id belong to no conversation and are ignored; turns come
in order of turn (null first), then role, then text; repeated rows are repeated turns; conversations without turns end at the
root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackmill.llm.common import partitions_for, stash, table

#: Conversations that share what their first conversation starts with, and how many first turns at most, less one.
FAMILY, HEADS = 100, 6
#: Turns of a window; nodes of a component that is split within a task, and of a task.
BLOCK, IN_TASK, TASK_ROWS = 4096, 100_000, 400_000
_NODE = ["conv_id", "depth"]


def turn_places(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), c0, c1 (hashes of role and text), size (code points of the text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    # numbered as read, so that equal rows are no single key of the range
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_row"]
    n = partitions_for(rows.sparkSession, 0, 1)
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", F.xxhash64(F.lit(1), "role", "text").alias("c0"), F.xxhash64("role", F.lit(2), "text").alias("c1"), F.length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("at"))
    dealt = stash(dealt, "turns").withColumn("part", F.shiftright("at", 33))
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("k"))
    # bounded: in a sort, only a part's first and last conversation also stand in another part
    several = parts.join(parts.groupBy("conv_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("conv_id"), "conv_id")
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = several.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("_off"))
    placed = dealt.withColumn("_pos", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at")))
    placed = placed.join(F.broadcast(offsets), (F.col("conv_id") == F.col("_c")) & (F.col("part") == F.col("_p")), "left")
    return stash(placed.select("conv_id", (F.col("_pos") + F.coalesce("_off", F.lit(0))).alias("pos"), "c0", "c1", "size"), "turn-places")


def rebuilt(places: DataFrame) -> DataFrame:
    """conv_id, depth, last (the conversation's number of turns), c0, c1, size: the turns of every rebuilt conversation, and
    a row of depth 0 for each."""
    own = places.groupBy("conv_id").agg(F.max("pos").alias("_len"))
    heads = places.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("_base"), F.col("pos").alias("depth"), "c0", "c1", "size")
    many = heads.groupBy(F.col("_base").alias("_b")).agg(F.max("depth").alias("_has"))
    take = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    plan = own.withColumn("_take", take).withColumn("_first", F.col("conv_id") - F.col("conv_id") % FAMILY)
    plan = plan.join(many, plan["_first"] == many["_b"], "left").withColumn("_had", F.least("_take", F.coalesce("_has", F.lit(0))))
    plan = stash(plan.select("conv_id", "_take", "_first", "_had", (F.col("_had") + F.greatest(F.col("_len") - F.col("_take"), F.lit(0))).alias("last")), "turn-plan")
    root = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), "last", *[F.lit(0).cast("long").alias(c) for c in ("c0", "c1", "size")])
    given = plan.join(heads, (plan["_first"] == heads["_base"]) & (heads["depth"] <= plan["_had"])).select("conv_id", F.col("depth").cast("long").alias("depth"), "last", "c0", "c1", "size")
    kept = places.join(plan.withColumnRenamed("conv_id", "_c"), (F.col("conv_id") == F.col("_c")) & (F.col("pos") > F.col("_take")))
    kept = kept.select("conv_id", (F.col("pos") - F.col("_take") + F.col("_had")).cast("long").alias("depth"), "last", "c0", "c1", "size")
    return root.unionByName(given).unionByName(kept)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, last, size, x0, x1 (of the node) and p0, p1 (of its parent) of every turn of every conversation."""
    turns = stash(turns.withColumn("_block", F.floor(F.col("depth") / BLOCK)).select("*", *[F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64("depth", f"c{k}")).alias(f"g{k}") for k in (0, 1)]), "rebuilt")
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.filter(F.col("last") >= BLOCK).groupBy("conv_id", "_block").agg(*[F.bit_xor(f"g{k}").alias(f"g{k}") for k in (0, 1)])
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), *[F.coalesce(F.bit_xor(f"g{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (0, 1)])
    within = Window.partitionBy("conv_id", "_block").orderBy("depth")
    summed = turns.select("*", *[F.bit_xor(f"g{k}").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias(f"s{k}") for k in (0, 1)])
    joined = summed.join(blocks, (F.col("conv_id") == F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    x = {k: F.col(f"s{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in (0, 1)}
    return stash(joined.select("conv_id", "depth", "last", "size", *[x[k].alias(f"x{k}") for k in x], *[x[k].bitwiseXOR(F.col(f"g{k}")).alias(f"p{k}") for k in x]), "prefixes")


def nodes_of(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, size, weight (of the subtree); and the nodes that every conversation
    passes: member, depth, last, conv_id, parent_conv_id."""
    found = stash(
        places.groupBy("depth", "x0", "x1").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.sum(F.col("last") - F.col("depth") + 1).alias("weight"), F.first("p0").alias("p0"), F.first("p1").alias("p1")
        ),
        "trie-keys",
    )
    above = found.select((F.col("depth") + 1).alias("_d"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("conv_id").alias("parent_conv_id"))
    found = found.join(above, (F.col("depth") == F.col("_d")) & (F.col("p0") == F.col("_x0")) & (F.col("p1") == F.col("_x1")), "left").drop("_d", "_x0", "_x1", "p0", "p1")
    found = stash(found, "trie-nodes")
    named = found.select(F.col("depth").alias("_d"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("conv_id").alias("node"), "parent_conv_id")
    passed = places.select(F.col("conv_id").alias("member"), "depth", "last", "x0", "x1").join(named, (F.col("depth") == F.col("_d")) & (F.col("x0") == F.col("_x0")) & (F.col("x1") == F.col("_x1")))
    passed = stash(passed.select("member", "depth", "last", F.col("node").alias("conv_id"), "parent_conv_id"), "trie-members")
    return found.drop("x0", "x1"), passed


def ends(members: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes at which conversations end. A hash is one sequence of bytes, so a node's ids
    are fed to it in one task; they are sorted by Spark and never held together."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, text = None, None
        for batch in batches:
            done = []
            for node, depth, member in zip(*(c.to_pylist() for c in batch.columns)):
                if (node, depth) != at:
                    if at:
                        done.append((*at, text.hexdigest()))
                    at, text = (node, depth), hashlib.sha256(str(member).encode())
                else:
                    text.update(f",{member}".encode())
            yield _rows(done)
        yield _rows([(*at, text.hexdigest())] if at else [])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        conv, depth, text = zip(*done) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(text, pa.string())], ["conv_id", "depth", "ends_sha256"])

    last = members.filter("depth = last").select(*_NODE, "member")
    n = partitions_for(members.sparkSession, 0, 1)
    return last.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "member").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def split_all(comp: np.ndarray, parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Totals of values (a column for each) over subtrees within components, by splitting every component at its centroid
    until none is left. parent: row of the parent, or -1; comp: any number, the same for the nodes of a component."""
    n = len(comp)
    total = np.zeros_like(values)
    parent, weight = parent.copy(), weight.copy()
    _, comp = np.unique(comp, return_inverse=True)
    active = np.arange(n)
    while len(active):
        # the heaviest node of a component is its top; the centroid is the deepest that weighs half of it or more
        _, own = np.unique(comp[active], return_inverse=True)
        whole = np.zeros(own.max() + 1, weight.dtype)
        np.maximum.at(whole, own, weight[active])
        on_path = 2 * weight[active] >= whole[own]
        path, group = active[on_path], own[on_path]
        order = np.lexsort((depth[path], group))
        last = np.flatnonzero(np.r_[group[order][1:] != group[order][:-1], True])
        centroid = path[order][last]  # by group
        # the top of every node in what is left when the centroids are gone; above a centroid it is the old top
        is_centroid = np.zeros(n, bool)
        is_centroid[centroid] = True
        up = np.arange(n)
        inner = active[parent[active] >= 0]
        inner = inner[~is_centroid[parent[inner]] & ~is_centroid[inner]]
        up[inner] = parent[inner]
        while True:
            further = up[up[active]]
            if (further == up[active]).all():
                break
            up[active] = further
        # totals of the parts below a centroid, and its own values
        sums = np.zeros((len(centroid), values.shape[1]), values.dtype)
        np.add.at(sums, group[order][last], values[centroid])
        top = up[active]
        below = (parent[top] >= 0) & is_centroid[np.maximum(parent[top], 0)] & ~is_centroid[active]
        np.add.at(sums, own[below], values[active[below]])
        np.add.at(total, path, sums[group])
        weight[path] -= weight[centroid][group]
        parent[top[below]] = -1
        parent[centroid] = -1
        comp = up
        active = active[~is_centroid[active]]
    return total


def _in_tasks(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """conv_id, depth and what the levels within components of at most IN_TASK nodes add to each value."""
    fields = ["comp_conv", "comp_depth", "conv_id", "depth", "parent_conv_id", "weight", *values]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]  # bounded: TASK_ROWS on average, and components are small
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        conv, depth, up, weight = (rows.column(c).to_numpy() for c in ("conv_id", "depth", "parent_conv_id", "weight"))
        comp = np.stack([rows.column(c).to_numpy() for c in ("comp_conv", "comp_depth")], 1)
        comp = np.unique(comp, axis=0, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((conv, depth))
        key = np.rec.fromarrays([depth[order], conv[order]])
        wanted = np.rec.fromarrays([depth - 1, up])
        at = np.minimum(np.searchsorted(key, wanted), len(order) - 1)
        parent = np.where(key[at] == wanted, order[at], -1)
        parent = np.where(comp[np.maximum(parent, 0)] == comp, parent, -1)  # an edge to another component is none
        total = split_all(comp, parent, depth, weight.copy(), np.stack([rows.column(v).to_numpy() for v in values], 1))
        yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array(depth), *(pa.array(total[:, k]) for k in range(len(values)))], [*_NODE, *values])

    n = partitions_for(nodes.sparkSession, nodes.count(), TASK_ROWS)
    return nodes.select(*fields).repartition(n, "comp_conv", "comp_depth").mapInArrow(run, "conv_id long, depth long, " + ", ".join(f"{v} long" for v in values))


def _part(nodes: DataFrame, centroid: DataFrame, members: DataFrame, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One level of large components: nodes with their new components and weights, without the centroids; and what is added
    to the nodes of the paths."""
    # the children of a centroid, by the members that pass them: the part below that a node is in is where its own member goes
    goes = members.select("member", (F.col("depth") - 1).alias("_cd"), F.col("conv_id").alias("_child"), F.col("parent_conv_id").alias("_cc"))
    goes = goes.join(centroid, (goes["_cc"] == centroid["c_conv"]) & (goes["_cd"] == centroid["c_depth"])).select("member", F.col("k_conv").alias("_kc"), F.col("k_depth").alias("_kd"), "_child")
    named = nodes.join(centroid, (F.col("comp_conv") == F.col("k_conv")) & (F.col("comp_depth") == F.col("k_depth")))
    below = F.col("_child").isNotNull() & (F.col("depth") > F.col("c_depth"))
    named = named.join(goes, (F.col("conv_id") == F.col("member")) & (F.col("comp_conv") == F.col("_kc")) & (F.col("comp_depth") == F.col("_kd")), "left")
    path = 2 * F.col("weight") >= F.col("whole")
    named = stash(named.select(*nodes.columns, "c_conv", "c_depth", "c_weight", below.alias("_below"), path.alias("_path"), "_child"), "trie-parted")
    at = (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
    sums = named.filter(F.col("_below") | at).groupBy("comp_conv", "comp_depth").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    added = named.filter("_path").select(*_NODE, F.col("comp_conv").alias("_kc"), F.col("comp_depth").alias("_kd")).join(sums, (F.col("_kc") == F.col("comp_conv")) & (F.col("_kd") == F.col("comp_depth")))
    left = named.filter(~at).withColumns({
        "comp_conv": F.when(F.col("_below"), F.col("_child")).otherwise(F.col("comp_conv")),
        "comp_depth": F.when(F.col("_below"), F.col("c_depth") + 1).otherwise(F.col("comp_depth")),
        "weight": F.when(F.col("_path"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")),
    })
    return left.select(nodes.columns), added.select(*_NODE, *[F.col(f"t_{v}").alias(v) for v in values])


def subtree_totals(nodes: DataFrame, members: DataFrame, values: Sequence[str], in_task: int = IN_TASK) -> DataFrame:
    """conv_id, depth and the totals of values over each node's subtree, its top included.

    nodes: conv_id, depth, parent_conv_id, weight (of the whole subtree, at least 1 more than its children's) and values.
    members: for at least every conv_id of nodes, the nodes on its way: member, depth, conv_id, parent_conv_id.
    """
    root = nodes.filter("depth = 0").first()  # a trie has one
    first = F.lit(root["conv_id"] if root else 0).cast("long")
    left = nodes.select(first.alias("comp_conv"), F.lit(0).cast("long").alias("comp_depth"), *_NODE, "parent_conv_id", "weight", *values)
    added, done = [], []
    while True:
        sizes = left.groupBy("comp_conv", "comp_depth").agg(F.count("*").alias("_n"), F.max("weight").alias("whole")).filter(F.col("_n") > in_task)
        large = stash(sizes.select(F.col("comp_conv").alias("k_conv"), F.col("comp_depth").alias("k_depth"), "whole"), "trie-large")
        in_large = (F.col("comp_conv") == F.col("k_conv")) & (F.col("comp_depth") == F.col("k_depth"))
        done.append(left.join(large, in_large, "left_anti"))
        if large.isEmpty():
            break
        open_ = left.join(large.drop("whole"), in_large, "left_semi")
        half = open_.join(large, in_large).filter(2 * F.col("weight") >= F.col("whole"))
        centroid = half.groupBy("k_conv", "k_depth", "whole").agg(F.max(F.struct("depth", "conv_id", "weight")).alias("c"))
        centroid = stash(centroid.select("k_conv", "k_depth", "whole", F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "trie-centroids")
        left, more = _part(open_, centroid, members, values)
        left = stash(left, "trie-left")
        added.append(stash(more, "trie-added"))
    rest = done[0]
    for more in done[1:]:
        rest = rest.unionByName(more)
    found = _in_tasks(stash(rest, "trie-small"), values)
    for more in added:
        found = found.unionByName(more)
    return found.groupBy(*_NODE).agg(*[F.sum(v).alias(v) for v in values])


def conversation_trie(conversations: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    nodes, members = nodes_of(prefixes(rebuilt(turn_places(conversations))))
    children = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("_c"), (F.col("depth") - 1).alias("_d")).agg(F.count("*").alias("_k"))
    nodes = nodes.join(children, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left").withColumn("n_children", F.coalesce("_k", F.lit(0)).cast("long"))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size"))
    nodes = stash(nodes.select(*_NODE, F.coalesce("parent_conv_id", F.lit(0)).alias("parent_conv_id"), "n_convs", "n_children", "weight", "n_leaves", "saved_tokens"), "trie-valued")
    totals = subtree_totals(nodes, members, ["n_leaves", "saved_tokens"], in_task)
    said = ends(members)
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, _NODE).join(said, _NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        *_NODE, F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE_SQL = """
WITH crc AS (SELECT list(t ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) x(i))),
o AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, max(pos) AS len, conv_id::VARCHAR AS s FROM o GROUP BY conv_id),
h AS (
  SELECT conv_id, len, conv_id - conv_id % 100 AS base, xor(list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda k: ord(s[k])::BIGINT),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h FROM n, crc),
p AS MATERIALIZED (SELECT h.*, least(h.h, coalesce(b.len, 0)) AS had FROM h LEFT JOIN n b ON b.conv_id = h.base),
r AS (
  SELECT p.conv_id, o.pos AS depth, role, text FROM p JOIN o ON o.conv_id = p.base AND o.pos <= p.h
  UNION ALL SELECT p.conv_id, o.pos - p.h + p.had, role, text FROM p JOIN o ON o.conv_id = p.conv_id AND o.pos > p.h
  UNION ALL SELECT conv_id, 0, '', '' FROM p),
k AS (SELECT conv_id, depth, text, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, max(depth) OVER (PARTITION BY conv_id) AS last FROM r),
m AS MATERIALIZED (SELECT conv_id, depth, text, last, min(conv_id) OVER (PARTITION BY depth, key) AS node FROM k),
v AS MATERIALIZED (
  SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * max(length(text)) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256 FROM m GROUP BY node, depth),
u AS MATERIALIZED (SELECT v.*, a.node AS parent FROM v LEFT JOIN m a ON a.conv_id = v.node AND a.depth = v.depth - 1),
c AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM u WHERE parent IS NOT NULL GROUP BY ALL),
w AS MATERIALIZED (SELECT u.*, coalesce(c.n, 0) AS n_children FROM u LEFT JOIN c ON c.parent = u.node AND c.depth = u.depth),
t AS (
  SELECT m.node, m.depth, count(*) FILTER (w.n_children = 0) AS n_leaves, sum(w.saved) AS saved_tokens
  FROM w JOIN m ON m.conv_id = w.node AND m.depth <= w.depth GROUP BY m.node, m.depth)
SELECT w.node AS conv_id, w.depth, w.parent AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM w JOIN t ON t.node = w.node AND t.depth = w.depth
"""

ORACLES = {"op13_conversation_trie": ORACLE_SQL}
QUERIES = {"op13_conversation_trie": op13_conversation_trie}

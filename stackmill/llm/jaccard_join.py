"""N-gram Jaccard join in the metric space of word shingle sets, exact.

The Jaccard distance is a metric, but texts that have nothing to do with each other are all at distance one, so windows around
pivots drawn from a whole corpus would hold everything. Sets therefore get their pivots from where they can be near at
all. Sizes fall into classes (a set also belongs to the next class if its window reaches there), and the shingles of a class are dealt
into a fixed number of parts, more than similar sets can differ in: similar sets have some part in common, whole. Of all sets
that share a part, the least is the pivot.

``near_links`` then joins around pivots. Each set's distance to its pivots is computed exactly; what is within the limit r is linked. By the
triangle inequality sets within r of each other have distances to a pivot that differ by r at most: the sets around a pivot fall into
shells of width r, each set is replicated into the next shell, and every shell is a region of its own (a cell around its
pivot, cut at windows). Regions whose sets are in one component already need nothing more. Small ones are joined whole
within a task; large ones are joined recursively around a pivot of their own. Where distances are so alike that regions do not
shrink in LEVELS levels, the rest is dealt into blocks that meet each other, which is slow but loses nothing.

Sets are known by a 64-bit hash of their shingle hashes, told apart by a second one; equal sets are one node, so exact
copies cost one row each. Distances are of the full shingle sets.

Defined cases: null texts and texts without words have no shingles and are linked with nothing; texts of fewer words than a shingle are one
shingle; a text of several rows with one id is a set of its own, and the id counts for component_id; rows with a null id are linked with
their exact copies only; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.llm.common import stash, table
from stackmill.llm.components import connected_components
from stackmill.llm.ngrams import chunks, mix, words_of_texts

SHINGLE, PERCENT = 3, 90
#: Sizes of a class differ by this factor at most.
GROWTH = 1.5
#: Sets of a region that is joined whole; levels of pivots before the rest is joined by blocks.
REGION, LEVELS = 1024, 5
#: Ids that are broadcast (8 bytes each) so that texts stay where they are; more are joined by a shuffle.
KNOWN_IDS = 1_000_000
_COLUMNS = 4096


def shingle_sets(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Of batches (id, text): id and sorted distinct shingle hashes of each row."""
    for batch in chunks(batches, 1):
        starts, _, tokens, hashes, _ = words_of_texts(pc.fill_null(batch.column(1), ""), b" \t\n\x0b\x0c\r")
        words = hashes[tokens]
        several = words
        for k in range(1, shingle):
            several = mix(several[: max(0, len(words) - k)], words[k:])
        for k, name in enumerate(batch.column(0).to_pylist()):
            a, b = starts[k], starts[k + 1]
            if a == b:
                yield name, words[:0]
            elif b - a < shingle:
                h = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    h = mix(h, w)
                yield name, h
            else:
                yield name, np.unique(several[a : b - shingle + 1])


def node_of(u: np.ndarray, seed: int) -> int:
    return xxhash.xxh64_intdigest(u.tobytes(), seed) - (1 << 63)


def documents_as_sets(docs: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, int]:
    """doc_id, n (shingles), node (null for none) of every document, and the seed of the nodes: under it, different sets have
    different nodes."""

    def hashed(seed: int) -> Callable:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(name, len(u), *((node_of(u, seed + k) for k in (0, 1)) if len(u) else (None, None))) for name, u in shingle_sets([batch], shingle)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 4, ["doc_id", "n", "node", "other"])

        return run

    for seed in range(0, 16, 2):
        found = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed(seed), "doc_id long, n long, node long, other long"), "jaccard-sets")
        if found.groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).filter("low <> high").isEmpty():
            return found.drop("other"), seed
    raise RuntimeError("sets clash under every seed")


def differing(size: int, percent: int) -> int:
    """Most shingles in which two similar sets of at most that size differ."""
    return 2 * size * (100 - percent) // (100 + percent)


def classes(percent: int, most: int) -> list[int]:
    """Upper sizes of the classes. Sets of the first differ in nothing."""
    first = 1
    while differing(first + 1, percent) == 0:
        first += 1
    out = [first]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


def part_keys(u: np.ndarray, percent: int, bounds: list[int]) -> np.ndarray:
    """Keys of a set: one for each part of its class and, near the upper end, of the next. Of spare + 1 common parts one
    is not empty, but for sets with more empty parts than that, which have keys for those too."""
    home = int(np.searchsorted(bounds, len(u)))
    out = []
    for k in ([home] if home else []) + ([home + 1] if len(u) * 100 // percent > bounds[home] else []):
        most = differing(bounds[k], percent)
        spare = 3 + most // 50
        parts = most + 1 + spare
        x = mix(u, np.uint64(k))
        part = (x % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(sums, part, mix(x, np.uint64(1)))
        full = np.bincount(part, minlength=parts) > 0
        if parts - full.sum() > spare:
            full[:] = True
        out.append(mix(np.flatnonzero(full).astype(np.uint64) + np.uint64(k << 48), sums[full]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pivots(docs: DataFrame, seed: int, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """pivot, node: every set with the pivots that it shares a part with. A pivot is its own."""
    bounds = classes(percent, 1 << 40)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, np.ndarray] = {}
            for _, u in shingle_sets([batch], shingle):
                if len(u) and (node := node_of(u, seed)) not in held:
                    held[node] = part_keys(u, percent, bounds)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(held.values())).view(np.int64)), pa.array(np.repeat(np.array(list(held), np.int64), [len(k) for k in held.values()]))], ["key", "node"])

    keys = stash(docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "key long, node long"), "jaccard-keys")
    heads = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("_last")).filter("pivot <> _last").select(F.col("key").alias("_key"), "pivot")
    return stash(keys.join(heads, F.col("key") == F.col("_key")).select("pivot", "node").distinct(), "jaccard-pivots")


def packed_sets(docs: DataFrame, firsts: DataFrame, seed: int, shingle: int = SHINGLE) -> DataFrame:
    """node, items (shingle hashes) of the documents whose ids are among firsts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [u for _, u in shingle_sets([batch], shingle) if len(u)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(u, seed) for u in found], pa.int64()), pa.array([u.tobytes() for u in found], pa.binary())], ["node", "items"])

    firsts = stash(firsts.select(F.col("first").alias("_first")).distinct(), "jaccard-firsts")
    if firsts.limit(KNOWN_IDS + 1).count() <= KNOWN_IDS:
        firsts = F.broadcast(firsts)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(firsts, F.col("doc_id") == F.col("_first"), "left_semi")
    return known.mapInArrow(run, "node long, items binary")


def _similar(common: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (sizes - common)


def measured(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """region, pivot, node, d (distance to the pivot), near (whether it is linked with it). sets: node, items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(3), batch.column(4))]
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in pairs], np.int64)
            sizes = np.array([len(x) + len(y) for x, y in pairs], np.int64)
            d = 1 - common / np.maximum(sizes - common, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(d), pa.array(_similar(common, sizes, percent))], ["region", "pivot", "node", "d", "near"])

    own = sets.select(F.col("node").alias("_n"), "items")
    at = sets.select(F.col("node").alias("_p"), F.col("items").alias("at"))
    joined = regions.join(own, F.col("node") == F.col("_n")).join(at, F.col("pivot") == F.col("_p"))
    return joined.select("region", "pivot", "node", "items", "at").mapInArrow(run, "region long, pivot long, node long, d double, near boolean")


def replicated(at: DataFrame, percent: int) -> DataFrame:
    """region, node: the shells, with those sets of the next inner shell that are within the limit of a shell's innermost set."""
    width = (100 - percent) / 100 + 1e-9
    own = at.select("region", F.floor(F.col("d") / width).alias("shell"), "node", "d")
    inner = own.groupBy(F.col("region").alias("_r"), F.col("shell").alias("_s")).agg(F.min("d").alias("_d"))
    met = own.select("region", F.explode(F.array("shell", F.col("shell") + 1)).alias("shell"), "node", "d").join(inner, (F.col("region") == F.col("_r")) & (F.col("shell") == F.col("_s")))
    return met.filter(F.col("d") >= F.col("_d") - width).select(F.xxhash64("region", "shell").alias("region"), "node")


def joined_whole(percent: int) -> Callable[[pa.Table], pa.Table]:
    """For the sets of a region (node, component, items): a, b of the similar pairs of different components."""

    def run(rows: pa.Table) -> pa.Table:
        node, component = rows.column("node").to_numpy(), rows.column("component").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("items").combine_chunks()]
        size = np.array([len(s) for s in sets], np.int64)
        _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = times[item] > 1  # others are in no intersection
        _, item = np.unique(item[shared], return_inverse=True)
        owner = owner[shared]
        order = np.argsort(item, kind="stable")
        item, owner = item[order], owner[order]
        common = np.zeros((len(sets), len(sets)), np.int64)
        ends = np.searchsorted(item, np.arange(0, (item[-1] if len(item) else -1) + 1 + _COLUMNS, _COLUMNS))
        for a, b in zip(ends, ends[1:]):
            holds = np.zeros((len(sets), _COLUMNS), np.float32)  # sums are below 2^24, so exact
            holds[owner[a:b], item[a:b] % _COLUMNS] = 1
            common += (holds @ holds.T).astype(np.int64)
        similar = _similar(common, size[:, None] + size[None, :], percent) & (component[:, None] < component[None, :])
        left, right = np.nonzero(similar)
        return pa.table({"a": node[left], "b": node[right]})

    return run


def _blocks(large: DataFrame, region: int) -> DataFrame:
    """Regions (region, node, component) dealt into blocks of which every two are a region."""
    count = large.groupBy(F.col("region").alias("_r")).agg(F.count("*").alias("_n"))
    k = F.ceil(F.col("_n") / (region // 2 * 0.8)).cast("long")
    dealt = large.join(count, F.col("region") == F.col("_r")).withColumn("_k", k).withColumn("_b", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_k")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("_o")
    met = dealt.select("region", "node", "component", "_b", other)
    return met.select(F.xxhash64("region", F.least("_b", "_o"), F.greatest("_b", "_o")).alias("region"), "node", "component")


def near_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT, region: int = REGION, levels: int = LEVELS) -> DataFrame:
    """a, b: links that connect what the similar pairs among members (pivot, node) connect. sets: node, items."""
    regions, links, small, components = members.select(F.col("pivot").alias("region"), "pivot", "node"), None, [], None
    for level in range(levels):
        at = stash(measured(regions, sets, percent), "jaccard-shells")
        found = at.filter("near and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        links = found if links is None else links.unionByName(found)
        if components is None:  # later levels only add links, and so may look at a region that these would close
            components = stash(connected_components(links, "a", "b").withColumnRenamed("node", "_n"), "jaccard-components")
        shells = stash(replicated(at, percent).join(components, F.col("node") == F.col("_n"), "left").select("region", "node", F.coalesce("component", "node").alias("component")), "jaccard-regions")
        open_ = shells.groupBy(F.col("region").alias("_r")).agg(F.count("*").alias("_n"), F.min("component").alias("_low"), F.max("component").alias("_high"), F.min(F.struct(F.xxhash64("node", F.lit(level)), "node")).alias("_p"))
        open_ = open_.filter("_low <> _high").select("_r", "_n", F.col("_p.node").alias("pivot"))
        left = stash(shells.join(open_, F.col("region") == F.col("_r")).select("region", "pivot", "node", "component", "_n"), "jaccard-open")
        small.append(left.filter(F.col("_n") <= region).select("region", "node", "component"))
        large = left.filter(F.col("_n") > region)
        if large.isEmpty():
            break
        regions = large.select("region", "pivot", "node")
    else:
        small.append(_blocks(large.select("region", "node", "component"), region))
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    rest = rest.join(sets.select(F.col("node").alias("_n"), "items"), F.col("node") == F.col("_n")).select("region", "node", "component", "items")
    return links.unionByName(stash(rest.groupBy("region").applyInArrow(joined_whole(percent), "a long, b long"), "jaccard-links"))


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, region: int = REGION, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    sets, seed = documents_as_sets(docs, shingle)
    nodes = stash(sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")), "jaccard-nodes")
    members = pivots(docs, seed, percent, shingle)
    items = stash(packed_sets(docs, nodes.join(members, "node", "left_semi").select("first"), seed, shingle).dropDuplicates(["node"]), "jaccard-items")
    components = stash(connected_components(near_links(members, items, percent, region, levels), "a", "b"), "jaccard-all-components")
    owner = nodes.join(components.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("component", F.coalesce("component", "node"))
    least = owner.groupBy(F.col("component").alias("_c")).agg(F.min("first").alias("component_id"))
    owner = owner.join(least, F.col("component") == F.col("_c")).select(F.col("node").alias("_node"), "component_id")
    # a join that Spark can split where one set holds much of the rows
    return sets.join(owner, F.col("node") == F.col("_node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_jaccard_join": op11_jaccard_join}

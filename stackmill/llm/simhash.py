"""SimHash near-duplicates by multi-index hashing.

``fingerprints`` gives every whole text a 64-bit SimHash over its word shingles. ``near_links`` finds the distinct
fingerprints that differ in at most four bits: each fingerprint is cut into two 32-bit segments, of which one differs in
two bits at most; both sides enumerate the ball of radius one around each segment, so that segments two flips apart meet
in the table under the value between them; what meets is verified on all 64 bits. Pairs whose segments are equal meet
under their own value only, so no pair is tested twice for one segment. A group is searched breadth-first and gives a
spanning forest, never all its pairs; each task then merges its links to one star per local component before anything is
shuffled. ``near_groups`` resolves the links with distributed connected components.

One fingerprint of 64 bits finds few of the pairs that are only just similar. ``near_groups`` takes several seeds, and then
links texts that are linked by any of their fingerprints, each searched by itself.

Defined cases: null, empty or blank texts have fingerprint zero, linked like any other; texts of fewer words than a
shingle hash the whole sequence; equal fingerprints are one node, so exact copies, of however many rows, cost nothing
beyond a count; repeated ids and other columns are harmless; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.llm.common import partitions_for, stash, table
from stackmill.llm.components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Keys that one fingerprint has: two segments, each by itself and with one of 32 bits flipped.
KEYS = 66
#: Keyed rows of a task.
ROWS_PER_TASK = 2_000_000
_CHUNK = 1 << 16
#: Ids to leave out that are broadcast (8 bytes each), so that texts stay where they are; more are joined by a shuffle.
GONE_ROWS = 1_000_000


def fingerprint(data: bytes, shingle: int = SHINGLE, seeds: Sequence[int] = (SEED,)) -> list[int]:
    """SimHashes of one UTF-8 text, one for each seed; bytes.lower and bytes.split are ASCII-only, as the word rule wants."""
    words = data.lower().split()
    if not words:
        return [0] * len(seeds)
    joined = b" ".join(words)
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(lengths + 1) - 1
        starts, ends = (last - lengths)[: len(words) - shingle + 1].tolist(), last[shingle - 1 :].tolist()
    digest, n, out = xxhash.xxh64_intdigest, len(starts), []
    for seed in seeds:
        votes = np.zeros(64, np.int64)
        for at in range(0, n, _CHUNK):
            hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], np.uint64)
            votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seeds: Sequence[int] = (SEED,)) -> DataFrame:
    """doc_id and for each seed a fingerprint fp0, fp1, ... (the 64 bits as a signed long)."""
    names = [f"fp{k}" for k in range(len(seeds))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle, seeds) for x in batch.column(1)], np.uint64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in fps.view(np.int64).T.copy())], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *names)))


def ball_keys(fps: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and flipped bit (-1: none) of place 0 to 65 of unsigned fingerprints: 33 for each segment, as KEY has them."""
    flips = (places % 33).astype(np.int8) - np.int8(1)
    flipped = np.where(flips >= 0, np.uint64(1) << np.maximum(flips, 0).astype(np.uint64), np.uint64(0))
    upper = places >= 33
    segment = np.where(upper, (fps >> np.uint64(32)) | np.uint64(1 << 32), fps & np.uint64(0xFFFFFFFF))
    return (segment ^ flipped).astype(np.int64), flips


#: The key of a fingerprint's place in SQL. Rows are dealt by it and do not carry it.
KEY = """(CASE WHEN place < 33 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) | 4294967296L END)
    ^ (CASE WHEN place % 33 = 0 THEN 0L ELSE shiftleft(1L, place % 33 - 1) END)"""


def spanning_links(fps: np.ndarray, flips: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that connect what the group's links connect: breadth-first, what is reached leaves the pool."""
    links, pool = [], np.arange(len(fps))
    while len(pool) > 1:
        frontier, pool = [pool[0]], pool[1:]
        while frontier and len(pool):
            at = frontier.pop()
            near = np.bitwise_count(fps[pool] ^ fps[at]) <= radius
            if flips[at] >= 0:  # equal segments meet under their own value
                near &= flips[pool] != flips[at]
            if near.any():
                hits = pool[near]
                links += [(int(at), int(h)) for h in hits]
                frontier += list(hits)
                pool = pool[~near]
    return links


def merged(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Union-find over one task's links: (node, smallest node of its local component), without the trivial ones."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    return nodes, [find(x) for x in nodes]


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, rep (one row for each distinct fingerprint) -> a, b: links between reps."""
    spark = nodes.sparkSession

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        fp, rep, place = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in range(3))
        fp = fp.view(np.uint64)
        key, flip = ball_keys(fp, place)
        order = np.argsort(key, kind="stable")
        key, flip, fp, rep = key[order], flip[order], fp[order], rep[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        low, high = np.minimum.reduceat(flip, first), np.maximum.reduceat(flip, first)
        worth = (size > 1) & ((low != high) | (low == -1))
        a, b = [], []
        for s, n in zip(first[worth].tolist(), size[worth].tolist()):
            if n == 2:
                if int(fp[s] ^ fp[s + 1]).bit_count() <= radius:
                    a.append(int(rep[s]))
                    b.append(int(rep[s + 1]))
                continue
            for x, y in spanning_links(fp[s : s + n], flip[s : s + n], radius):
                a.append(int(rep[s + x]))
                b.append(int(rep[s + y]))
        a, b = merged(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    places = F.explode(F.sequence(F.lit(0), F.lit(KEYS - 1)).cast("array<tinyint>")).alias("place")
    n = partitions_for(spark, KEYS * nodes.count(), ROWS_PER_TASK)
    return nodes.select("fp", "rep", places).repartition(n, F.expr(KEY)).mapInArrow(linked, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seeds: Sequence[int] = (SEED,)) -> DataFrame:
    """doc_id, the fingerprints (fp0, ...) and component_id (smallest doc_id reachable over links) for every document. Texts
    are linked if their fingerprints of any one seed are."""
    fps = stash(fingerprints(docs, id_col, text_col, shingle, seeds), "fingerprints")
    names = fps.columns[1:]
    nodes = stash(fps.groupBy(*names).agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "fingerprint-nodes")
    links = []
    for name in names:
        heads = nodes.groupBy(F.col(name).alias("fp")).agg(F.min("rep").alias("rep"))
        if len(names) > 1:
            heads = stash(heads, "fingerprint-heads")
            equal = nodes.join(heads.select(F.col("fp").alias(name), F.col("rep").alias("b")), name)
            links.append(equal.filter("rep <> b").select(F.col("rep").alias("a"), "b"))
        links.append(stash(near_links(heads), "fingerprint-links"))
    components = connected_components(reduce(DataFrame.unionByName, links), "a", "b")
    owner = nodes.join(components, nodes["rep"] == components["node"], "left").select(*[F.col(c).alias(f"_{c}") for c in names], F.coalesce("component", "rep").alias("component_id"))
    # a join that Spark can split where one fingerprint holds much of the rows
    same = reduce(lambda x, y: x & y, [fps[c] == owner[f"_{c}"] for c in names])
    return fps.join(owner, same, "left").select("doc_id", *names, "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, seeds: Sequence[int] = (SEED,)) -> DataFrame:
    """docs without the members of near-duplicate groups other than the one with the smallest id. Rows that share an id
    are one document: one of them stays, the same one in every run. Rows with a null id belong to no group and stay."""
    groups = stash(near_groups(docs, shingle=shingle, seeds=seeds).select("doc_id", "component_id"), "near-groups")
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    gone = stash(gone, "near-gone")
    if gone.limit(GONE_ROWS + 1).count() <= GONE_ROWS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = stash(groups.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row"))
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once.select("_row.*"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}

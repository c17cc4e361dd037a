"""Phrase collocations by SON partitioning.

Texts are cut into pieces and words, everything by language. The corpus falls into SHARDS shards (tasks of the scan, dealt
round). ``local_phrases`` mines each shard completely: all phrases of two words up to the longest are counted by shard as
64-bit hashes, and those with at least support / SHARDS occurrences in a shard (rounded up) are locally frequent. A phrase that
is locally frequent nowhere has at most SHARDS * (ceil(support / SHARDS) - 1) < support occurrences, so the union of the
local results loses nothing, however unequal the shards are. ``phrase_counts`` then counts all candidates globally: a second
scan sends only what may be a candidate and counts words themselves, not hashes of phrases; what is below support goes.

Tasks know the candidates by a bit filter of bounded size (at most FILTER_BITS bits). It lets every candidate pass and a few
others, which the exact count removes; with more candidates than it is made for, more rows are shuffled, nothing is lost.
Words are numbers between the passes: their 64-bit hashes, told apart by ``vocabulary``, which tries another seed should two
words of a language ever clash.

Scores are integers, worked out on decimals: floor(SCALE * a * a / (l * r)) for a cut into parts found l and r times, the
lowest of a phrase's cuts. Counts may be up to 10^16.

Defined cases: null texts are empty; a null language is ``und``; a piece without words counts for nothing; repeated rows count
each time; an empty table gives no rows; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackmill.llm.common import stash, table
from stackmill.llm.ngrams import chunks, mix, words_of_texts

SUPPORT, LONGEST, SHARDS, COVER, TOP, SCALE = 10, 3, 4, 50, 2000, 1_000_000
#: Bits of the filter for each candidate, and at most (32 MB).
BITS_EACH, FILTER_BITS = 10, 1 << 28


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def words_by_language(batches: Iterable[pa.RecordBatch], seed: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Of batches (lang, text), chunk by chunk: a language, the piece of each word and its number in the dictionary, and hashes
    and words of the dictionary."""
    for batch in chunks(batches, 1):
        for lang in pc.unique(batch.column(0)).to_pylist():
            texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
            yield lang, *words_of_texts(texts, b" \t", b".,;:!?\n\x0b\x0c\r", seed)[1:]


def phrases(lang: str, pieces: np.ndarray, tokens: np.ndarray, hashes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length from 2: the length, where its phrases start among the words, and a hash of language and words."""
    words = hashes[tokens]
    h = mix(np.uint64(xxhash.xxh64_intdigest(lang)), words)
    for size in range(2, longest + 1):
        if len(tokens) < size:
            return
        n = len(tokens) - size + 1
        h = mix(h[:n], words[size - 1 :])
        at = np.flatnonzero(pieces[:n] == pieces[size - 1 :])
        yield size, at, h[at]


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """lang, w (hash), word, f (occurrences) of every word, and the seed under which no two words of a language clash."""

    def counted(seed: int) -> Callable:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lang, _, tokens, hashes, words in words_by_language(batches, seed):
                n = np.bincount(tokens, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(hashes.view(np.int64)), words.cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "w", "word", "f"])

        return run

    for seed in range(8):
        found = _texts(docs).mapInArrow(counted(seed), "lang string, w long, word string, f long")
        found = stash(found.groupBy("lang", "w", "word").agg(F.sum("f").alias("f")), "phrase-words")
        if found.groupBy("lang", "w").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return found, seed
    raise RuntimeError("words clash under every seed")


def local_phrases(docs: DataFrame, seed: int, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """h: hashes of the phrases that are locally frequent in some shard."""

    def mined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        for lang, pieces, tokens, hashes, _ in words_by_language(batches, seed):
            for _, _, h in phrases(lang, pieces, tokens, hashes, longest):
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), shard, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["shard", "h", "n"])

    rows = _texts(docs).mapInArrow(mined, "shard int, h long, n long")
    local = rows.groupBy("h", "shard").agg(F.sum("n").alias("n")).filter(F.col("n") >= -(-support // shards))
    return stash(local.select("h").distinct(), "phrase-candidates")


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(size - 1)).astype(np.int64), (h >> np.uint64(36) & np.uint64(size - 1)).astype(np.int64)


def bit_filter(candidates: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """A bit set (uint64 words) in which both bits of every candidate are set; its size is bounded by most bits."""
    size = 64
    wanted = min(most, BITS_EACH * candidates.count())
    while size < wanted:
        size *= 2
    low = F.col("h").bitwiseAND(F.lit(size - 1))
    high = F.shiftrightunsigned("h", 36).bitwiseAND(F.lit(size - 1))
    bit = candidates.select(F.explode(F.array(low, high)).alias("b")).select(F.shiftright("b", 6).alias("k"), F.expr("shiftleft(1L, int(b & 63L))").alias("m"))
    rows = bit.groupBy("k").agg(F.bit_or("m").alias("m")).toArrow()  # bounded: a row for each word of the filter at most
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("k").to_numpy()] = rows.column("m").to_numpy().view(np.uint64)
    return out


def _may_be(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = [(words[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) for b in _bits(h, 64 * len(words))]
    return (at[0] & at[1]).astype(bool)


def phrase_counts(docs: DataFrame, candidates: DataFrame, seed: int, support: int = SUPPORT, longest: int = LONGEST) -> DataFrame:
    """lang, ws (word hashes), f of every phrase with at least support occurrences, counted exactly."""
    known = docs.sparkSession.sparkContext.broadcast(bit_filter(candidates))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for lang, pieces, tokens, hashes, _ in words_by_language(batches, seed):
            for size, at, h in phrases(lang, pieces, tokens, hashes, longest):
                keep = _may_be(bits, h)
                at = at[keep]
                _, first, n = np.unique(h[keep], return_index=True, return_counts=True)
                words = hashes[tokens[at[first][:, None] + np.arange(size)]].view(np.int64)
                ws = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * np.int32(size)), pa.array(words.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), ws, pa.array(n.astype(np.int64))], ["lang", "ws", "n"])

    rows = _texts(docs).mapInArrow(counted, "lang string, ws array<bigint>, n long")
    return stash(rows.groupBy("lang", "ws").agg(F.sum("n").alias("f")).filter(F.col("f") >= support), "phrase-counts")


def _exact(col: str) -> Column:
    return F.col(col).cast("decimal(19,0)")


def scored(counts: DataFrame, words: DataFrame) -> DataFrame:
    """lang, ws, a, l, r, score of every counted phrase: its cut with the lowest score, of several the first."""
    parts = counts.unionByName(words.select("lang", F.array("w").alias("ws"), "f"))
    cuts = counts.select("lang", "ws", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.withColumn("_left", F.expr("slice(ws, 1, k)")).withColumn("_right", F.expr("slice(ws, k + 1, size(ws) - k)"))
    left = parts.select(F.col("lang").alias("_ll"), F.col("ws").alias("_lw"), F.col("f").alias("l"))
    right = parts.select(F.col("lang").alias("_rl"), F.col("ws").alias("_rw"), F.col("f").alias("r"))
    cuts = cuts.join(left, (F.col("lang") == F.col("_ll")) & (F.col("_left") == F.col("_lw")))
    cuts = cuts.join(right, (F.col("lang") == F.col("_rl")) & (F.col("_right") == F.col("_rw")))
    cuts = cuts.withColumn("_a", _exact("a")).withColumn("_l", _exact("l")).withColumn("_r", _exact("r")).withColumn("score", F.expr(f"(_a * _a * {SCALE}) div (_l * _r)"))
    best = cuts.groupBy("lang", "ws").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "ws", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))


def uncovered(found: DataFrame, cover: int = COVER) -> DataFrame:
    """found without phrases inside a longer one that has at least cover percent of their occurrences."""
    size = F.size("ws")
    # a longer phrase that holds a phrase holds it with one more word too, which is found at least as often
    inner = found.filter(size > 2).select("lang", "a", F.explode(F.array(F.slice("ws", F.lit(1), size - 1), F.slice("ws", F.lit(2), size - 1))).alias("ws"))
    most = inner.groupBy(F.col("lang").alias("_il"), F.col("ws").alias("_iw")).agg(F.max("a").alias("_most"))
    joined = found.join(most, (F.col("lang") == F.col("_il")) & (F.col("ws") == F.col("_iw")), "left")
    return joined.filter(F.col("_most").isNull() | (100 * F.col("_most") < cover * F.col("a"))).select(found.columns)


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of every language."""
    words, seed = vocabulary(docs)
    counts = phrase_counts(docs, local_phrases(docs, seed, support, longest, shards), seed, support, longest)
    found = uncovered(stash(scored(counts, words), "phrase-scores"), cover)
    order = [F.col("score").desc(), F.col("a").desc()]
    # cut by rank before words are fetched; ties at the end stay until their phrases are known
    ahead = stash(found.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_rank") <= top).drop("_rank"), "phrase-ahead")
    names = words.select(F.col("lang").alias("_vl"), F.col("w").alias("_vw"), "word")
    spelt = ahead.select("*", F.posexplode("ws").alias("_at", "_w")).join(names, (F.col("lang") == F.col("_vl")) & (F.col("_w") == F.col("_vw")))
    spelt = spelt.groupBy("lang", "ws", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    total = words.groupBy(F.col("lang").alias("_tl")).agg(F.sum("f").alias("n"))
    ranked = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, F.col("lang") == F.col("_tl")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, j, unnest(list_transform(range(1, greatest(len(ws) - j + 2, 1)), lambda i: array_to_string(ws[i:i + j - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) t(j)),
f AS MATERIALIZED (SELECT lang, j, phrase, count(*)::BIGINT AS f FROM g GROUP BY lang, j, phrase),
c AS (SELECT lang, j, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE j > 1 AND f >= 10),
h AS MATERIALIZED (
  SELECT lang, j, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:j], ' ') AS tail
  FROM (SELECT *, unnest(range(1, j)) AS k FROM c)),
k AS (
  SELECT h.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM h JOIN f l ON l.lang = h.lang AND l.phrase = h.head JOIN f r ON r.lang = h.lang AND r.phrase = h.tail),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE j = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE j = 3) GROUP BY lang, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE j = 1 GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase)::BIGINT AS rank, b.phrase, a, l, r, n.n, score
FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase AND b.j = 2 JOIN n ON n.lang = b.lang
WHERE i.most IS NULL OR 100 * i.most < 50 * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": ORACLE_SQL}

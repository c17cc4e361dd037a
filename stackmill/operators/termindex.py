"""Stored positional index of chunks and exact ranked search over it.

A8. ``write`` cuts every field of the chunks into terms once and stores three tables: ``postings`` (field, term, chunk_id, tf, dl,
positions) in buckets by term, ``terms`` (df and the greatest weight that the term gives any chunk) and ``fields`` (chunks and
mean length). Keyword fields are one term. Searches read the buckets of the asked terms and cut no chunk.

H2 over it (``search``) is exact and leaves out what cannot be among the k best: partial scores of a request give a lower bound
for its k-th score, first those of its rarest terms, then those of all terms that lead; the terms of a field whose greatest weights together stay below the bound only count for chunks that some other
term has found, so lists of frequent words are not opened for every chunk.

Defined cases: null and empty fields have no terms; a request without known terms has no hits; chunk ids are unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackmill.functions import text as T

#: BM25, and the boosts of analysed and keyword fields.
K1, B = 1.2, 0.75
ANALYSED, KEYWORD = {"text": 3.0, "caption": 2.0}, {"section": 2.0, "name": 1.0}
#: Postings of a bucket, buckets at least, postings that a request opens for its bound.
BUCKET_ROWS, BUCKETS, PROBE = 5_000_000, 16, 5_000
#: Below what differences of sums in another order can reach.
_SLACK = 1e-6


@dataclass(frozen=True)
class TermIndex:
    path: str
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    buckets: int


def occurrences(chunks: DataFrame) -> DataFrame:
    """A8. field, term, chunk_id, tf, dl, positions (from 0, in order) of every field, each chunk cut once."""
    fields = [F.struct(F.lit(f).alias("field"), T.terms(F.col(f)).alias("ts")) for f in ANALYSED]
    fields += [F.struct(F.lit(f).alias("field"), F.array(f).alias("ts")) for f in KEYWORD]
    cut = chunks.select("chunk_id", F.explode(F.array(*fields)).alias("x")).select("chunk_id", "x.field", "x.ts", F.size("x.ts").alias("dl"))
    tokens = cut.select("chunk_id", "field", "dl", F.posexplode("ts").alias("pos", "term")).filter("term <> ''")
    return tokens.groupBy("field", "term", "chunk_id", "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def weight(tf: Column, dl: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write(chunks: DataFrame, path: str, buckets: int | None = None) -> TermIndex:
    """Store the index at path. Without a number, there are as many buckets as the postings ask for."""
    spark = chunks.sparkSession
    occurrences(chunks).write.mode("overwrite").parquet(f"{path}/found")
    found = spark.read.parquet(f"{path}/found")
    buckets = buckets or max(BUCKETS, found.count() // BUCKET_ROWS + 1)
    placed = found.withColumn("bucket", bucket(F.col("term"), buckets))
    placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", "chunk_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    # the mean length is over all chunks; fields without a term count as empty
    n = chunks.count()
    lengths = found.select("field", "chunk_id", "dl").distinct().groupBy("field").agg((F.sum("dl") / F.lit(n)).alias("mean")).withColumn("n", F.lit(n).cast("long"))
    lengths.coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")  # a row for each field
    fields = spark.read.parquet(f"{path}/fields")
    terms = found.join(F.broadcast(fields), "field").groupBy("field", "term").agg(F.count("*").alias("df"), F.max(weight(F.col("tf"), F.col("dl"), F.col("mean"))).alias("most"))
    terms.withColumn("bucket", bucket(F.col("term"), buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    return stored(spark, path, buckets)


def stored(spark: SparkSession, path: str, buckets: int) -> TermIndex:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return TermIndex(path, read("postings"), read("terms"), read("fields"), buckets)


def asked_terms(index: TermIndex, requests: DataFrame, fields: dict[str, float]) -> DataFrame:
    """query_id, field, term, bucket, df, mean, idf, boost, most (the greatest share of a score) of what requests ask for."""
    each = requests.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))
    boosts = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    each = each.select("query_id", F.explode(F.array(*map(F.lit, fields))).alias("field"), "term").withColumn("bucket", bucket(F.col("term"), index.buckets))
    known = each.join(index.terms, ["bucket", "field", "term"]).join(F.broadcast(index.fields), "field").withColumn("idf", idf(F.col("n"), F.col("df"))).withColumn("boost", boosts[F.col("field")])
    return known.withColumn("most", F.col("boost") * F.col("idf") * F.col("most")).drop("n")


def opened(index: TermIndex, asked: DataFrame) -> DataFrame:
    """The postings in the buckets of the asked terms; their numbers, at most as many as there are buckets, go into the scan."""
    buckets = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())
    return index.postings.filter(F.col("bucket").isin(buckets)) if len(buckets) < index.buckets else index.postings


def shares(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, field, chunk_id, share (boosted) of each asked term in each chunk that has it."""
    met = postings.select("bucket", "field", "term", "chunk_id", "tf", "dl").join(asked, ["bucket", "field", "term"])
    return met.select("query_id", "field", "chunk_id", (F.col("boost") * F.col("idf") * weight(F.col("tf"), F.col("dl"), F.col("mean"))).alias("share"))


def keyword_hits(index: TermIndex, requests: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: chunks whose whole keyword field is the request."""
    each = requests.select("query_id", F.col("query").alias("term"), F.explode(F.array(*map(F.lit, KEYWORD))).alias("field")).withColumn("bucket", bucket(F.col("term"), index.buckets))
    boosts = F.create_map(*[F.lit(x) for pair in KEYWORD.items() for x in pair])
    return index.postings.select("bucket", "field", "term", "chunk_id").join(each, ["bucket", "field", "term"]).select("query_id", "chunk_id", boosts[F.col("field")].alias("score"))


def kth_scores(sums: DataFrame, k: int) -> DataFrame:
    """query_id, bound: the k-th best of partial scores (query_id, field, chunk_id, s), which the whole scores of k chunks reach;
    for requests with so many chunks."""
    best = sums.groupBy("query_id", "chunk_id").agg(F.max("s").alias("s")).withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))).filter(F.col("_n") <= k)
    return best.groupBy("query_id").agg(F.count("*").alias("_k"), F.min("s").alias("bound")).filter(F.col("_k") == k).select("query_id", (F.col("bound") - _SLACK).alias("bound"))


def rarest(asked: DataFrame) -> DataFrame:
    """The terms of each request with the shortest lists, PROBE postings of them or one term."""
    run = Window.partitionBy("query_id").orderBy("df", "field", "term")
    return asked.withColumn("_sum", F.sum("df").over(run)).filter((F.col("_sum") <= PROBE) | (F.col("_sum") == F.col("df"))).drop("_sum")


def sums_of(asked: DataFrame, postings: DataFrame) -> DataFrame:
    return shares(asked, postings).groupBy("query_id", "field", "chunk_id").agg(F.sum("share").alias("s"))


def search(index: TermIndex, requests: DataFrame, k: int, scratch: str) -> DataFrame:
    """query_id, chunk_id, score (of the best field, boosted): at least the k best chunks of every request (query_id, query)."""
    spark = requests.sparkSession
    asked_terms(index, requests, ANALYSED).write.mode("overwrite").parquet(f"{scratch}/asked")
    asked = spark.read.parquet(f"{scratch}/asked")
    postings = opened(index, asked)
    by_most = Window.partitionBy("query_id", "field").orderBy("most", "term")
    first = kth_scores(sums_of(rarest(asked), postings), k)
    ranked = asked.withColumn("below", F.sum("most").over(by_most)).join(first, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
    ranked.write.mode("overwrite").parquet(f"{scratch}/ranked")
    ranked = spark.read.parquet(f"{scratch}/ranked")
    leads, rest = ranked.filter("below >= bound").select(asked.columns), ranked.filter("below < bound")
    sums_of(leads, postings).write.mode("overwrite").parquet(f"{scratch}/led")
    led = spark.read.parquet(f"{scratch}/led")
    # most of a score is in the leads, so their k-th best is a better bound
    more = rest.groupBy("query_id", "field").agg(F.max("below").alias("more"))
    found = led.join(more, ["query_id", "field"], "left").join(kth_scores(led, k), "query_id", "left")
    found = found.filter(F.col("bound").isNull() | (F.col("s") + F.coalesce("more", F.lit(0.0)) >= F.col("bound"))).select("query_id", "field", "chunk_id", "s")
    found.write.mode("overwrite").parquet(f"{scratch}/found")
    found = spark.read.parquet(f"{scratch}/found")
    # the other terms, only in chunks that were found
    held = postings.select("bucket", "field", "term", "chunk_id", "tf", "dl").join(rest.select("bucket", "field", "term").distinct(), ["bucket", "field", "term"], "left_semi")
    met = found.select("query_id", "field", "chunk_id").join(held, ["field", "chunk_id"]).join(rest.select("query_id", "field", "term", "idf", "boost", "mean"), ["query_id", "field", "term"])
    more = met.select("query_id", "field", "chunk_id", (F.col("boost") * F.col("idf") * weight(F.col("tf"), F.col("dl"), F.col("mean"))).alias("s"))
    whole = found.unionByName(more).groupBy("query_id", "field", "chunk_id").agg(F.sum("s").alias("score")).select("query_id", "chunk_id", "score")
    return whole.unionByName(keyword_hits(index, requests)).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))

"""Retrieval over chunks: term and vector search, fusion, filters, reading neighbours and pages, contents lookup.

Requests come as tables, so a batch of queries is one job. Request tables are joined by broadcast only after their size
is known to be small (``small``); otherwise Spark joins them by a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackmill.functions import text as T
from stackmill.operators import batchsearch, requests, structure, termindex
from stackmill.plans import views
from stackmill.plans.views import with_views

#: BM25, fusion, field boosts, result sizes, token budget of a read.
K1, B, RRF_K = 1.2, 0.75, 60
BOOSTS = {"text": 3.0, "caption": 2.0, "section": 2.0, "name": 1.0}
RETRIEVE_K, FINAL_K = 10, 3
READ_BUDGET, CHUNK_COST = 6000, 80
#: Rows of a request table up to which it is broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """The frame marked for broadcast if it has at most SMALL_ROWS rows."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def few_hits(hits: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """The ranked ids of hits, at most k a request, marked for broadcast if so many are at most SMALL_ROWS. Only requests are counted."""
    ids = hits.select("query_id", "rank", "chunk_id")
    most = SMALL_ROWS // k
    return F.broadcast(ids) if requests.limit(most + 1).count() <= most else ids


# --- chunks and postings ---------------------------------------------------------------------------------------------


def chunk(docs: DataFrame) -> DataFrame:
    """B25. doc_id, text -> doc_id, chunk_id, chunk_index, offset, text. The splitter is the one sequential step."""
    pieces = docs.select("doc_id", F.posexplode(T.chunk_pieces("text")).alias("chunk_index", "p"))
    return pieces.select("doc_id", (F.col("doc_id") * 16777216 + F.col("chunk_index")).alias("chunk_id"), "chunk_index", F.col("p.offset").alias("offset"), F.col("p.text").alias("text"))


def postings(chunks: DataFrame, field: str = "text") -> DataFrame:
    """A8. field, term, chunk_id, tf, positions (from 0, in order)."""
    tokens = chunks.select("chunk_id", F.posexplode(T.terms(F.col(field))).alias("pos", "term"))
    return tokens.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")).withColumn("field", F.lit(field))


def bm25(chunks: DataFrame, queries: DataFrame, field: str = "text") -> DataFrame:
    """query_id, chunk_id, score of one analysed field. Only postings of query terms are aggregated: terms are matched
    where the chunk is tokenised, before any shuffle."""
    asked = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))
    tokens = chunks.select("chunk_id", T.terms(F.col(field)).alias("ts")).withColumn("dl", F.size("ts"))
    totals = tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    words = small(asked.select("term").distinct())
    tf = tokens.select("chunk_id", "dl", F.explode("ts").alias("term")).join(words, "term").groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.withColumn("part", part).join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))


def keyword_field(chunks: DataFrame, queries: DataFrame, field: str) -> DataFrame:
    """A whole-string field scores its idf-free constant 1 where it equals the query."""
    q = small(queries.select("query_id", "query"))
    return chunks.join(q, chunks[field] == q["query"]).select("query_id", "chunk_id", F.lit(1.0).alias("score"))


def best_fields(scores: dict[str, DataFrame], k: int) -> DataFrame:
    """H2. The greatest boosted field score of each chunk; the k best chunks of each query, numbered from 0."""
    parts = [s.select("query_id", "chunk_id", (F.col("score") * BOOSTS[f]).alias("score")) for f, s in scores.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return top_k(union.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("chunk_id"))
    return first_rows(scored, w, k)


def first_rows(df: DataFrame, w, k: int) -> DataFrame:
    """The first k rows of each window, numbered from 0. The plain bound on row_number lets each task cut its rows first."""
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """H3. Phrase in text x 3, phrase in caption x 2 and all terms in text x 1, by occurrence; scores add. A request meets
    only the chunks that have the rarest of its terms, since all terms have to be there."""
    few = queries.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    asked = queries.select("query_id", T.terms(F.col("query")).alias("qs")).filter(F.size("qs") > 0)
    each = asked.select("query_id", F.explode(F.array_distinct("qs")).alias("term"))
    spaced = lambda ts: F.concat(F.lit(" "), F.array_join(ts, " "), F.lit(" "))

    def met(field: str) -> DataFrame:
        tokens = chunks.select("chunk_id", T.terms(F.col(field)).alias("ts"))
        words = each.select("term").distinct()
        df = tokens.select(F.explode(F.array_distinct("ts")).alias("term")).join(F.broadcast(words) if few else words, "term").groupBy("term").agg(F.count("*").alias("df"))
        rare = each.join(df, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term")).join(asked, "query_id")
        placed = tokens.select("chunk_id", "ts", F.explode(F.array_distinct("ts")).alias("term"))
        found = placed.join(F.broadcast(rare) if few else rare, "term")
        return found.withColumn("every", F.size(F.array_except("qs", "ts")) == 0).withColumn("phrase", F.contains(spaced(F.col("ts")), spaced(F.col("qs"))))

    text, caption = met("text"), met("caption").filter("phrase").select("query_id", "chunk_id", F.lit(2.0).alias("score"))
    scored = text.filter("every").select("query_id", "chunk_id", F.when(F.col("phrase"), 4.0).otherwise(1.0).alias("score"))
    return top_k(scored.unionByName(caption).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score")), k)


# --- vectors -----------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """G4. In double; 0 where a vector is empty or has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))


def vector_top_k(vectors: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """H1. chunk_id, embedding x query_id, vector: exact cosine, the k best of each query. Every vector meets the
    broadcast block of requests; only k rows a task and query are shuffled."""
    unit = lambda v: F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: F.try_divide(x.cast("double"), n))), 1)
    left = vectors.select("chunk_id", unit(F.col("embedding")).alias("embedding"))
    right = requests.select("query_id", unit(F.col("vector")).alias("vector"))
    scored = left.crossJoin(small(right)).select("query_id", "chunk_id", F.coalesce(dot(F.col("embedding"), F.col("vector")), F.lit(0.0)).alias("score"))
    return top_k(scored, k)


def rrf(lists: DataFrame, k: int, c: int = RRF_K) -> DataFrame:
    """H4. query_id, list_no, rank (from 0), chunk_id -> fused score and rank; equal scores keep the order first seen."""
    fused = lists.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (c + F.col("rank") + 1)).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "seen", "chunk_id")
    return first_rows(fused, w, k).drop("seen")


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, k: int) -> DataFrame:
    """H5. Fused where a query has text hits; else the vector hits with their own scores."""
    both = vector_hits.select("query_id", F.lit(0).alias("list_no"), "rank", "chunk_id").unionByName(text_hits.select("query_id", F.lit(1).alias("list_no"), "rank", "chunk_id"))
    with_text = text_hits.select("query_id").distinct()
    fused = rrf(both.join(with_text, "query_id", "left_semi"), k).withColumn("score_kind", F.lit("rrf"))
    plain = vector_hits.join(with_text, "query_id", "left_anti").filter(F.col("rank") < k).withColumn("score_kind", F.lit("cosine"))
    return fused.select("query_id", "rank", "chunk_id", "score", "score_kind").unionByName(plain.select("query_id", "rank", "chunk_id", "score", "score_kind"))


# --- filters -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ChunkFilter:
    """F1. Absent predicates are no constraint; an empty document scope admits nothing."""

    document_ids: tuple | None = None
    asset_types: tuple[str, ...] = ()
    page_gte: int | None = None
    page_lte: int | None = None
    section_prefix: str | None = None
    section_contains: str | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        if self.document_ids is not None:
            out = out & F.col("doc_id").isin(list(self.document_ids))
        if self.asset_types:
            out = out & F.coalesce(F.arrays_overlap("asset_types", F.array(*map(F.lit, self.asset_types))), F.lit(False))
        if self.page_gte is not None:
            out = out & F.coalesce(F.col("page") >= self.page_gte, F.lit(False))
        if self.page_lte is not None:
            out = out & F.coalesce(F.col("page") <= self.page_lte, F.lit(False))
        section = F.coalesce(F.col("section"), F.lit(""))
        if self.section_prefix:
            out = out & section.startswith(self.section_prefix)
        if self.section_contains:
            out = out & section.contains(self.section_contains)
        return out

    def broad(self) -> "ChunkFilter":
        """F5. Only the documents."""
        return ChunkFilter(document_ids=self.document_ids)

    def within(self, scope: tuple | None) -> "ChunkFilter":
        """F4. The documents cut to the scope."""
        if scope is None:
            return self
        ids = scope if self.document_ids is None else tuple(d for d in self.document_ids if d in set(scope))
        return ChunkFilter(ids, self.asset_types, self.page_gte, self.page_lte, self.section_prefix, self.section_contains)


def relaxed(strict: DataFrame, broad: DataFrame) -> DataFrame:
    """H7. Strict hits, and the broad ones of queries without any."""
    return strict.withColumn("relaxed", F.lit(False)).unionByName(broad.join(strict.select("query_id").distinct(), "query_id", "left_anti").withColumn("relaxed", F.lit(True)))


def merge_batch(hits: DataFrame) -> DataFrame:
    """H11. run, branch, rank, chunk_id, score: each chunk once, in first-seen order, with its greatest score."""
    merged = hits.groupBy("run", "chunk_id").agg(F.min(F.struct("branch", "rank")).alias("seen"), F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy("seen")) - 1).drop("seen")


def annotate_duplicates(hits: DataFrame) -> DataFrame:
    """H12. dup_of: the first branch that has the chunk, for its later occurrences."""
    w = Window.partitionBy("run", "chunk_id").orderBy("branch", "rank")
    return hits.withColumn("dup_of", F.when(F.row_number().over(w) > 1, F.first("branch").over(w)))


# --- reading -----------------------------------------------------------------------------------------------------------


def neighbours(chunks: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """H13. Chunks of the anchor's document at most so many places away: the wanted places are enumerated, so this is an equi join."""
    want = anchors.select("doc_id", F.col("chunk_index").alias("anchor"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - before), F.col("chunk_index") + after)).alias("chunk_index"))
    return chunks.join(small(want), ["doc_id", "chunk_index"])


def limit_tokens(rows: DataFrame, budget: int = READ_BUDGET) -> DataFrame:
    """H16. query_id, rank, text: whole chunks while their running cost stays in the budget, the first one always."""
    w = Window.partitionBy("query_id").orderBy("rank")
    used = rows.withColumn("cost", T.token_estimate(F.col("text")) + CHUNK_COST).withColumn("used", F.sum("cost").over(w))
    flagged = used.withColumn("over", ((F.col("used") > budget) & (F.row_number().over(w) > 1)).cast("int"))
    return flagged.withColumn("cut", F.max("over").over(w)).filter("cut = 0").drop("over", "cut")


def toc_scores(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """H18. requests: query_id, chapter (null: none), terms. 100 for the chapter-th entry of level 1 and its equals; else 10 and the
    length of each term in title or path, and 5 if it is in the title; without any signal 1 for level 1, else 0.2 over the
    level. Only positive scores."""
    ranked = entries.withColumn("nth", F.when(F.col("level") == 1, F.sum((F.col("level") == 1).cast("int")).over(Window.partitionBy("doc_id").orderBy("ord"))))
    pairs = ranked.crossJoin(small(requests))
    # entries are placed by document already, so this window moves nothing
    chapter = F.max(F.when(F.col("nth") == F.col("chapter"), F.struct("title", "path"))).over(Window.partitionBy("query_id", "doc_id"))
    rows = pairs.withColumn("c", chapter).withColumn("c_title", F.col("c.title")).withColumn("c_path", F.col("c.path"))
    hay = F.lower(F.concat_ws(" ", "title", "path"))
    part = lambda t: F.when(F.contains(hay, F.lower(t)), 10.0 + F.length(t)).otherwise(0.0) + F.when(F.contains(F.lower(F.col("title")), F.lower(t)), 5.0).otherwise(0.0)
    terms = F.aggregate(F.filter("terms", lambda t: t != ""), F.lit(0.0), lambda a, t: a + part(t))
    none = F.col("chapter").isNull() & (F.size("terms") == 0)
    hit = (F.col("title") == F.col("c_title")) | (F.col("path") == F.col("c_path"))
    score = F.when(F.coalesce(hit, F.lit(False)), 100.0).when(none & (F.col("level") == 1), 1.0).when(none, 0.2 / F.col("level")).otherwise(terms)
    return rows.withColumn("score", score).filter("score > 0").select("query_id", "doc_id", "ord", "path", "start_page", "score")


def toc_lookup(scores: DataFrame, k: int) -> DataFrame:
    """H19. The best entry of each (document, path), then the k best of each query."""
    one = Window.partitionBy("query_id", "doc_id", "path").orderBy(F.desc("score"), "ord")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "ord")
    return first_rows(scores.withColumn("n", F.row_number().over(one)).filter("n = 1").drop("n"), w, k)


# --- queries -----------------------------------------------------------------------------------------------------------


def described(chunks: DataFrame) -> DataFrame:
    """Chunks with a page (four chunks a page), a section (null for every third page), a caption and asset types."""
    page = views.int_div(F.col("chunk_index"), 4) + 1
    return chunks.select(
        "*", page.alias("page"), F.when(page % 3 != 0, F.concat(F.lit("Part "), page.cast("string"))).alias("section"),
        F.substring_index("text", " ", 5).alias("caption"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        F.when(F.col("chunk_index") % 2 == 0, F.array(F.lit("figure"))).when(F.col("chunk_index") % 5 == 1, F.array(F.lit("figure"), F.lit("table"))).otherwise(F.array().cast("array<string>")).alias("asset_types"),
    )


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(chunk(views.table(spark, sf_dir, "documents")))


def _vectors(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 16777216).alias("chunk_id"), "embedding")


def _vector_requests(spark, sf_dir):
    """Every vector whose id is divisible by 50."""
    return views.table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _vector_hits(spark, sf_dir, k):
    """The hits of all vector requests, by products of blocks; for too many requests as h01 has them, which runs no Python."""
    scored = batchsearch.nearest(_vectors(spark, sf_dir), _vector_requests(spark, sf_dir), k, SMALL_ROWS)
    return vector_top_k(_vectors(spark, sf_dir), _vector_requests(spark, sf_dir), k) if scored is None else top_k(scored, k)


#: Stored indexes of this process: by session and table, the state of the files and the index.
_STORED: dict[tuple, tuple] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> termindex.TermIndex:
    """A8. The index of the documents' chunks, written once and again only when files of the table have changed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    status = lambda p: hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop(p))
    state = tuple((f, (s := status(f)).getLen(), s.getModificationTime()) for f in sorted(views.table(spark, sf_dir, "documents").inputFiles()))
    key = (spark.sparkContext.applicationId, sf_dir)
    if _STORED.get(key, (None,))[0] != state:
        _STORED[key] = state, termindex.write(_chunks(spark, sf_dir), views.scratch(spark))
    return _STORED[key][1]


def best_text(chunks: DataFrame, queries: DataFrame, k: int, parts: tuple[Column | None, ...] = (None,)) -> list[DataFrame]:
    """The k best chunks of each request by their text alone, for each part of the chunks (a condition; None: all)."""
    m = batchsearch.matched(chunks, queries, views.scratch(queries.sparkSession), {"text": 1.0}, parts=parts)
    return [top_k(bm25(chunks if p is None else chunks.filter(p), queries) if m is None else batchsearch.best(m, k, i), k) for i, p in enumerate(parts)]


def matched_fields(spark, sf_dir) -> batchsearch.Matched | None:
    """What the documents' chunks share with the text requests, in all fields."""
    return batchsearch.matched(_chunks(spark, sf_dir), views.queries(spark, sf_dir), views.scratch(spark), termindex.ANALYSED, keywords=True)


def _text_hits(spark, sf_dir, k, m: batchsearch.Matched | None = None):
    """The hits of all text requests, at hand: they may be read more than once. Requests that are too many for one pass read the index."""
    m = m or matched_fields(spark, sf_dir)
    hits = top_k(termindex.search(stored_index(spark, sf_dir), views.queries(spark, sf_dir), k, views.scratch(spark)) if m is None else batchsearch.best(m, k), k)
    return kept(hits)


def kept(df: DataFrame) -> DataFrame:
    """The frame written and read again."""
    path = views.scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def hit_documents(spark, sf_dir, hits: DataFrame) -> DataFrame:
    """The documents that have a hit."""
    return views.table(spark, sf_dir, "documents").join(small(hits.select(F.shiftright("chunk_id", 24).alias("doc_id")).distinct()), "doc_id", "left_semi")


def hit_chunks(spark, sf_dir, hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank and the chunk of every hit (at most k a request); only documents that have a hit are cut."""
    return described(chunk(hit_documents(spark, sf_dir, hits))).join(few_hits(hits, views.queries(spark, sf_dir), k), "chunk_id")


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def a08_postings(spark, sf_dir):
    p = postings(_chunks(spark, sf_dir))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum(F.col("positions")[0]).alias("first_positions"))


def b25_chunks(spark, sf_dir):
    return chunk(views.table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "offset", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def f01_chunk_filter(spark, sf_dir):
    f = ChunkFilter(asset_types=("table",), page_gte=2, page_lte=8, section_prefix="Part", section_contains="t")
    return _chunks(spark, sf_dir).filter(f.condition()).select("chunk_id", "page", "section")


def f02_metadata_filter(spark, sf_dir):
    """Within a scope of documents, which is a table: here those in English."""
    scope = views.table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")
    f = ChunkFilter(asset_types=("figure", "table"), page_lte=2)
    return _chunks(spark, sf_dir).filter(f.condition()).join(scope, "doc_id", "left_semi").select("chunk_id", "page")


def h01_vector_topk(spark, sf_dir):
    return _out(vector_top_k(_vectors(spark, sf_dir), _vector_requests(spark, sf_dir), RETRIEVE_K))


def h02_bm25(spark, sf_dir):
    return _out(_text_hits(spark, sf_dir, RETRIEVE_K))


def h03_keyword_search(spark, sf_dir):
    return _out(keyword_search(_chunks(spark, sf_dir), views.queries(spark, sf_dir), RETRIEVE_K))


def h04_rrf(spark, sf_dir):
    lists = _vector_hits(spark, sf_dir, 10).select("query_id", F.lit(0).alias("list_no"), "rank", "chunk_id").unionByName(_text_hits(spark, sf_dir, 10).select("query_id", F.lit(1).alias("list_no"), "rank", "chunk_id"))
    return rrf(lists, FINAL_K).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


def h05_hybrid(spark, sf_dir):
    return hybrid(_vector_hits(spark, sf_dir, 10), _text_hits(spark, sf_dir, 10), FINAL_K).withColumn("score", F.round("score", 6))


def h07_relaxation(spark, sf_dir):
    c, q = _chunks(spark, sf_dir), views.queries(spark, sf_dir)
    f = ChunkFilter(asset_types=("table",), page_gte=3)
    strict, broad = best_text(c, q, FINAL_K, (f.condition(), f.broad().condition()))
    return relaxed(kept(strict), broad).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "relaxed")


def _batch(spark, sf_dir):
    hits = _text_hits(spark, sf_dir, 10)
    return hits.select(views.int_div(F.col("query_id"), 150).alias("run"), (views.int_div(F.col("query_id"), 50) % 3).alias("branch"), "rank", "chunk_id", F.round("score", 6).alias("score"))


def h11_merge_batch(spark, sf_dir):
    return merge_batch(_batch(spark, sf_dir))


def h12_duplicates(spark, sf_dir):
    return annotate_duplicates(_batch(spark, sf_dir)).drop("score")


def h13_neighbours(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    anchors = c.filter("chunk_index = 3").select("doc_id", "chunk_index")
    return neighbours(c, anchors, 1, 2).select("doc_id", "anchor", "chunk_id")


def h14_read_pages(spark, sf_dir):
    c = _chunks(spark, sf_dir).filter("page between 2 and 4")
    w = Window.partitionBy("doc_id").orderBy("name", "chunk_index")
    return c.withColumn("n", F.row_number().over(w)).filter("n > 2 and n <= 8").select("doc_id", "chunk_id", "page", "n")


def h15_read_section(spark, sf_dir):
    """Pages 1 to 12 of every document in portions of 30: the second portion, whether more follows, and the soft section filter."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    rows = _chunks(spark, sf_dir).filter("page between 1 and 12").withColumn("n", F.row_number().over(w) - 1).withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    part = rows.filter("n >= 30 and n < 60").withColumn("hit", F.col("section").isNull() | F.col("section").contains("Part 1"))
    kept = part.withColumn("any", F.max(F.col("hit").cast("int")).over(Window.partitionBy("doc_id"))).filter("hit or any = 0")
    return kept.select("doc_id", "chunk_id", (F.col("total") > 60).alias("has_more"), F.when(F.col("total") > 60, 60).alias("next_offset"))


def h16_token_budget(spark, sf_dir):
    return limit_tokens(_chunks(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("chunk_index").alias("rank"), "text"), 1000).select("query_id", "rank", "cost", "used")


def _toc_requests(spark, sf_dir):
    return requests.toc_requests(requests.questions(spark, sf_dir))


def h18_toc_scores(spark, sf_dir):
    return toc_scores(structure._entries(spark, sf_dir), _toc_requests(spark, sf_dir)).select("query_id", "doc_id", "ord", F.round("score", 6).alias("score"))


def h19_toc_lookup(spark, sf_dir):
    return toc_lookup(toc_scores(structure._entries(spark, sf_dir), _toc_requests(spark, sf_dir)), FINAL_K).select("query_id", "rank", "doc_id", "path", F.round("score", 6).alias("score"))


def h21_outline(spark, sf_dir):
    """First 80 entries of each document, indented by level, with a note on what is left out."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    e = structure._entries(spark, sf_dir).withColumn("n", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    line = F.concat(F.repeat(F.lit("  "), F.col("level").cast("int") - 1), F.lit("- "), "title", F.lit(" (p."), F.col("start_page").cast("string"), F.lit(")"))
    out = e.filter("n <= 80").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("o"), F.max("total").alias("total"))
    return out.select("doc_id", F.md5(F.concat("o", F.when(F.col("total") > 80, F.concat(F.lit("\n… "), (F.col("total") - 80).cast("string"))).otherwise(""))).alias("outline_md5"), "total")


def h22_asset_lookup(spark, sf_dir):
    """Chunks of assets by number and kind, at most five a request, in order of document and chunk."""
    a = views.assets(spark, sf_dir).filter("figure_number is not null")
    asked = spark.range(1, 10).select(F.col("id").alias("query_id"), F.concat(F.lit("Fig. 0"), F.col("id").cast("string"), F.lit(" - 1")).alias("raw"))
    asked = asked.withColumn("p", T.asset_number(F.col("raw"))).select("query_id", F.col("p.kind").alias("kind"), F.col("p.number").alias("figure_number"))
    hits = a.join(small(asked), ["kind", "figure_number"]).select("query_id", "doc_id", "asset_id").distinct()
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "asset_id"))).filter("n <= 5")


def e11_context(spark, sf_dir):
    """Header and text of each query's hits in rank order."""
    return _context(hit_chunks(spark, sf_dir, _text_hits(spark, sf_dir, FINAL_K), FINAL_K)).select("query_id", "n_chunks", F.md5("context").alias("context_md5"))


def _context(loaded: DataFrame) -> DataFrame:
    head = T.chunk_header(F.col("name"), F.col("page"), F.col("section"), F.array_sort(F.array_distinct("asset_types")), F.size("asset_types") > 0)
    one = F.concat(head, F.lit("\n"), "text")
    return loaded.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", one.alias("c")))), lambda x: x["c"]), "\n\n---\n\n").alias("context"), F.count("*").alias("n_chunks"))


def x1_hybrid_search(spark, sf_dir):
    """Flagship: vector and text search of every request, fused, loaded and put into a context."""
    hits = kept(hybrid(_vector_hits(spark, sf_dir, RETRIEVE_K), _text_hits(spark, sf_dir, RETRIEVE_K), FINAL_K))
    return _context(hit_chunks(spark, sf_dir, hits, FINAL_K)).select("query_id", "n_chunks", F.md5("context").alias("context_md5"))


def h25_fallback(spark, sf_dir):
    """Requests without evidence, with a message."""
    c, q = _chunks(spark, sf_dir), views.queries(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 3 == 0, "zzzz qqqq").otherwise(F.col("query")))
    found = bm25(c, q).select("query_id").distinct()
    return q.join(found, "query_id", "left_anti").select("query_id", F.lit("No relevant content was found.").alias("message"))


QUERIES = {f.__name__: f for f in (
    a08_postings, b25_chunks, f01_chunk_filter, f02_metadata_filter, h01_vector_topk, h02_bm25, h03_keyword_search, h04_rrf, h05_hybrid, h07_relaxation, h11_merge_batch, h12_duplicates,
    h13_neighbours, h14_read_pages, h15_read_section, h16_token_budget, h18_toc_scores, h19_toc_lookup, h21_outline, h22_asset_lookup, h25_fallback, e11_context, x1_hybrid_search,
)}

_CUT = "CASE WHEN e >= n THEN -1 WHEN contains(w, chr(10)) THEN h + length(w) - strpos(reverse(w), chr(10)) WHEN contains(w, '。') THEN h + length(w) - strpos(reverse(w), '。') WHEN contains(w, '. ') THEN h + length(w) - strpos(reverse(w), ' .') - 1 ELSE -1 END"
_STEP = f"(SELECT doc_id, t, n, s, e, CASE WHEN ({_CUT}) >= 0 THEN ({_CUT}) + 1 ELSE e END AS f FROM (SELECT *, s + 250 AS h, substr(t, s + 251, e - s - 250) AS w FROM (SELECT doc_id, t, n, s, least(s + 500, n) AS e FROM {{src}})))"
_CHUNK_CTES = {
    "c0": rf"SELECT doc_id, t, length(t) AS n, 0 AS s FROM (SELECT doc_id, trim(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), E' \t\n\r') AS t FROM documents) WHERE length(t) > 0",
    "c1": f"SELECT * FROM {_STEP.format(src='c0')} UNION ALL SELECT * FROM {_STEP.format(src='(SELECT doc_id, t, n, greatest(f - 80, s + 1) AS s FROM c1 WHERE f < n)')}",
    "c2": r"SELECT doc_id, s, trim(substr(t, s + 1, f - s), E' \t\n\r') AS text FROM c1",
    "c3": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, s AS \"offset\", text FROM c2 WHERE text <> ''",
    "c4": "SELECT *, doc_id * 16777216 + chunk_index AS chunk_id, (chunk_index // 4 + 1)::INT AS page FROM c3",
    "ch": """SELECT *, CASE WHEN page % 3 <> 0 THEN 'Part ' || page END AS section, array_to_string(string_split(text, ' ')[1:5], ' ') AS caption, 'doc-' || doc_id AS name,
      CASE WHEN chunk_index % 2 = 0 THEN ['figure'] WHEN chunk_index % 5 = 1 THEN ['figure', 'table'] ELSE []::VARCHAR[] END AS asset_types FROM c4""",
}
_TERMS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _bm25_sql(source: str, queries: str, field: str) -> str:
    return f"""(WITH t AS (SELECT chunk_id, {_TERMS.format(field)} AS ts FROM {source}), a AS (SELECT DISTINCT query_id, unnest({_TERMS.format('query')}) AS term FROM {queries}),
      g AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t), f AS (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM t),
      tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM f WHERE term IN (SELECT term FROM a) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
      SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN a USING (term), g GROUP BY ALL)"""


_TOPK = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM ({0})) WHERE rank < {1}"
_TEXT_SCORES = f"""SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id, chunk_id, 3.0 * score AS score FROM {_bm25_sql('ch', 'v_queries', 'text')} UNION ALL SELECT query_id, chunk_id, 2.0 * score FROM {_bm25_sql('ch', 'v_queries', 'caption')}
  UNION ALL SELECT query_id, chunk_id, 2.0 FROM ch JOIN v_queries ON section = query UNION ALL SELECT query_id, chunk_id, 1.0 FROM ch JOIN v_queries ON name = query) GROUP BY ALL"""
_VEC_SCORES = "SELECT q.vec_id AS query_id, e.vec_id * 16777216 AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0"
_HITS = {"th": _TOPK.format(_TEXT_SCORES, 10), "vh": _TOPK.format(_VEC_SCORES, 10)}


def _fuse(src: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, l, r, chunk_id) - 1 AS rank FROM
      (SELECT query_id, chunk_id, sum(1.0 / (61 + rank)) AS score, min(list_no) AS l, arg_min(rank, list_no) AS r FROM {src} GROUP BY ALL)) WHERE rank < 3"""


_LISTS = "(SELECT query_id, 0 AS list_no, rank, chunk_id FROM vh UNION ALL SELECT query_id, 1, rank, chunk_id FROM {0})"
_BATCH = "SELECT (query_id // 150)::INT AS run, ((query_id // 50) % 3)::INT AS branch, rank, chunk_id, round(score, 6) AS score FROM th"
_CONTEXT = """SELECT query_id, count(*) AS n_chunks, md5(string_agg(name || ' p.' || page || coalesce(' §' || section, '') || CASE WHEN len(asset_types) > 0 THEN ' assets=' || array_to_string(asset_types, ',') || ' (visual)' ELSE '' END || chr(10) || text,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM {0} JOIN ch USING (chunk_id) GROUP BY query_id"""
_ENTRIES = {"e": structure._INTERVALS, "q": structure._PATHS, "x": "SELECT e.*, q.path FROM e JOIN q USING (doc_id, ord)"}
_TOC = {**_ENTRIES, **requests.TOC_REQUESTS,
    "n": "SELECT *, CASE WHEN level = 1 THEN sum((level = 1)::INT) OVER (PARTITION BY doc_id ORDER BY ord) END AS nth FROM x",
    "c": "SELECT query_id, doc_id, title AS ct, path AS cp FROM n, rq WHERE nth = chapter",
    "sc": """SELECT query_id, doc_id, ord, path, CASE WHEN coalesce(title = ct OR path = cp, false) THEN 100.0 WHEN chapter IS NULL AND len(terms) = 0 THEN CASE WHEN level = 1 THEN 1.0 ELSE 0.2 / level END
      ELSE coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(title || ' ' || path), lower(t)) THEN 10.0 + length(t) ELSE 0 END + CASE WHEN contains(lower(title), lower(t)) THEN 5.0 ELSE 0 END)), 0) END AS score
      FROM n CROSS JOIN rq LEFT JOIN c USING (query_id, doc_id)"""}


def _sql(body: str, *names: str, more: dict | None = None, chunks: bool = True) -> str:
    return with_views("v_queries", *names, body=body, more={**(_CHUNK_CTES if chunks else {}), **(more or {})})


_KW = {"kq": "SELECT query_id, query FROM v_queries",
    "ka": f"SELECT query_id, unnest({_TERMS.format('query')}) AS term, generate_subscripts({_TERMS.format('query')}, 1) - 1 AS qpos FROM kq",
    "kn": "SELECT query_id, count(*) AS nt, count(DISTINCT term) AS nd FROM ka GROUP BY query_id"}
for _f in ("text", "caption"):
    _KW[f"k_{_f}"] = f"SELECT chunk_id, unnest({_TERMS.format(_f)}) AS term, generate_subscripts({_TERMS.format(_f)}, 1) - 1 AS pos FROM ch"
    _KW[f"p_{_f}"] = f"SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, chunk_id, pos - qpos AS at, count(*) AS m FROM k_{_f} JOIN ka USING (term) GROUP BY ALL) JOIN kn USING (query_id) WHERE m = nt"

ORACLES = {
    "a08_postings": _sql(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, sum(p)::BIGINT AS first_positions FROM (SELECT term, chunk_id, count(*) AS tf, min(pos) AS p FROM (SELECT chunk_id, unnest({_TERMS.format('text')}) AS term, generate_subscripts({_TERMS.format('text')}, 1) - 1 AS pos FROM ch) GROUP BY ALL) GROUP BY term"),
    "b25_chunks": _sql('SELECT doc_id, chunk_index, "offset", length(text) AS n_chars, md5(text) AS text_md5 FROM c3'),
    "f01_chunk_filter": _sql("SELECT chunk_id, page, section FROM ch WHERE list_contains(asset_types, 'table') AND page BETWEEN 2 AND 8 AND starts_with(section, 'Part') AND contains(section, 't')"),
    "f02_metadata_filter": _sql("SELECT chunk_id, page FROM ch WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND len(asset_types) > 0 AND page <= 2"),
    "h01_vector_topk": f"SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ({_TOPK.format(_VEC_SCORES, 10)})",
    "h02_bm25": _sql("SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM th", more={"th": _HITS["th"]}),
    "h03_keyword_search": _sql("SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (" + _TOPK.format("SELECT query_id, chunk_id, sum(score) AS score FROM (SELECT query_id, chunk_id, 3.0::DOUBLE AS score FROM p_text UNION ALL SELECT query_id, chunk_id, 2.0 FROM p_caption UNION ALL SELECT query_id, chunk_id, 1.0 FROM (SELECT query_id, chunk_id, count(DISTINCT term) AS m FROM k_text JOIN ka USING (term) GROUP BY ALL) JOIN kn USING (query_id) WHERE m = nd) GROUP BY ALL", 10) + ")", more=_KW),
    "h04_rrf": _sql(f"SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM ({_fuse(_LISTS.format('th'))})", more=_HITS),
    "h05_hybrid": _sql(f"SELECT query_id, rank, chunk_id, round(score, 6) AS score, 'rrf' AS score_kind FROM ({_fuse('(SELECT * FROM ' + _LISTS.format('tx') + ' WHERE query_id IN (SELECT query_id FROM tx))')}) UNION ALL SELECT query_id, rank, chunk_id, round(score, 6), 'cosine' FROM vh WHERE rank < 3 AND query_id NOT IN (SELECT query_id FROM tx)", more={**_HITS, "tx": "SELECT * FROM th"}),
    "h07_relaxation": _sql("SELECT query_id, rank, chunk_id, round(score, 6) AS score, false AS relaxed FROM st UNION ALL SELECT query_id, rank, chunk_id, round(score, 6), true FROM br WHERE query_id NOT IN (SELECT query_id FROM st)", more={
        "nc": "SELECT * FROM ch WHERE list_contains(asset_types, 'table') AND page >= 3", "ev": "SELECT * FROM v_queries", "st": _TOPK.format("SELECT * FROM " + _bm25_sql("nc", "ev", "text"), 3), "br": _TOPK.format("SELECT * FROM " + _bm25_sql("ch", "v_queries", "text"), 3)}),
    "h11_merge_batch": _sql("SELECT run, chunk_id, score, row_number() OVER (PARTITION BY run ORDER BY seen) - 1 AS rank FROM (SELECT run, chunk_id, min(branch * 1000 + rank) AS seen, max(score) AS score FROM b GROUP BY ALL)", more={"th": _HITS["th"], "b": _BATCH}),
    "h12_duplicates": _sql("SELECT run, branch, rank, chunk_id, CASE WHEN row_number() OVER w > 1 THEN first_value(branch) OVER w END AS dup_of FROM b WINDOW w AS (PARTITION BY run, chunk_id ORDER BY branch, rank)", more={"th": _HITS["th"], "b": _BATCH}),
    "h13_neighbours": _sql("SELECT c.doc_id, a.chunk_index AS anchor, c.chunk_id FROM ch a JOIN ch c ON a.doc_id = c.doc_id AND c.chunk_index BETWEEN 2 AND 5 WHERE a.chunk_index = 3"),
    "h14_read_pages": _sql("SELECT doc_id, chunk_id, page, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY name, chunk_index) AS n FROM ch WHERE page BETWEEN 2 AND 4) WHERE n > 2 AND n <= 8"),
    "h15_read_section": _sql("SELECT doc_id, chunk_id, total > 60 AS has_more, CASE WHEN total > 60 THEN 60 END AS next_offset FROM (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id) AS a FROM (SELECT *, section IS NULL OR contains(section, 'Part 1') AS hit FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM ch WHERE page BETWEEN 1 AND 12) WHERE n >= 30 AND n < 60)) WHERE hit OR a = 0"),
    "h16_token_budget": _sql("SELECT query_id, rank, cost, used FROM (SELECT *, max((used > 1000 AND rn > 1)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS cut FROM (SELECT doc_id AS query_id, chunk_index AS rank, cost, sum(cost) OVER (PARTITION BY doc_id ORDER BY chunk_index)::BIGINT AS used, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS rn FROM (SELECT *, greatest(1, (length(text) + 3) // 4)::INT + 80 AS cost FROM ch))) WHERE cut = 0"),
    "h18_toc_scores": _sql("SELECT query_id, doc_id, ord, round(score, 6) AS score FROM sc WHERE score > 0", "v_toc", "v_pages", more=_TOC, chunks=False),
    "h19_toc_lookup": _sql("SELECT query_id, rank, doc_id, path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord) - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, path ORDER BY score DESC, ord) AS n FROM sc WHERE score > 0) WHERE n = 1) WHERE rank < 3", "v_toc", "v_pages", more=_TOC, chunks=False),
    "h21_outline": _sql("SELECT doc_id, md5(string_agg(repeat('  ', (level - 1)::INT) || '- ' || title || ' (p.' || start_page || ')', chr(10) ORDER BY ord) FILTER (n <= 80) || CASE WHEN max(total) > 80 THEN chr(10) || '… ' || (max(total) - 80) ELSE '' END) AS outline_md5, max(total) AS total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM e) GROUP BY doc_id", "v_toc", "v_pages", more={"e": structure._INTERVALS}, chunks=False),
    "h22_asset_lookup": with_views("v_assets", body="SELECT * FROM (SELECT query_id, doc_id, asset_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, asset_id) AS n FROM v_assets JOIN (SELECT i AS query_id, 'figure' AS kind, i || '-1' AS figure_number FROM (SELECT unnest(range(1, 10)) AS i)) USING (kind, figure_number)) WHERE n <= 5"),
    "h25_fallback": _sql("SELECT query_id, 'No relevant content was found.' AS message FROM v_queries WHERE query_id % 3 = 0"),
    "e11_context": _sql(_CONTEXT.format("(SELECT * FROM th WHERE rank < 3)"), more={"th": _HITS["th"]}),
    "x1_hybrid_search": _sql(_CONTEXT.format("hy"), more={**_HITS, "hy": f"SELECT query_id, rank, chunk_id FROM ({_fuse('(SELECT * FROM ' + _LISTS.format('th') + ' WHERE query_id IN (SELECT query_id FROM th))')}) UNION ALL SELECT query_id, rank, chunk_id FROM vh WHERE rank < 3 AND query_id NOT IN (SELECT query_id FROM th)"}),
}

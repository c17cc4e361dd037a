"""Chains of operators as single jobs, and corpus-level language profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.functions import text as T
from stackmill.operators import answers as D
from stackmill.operators import search as S
from stackmill.operators import structure as B
from stackmill.operators.evidence import compacted_listing
from stackmill.plans import views
from stackmill.plans.views import with_views

#: Words of a language's profile; fixed values of trace compaction.
PROFILE = 200
OLD_LINES, SHORT_TEXT = 5, 200


def language_profiles(docs: DataFrame, k: int = PROFILE) -> DataFrame:
    """lang, word, weight: the k most frequent words of each language, by share of its words."""
    words = docs.select("lang", F.explode(T.terms(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # totals are aggregated, not windowed: no task holds all words of a language
    totals = words.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("total"))
    ranked = S.first_rows(words, Window.partitionBy("lang").orderBy(F.desc("n"), "word"), k)
    shared = ranked.join(totals, ranked["lang"].eqNullSafe(totals["_lang"])).withColumn("share", F.col("n") / F.col("total"))
    return shared.select("lang", "word", F.round(F.log(1 + 1000 * F.col("share")), 6).alias("weight"))


def detect_language(docs: DataFrame, profiles: DataFrame, default: str = "zh") -> DataFrame:
    """B31. doc_id, detected: the language whose profile words weigh most in a text; the default where none occurs."""
    words = docs.select("doc_id", F.explode(T.terms(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    scores = words.join(S.small(profiles), "word").groupBy("doc_id", "lang").agg(F.round(F.sum(F.col("n") * F.col("weight")), 4).alias("score"))
    best = scores.groupBy("doc_id").agg(F.max_by("lang", F.struct("score", "lang")).alias("detected"))
    return docs.select("doc_id").join(best, "doc_id", "left").withColumn("detected", F.coalesce("detected", F.lit(default)))


def compacted(text: Column, action: Column, recent: Column) -> Column:
    """E16. Recent steps and final answers stay; outlines keep their first lines and a note, listings of searches and readings their
    headers (compacted_listing); other long texts are cut."""
    lines = F.filter(F.split(text, "\n"), lambda x: T.strip(x) != "")
    outline = F.when(F.size(lines) <= OLD_LINES, text).otherwise(
        F.concat(F.lit("（历史步压缩 · list_outline · 共 "), F.size(lines).cast("string"), F.lit(" 行）\n"), F.array_join(F.slice(lines, 1, OLD_LINES), "\n"), F.lit("\n… 省略 "), (F.size(lines) - OLD_LINES).cast("string"), F.lit(" 行；需章节页码请 lookup_toc。"))
    )
    long = F.when(F.length(text) <= SHORT_TEXT, text).otherwise(F.concat(F.substring(text, 1, SHORT_TEXT), F.lit("…（已截断）")))
    return F.when(recent | action.isin("finish", "ask_user"), text).when(action.isin("list_outline", "list_documents"), outline).otherwise(F.coalesce(compacted_listing(text, action), long))


# --- queries -----------------------------------------------------------------------------------------------------------


def b29_chunk_assembly(spark, sf_dir):
    """Pages of a section joined and cut, with a document-wide number and the page of each chunk's start."""
    pages = views.body_blocks(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    placed = B.contiguous_sections(pages.withColumn("section", F.concat(F.lit("s"), views.int_div(F.col("page"), 3).cast("string"))))
    groups = placed.groupBy("doc_id", "group_no", "section").agg(F.sort_array(F.collect_list(F.struct("page", "page_start", "text"))).alias("ps"))
    pieces = groups.select("doc_id", "group_no", "section", "ps", F.posexplode(T.chunk_pieces(F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n"))).alias("k", "c"))
    page = F.element_at(F.filter("ps", lambda p: p["page_start"] <= F.col("c.offset")), -1)["page"]
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("group_no", "k")) - 1
    return pieces.select("doc_id", index.alias("chunk_index"), "section", page.alias("page"), F.length("c.text").alias("n_chars"))


def b31_languages(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    found = detect_language(docs, language_profiles(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("detected")).alias("right"))


def e16_compaction(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    action = F.element_at(F.array(*map(F.lit, ("list_outline", "finish", "other"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select("doc_id", F.md5(compacted(F.col("text"), action, F.col("doc_id") % 7 == 0)).alias("text_md5"))


def h06_retrieve_once(spark, sf_dir):
    """Ten candidates of each request inside its filter, loaded, reranked and cut."""
    from stackmill.operators.layout import rerank

    c = S._chunks(spark, sf_dir).filter(S.ChunkFilter(page_lte=3).condition())
    q = views.queries(spark, sf_dir)
    hits = S.kept(S.best_text(c, q, S.RETRIEVE_K)[0])
    loaded = S.hit_chunks(spark, sf_dir, hits, S.RETRIEVE_K).select("query_id", "rank", "chunk_id", "text")
    return rerank(loaded, q).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def j03_turn_append(spark, sf_dir):
    """A user and an assistant row for each request after the messages there are."""
    c = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("t"))
    new = last.select("conv_id", F.explode(F.array(F.struct((F.col("t") + 1).alias("turn"), F.lit("user").alias("role")), F.struct((F.col("t") + 2).alias("turn"), F.lit("assistant").alias("role")))).alias("m")).select("conv_id", "m.*")
    return c.unionByName(new).groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


def x2_relaxed_batch(spark, sf_dir):
    """Requests of each run, strict then broad, their hits merged with duplicates marked: one job."""
    c = S._chunks(spark, sf_dir)
    q = views.queries(spark, sf_dir)
    f = S.ChunkFilter(asset_types=("table",), page_gte=2)
    strict, broad = S.best_text(c, q, S.FINAL_K, (f.condition(), None))
    both = S.relaxed(S.kept(strict), broad)
    batch = both.select(views.int_div(F.col("query_id"), 150).alias("run"), (views.int_div(F.col("query_id"), 50) % 3).alias("branch"), "rank", "chunk_id", F.round("score", 6).alias("score"), "relaxed")
    marked = S.annotate_duplicates(batch)
    return marked.groupBy("run").agg(F.count("*").alias("raw"), F.count_if(F.col("dup_of").isNull()).alias("unique_hits"), F.count_if(F.col("relaxed")).alias("relaxed"), F.max("score").alias("best"))


def x4_layout_to_chunks(spark, sf_dir):
    """Blocks without margins, joined by page and section, cut into chunks."""
    blocks = views.blocks(spark, sf_dir)
    kept = B.content_blocks(blocks, B.repeated_margin_texts(blocks, views.page_counts(spark, sf_dir)))
    seg = B.segments(kept.withColumn("ord", F.col("block_no")).withColumn("section", F.concat(F.lit("s"), views.int_div(F.col("block_no"), 6).cast("string"))))
    return S.chunk(seg.select((F.col("doc_id") * 268435456 + F.col("page") * 64 + F.col("segment")).alias("doc_id"), "text")).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


def x6_answer_alignment(spark, sf_dir):
    """Answers split, cited, renumbered and aligned with their sources; embeds near a shown table left out."""
    aligned = D.d11_align(spark, sf_dir).join(D.d13_skip_table_embed(spark, sf_dir), ["answer_id", "sentence_index"])
    kept = aligned.filter((F.col("ref") % 2 == 1) | ~F.col("skip"))
    return kept.groupBy("answer_id").agg(F.count("*").alias("n"), F.min("sentence_index").alias("first_sentence")).join(D.d10_renumber(spark, sf_dir).select("answer_id", "used"), "answer_id")


QUERIES = {f.__name__: f for f in (b29_chunk_assembly, b31_languages, e16_compaction, h06_retrieve_once, j03_turn_append, x2_relaxed_batch, x4_layout_to_chunks, x6_answer_alignment)}

_RERANKED = "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) - 1 AS rank FROM (SELECT query_id, {0}.rank AS old, chunk_id, round(len(list_intersect(" + S._TERMS.format("text") + ", " + S._TERMS.format("query") + ")) * 1.0 / len(list_distinct(" + S._TERMS.format("query") + ")), 9)::DOUBLE AS score FROM {0} JOIN ch USING (chunk_id) JOIN v_queries USING (query_id))) WHERE rank < 3"
_cut = lambda source: {**{"c0": S._CHUNK_CTES["c0"].replace("FROM documents", f"FROM {source}")}, **{k: S._CHUNK_CTES[k] for k in ("c1", "c2", "c3")}}
_LINES = r"list_filter(string_split(text, chr(10)), lambda x: trim(x, E' \t\n\r\x0b\x0c') <> '')"

ORACLES = {
    "b31_languages": f"""WITH w AS (SELECT doc_id, lang, unnest({S._TERMS.format('text')}) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
      p AS (SELECT lang, word, round(ln(1 + 1000 * s), 6) AS weight FROM (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS s FROM c) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 200),
      s AS (SELECT doc_id, p.lang, round(sum(n * weight), 4) AS score FROM (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) JOIN p USING (word) GROUP BY ALL),
      b AS (SELECT doc_id, lang AS detected FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) = 1)
      SELECT lang, count(*) AS n, count(*) FILTER (lang = coalesce(detected, 'zh')) AS "right" FROM documents LEFT JOIN b USING (doc_id) GROUP BY lang""",
    "e16_compaction": f"""SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 1 THEN text WHEN doc_id % 3 = 0 THEN CASE WHEN len(l) <= 5 THEN text ELSE '（历史步压缩 · list_outline · 共 ' || len(l) || ' 行）' || chr(10) || array_to_string(l[1:5], chr(10)) || chr(10) || '… 省略 ' || (len(l) - 5) || ' 行；需章节页码请 lookup_toc。' END
      WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || '…（已截断）' END) AS text_md5 FROM (SELECT doc_id, text, {_LINES} AS l FROM documents)""",
    "h06_retrieve_once": S._sql(_RERANKED.replace("{0}", "hh"), more={"pc": "SELECT * FROM ch WHERE page <= 3", "hh": S._TOPK.format("SELECT * FROM " + S._bm25_sql("pc", "v_queries", "text"), 10)}),
    "j03_turn_append": "SELECT conv_id, count(*) + 2 AS n, max(turn) + 2 AS last_turn FROM conversations GROUP BY conv_id",
    "x2_relaxed_batch": S._sql("SELECT run, count(*) AS raw, count(DISTINCT chunk_id) AS unique_hits, count(*) FILTER (relaxed) AS relaxed, max(round(score, 6)) AS best FROM (SELECT (query_id // 150)::INT AS run, chunk_id, score, false AS relaxed FROM st UNION ALL SELECT (query_id // 150)::INT, chunk_id, score, true FROM br WHERE query_id NOT IN (SELECT query_id FROM st)) GROUP BY run", more={
        "nc": "SELECT * FROM ch WHERE list_contains(asset_types, 'table') AND page >= 2", "ev": "SELECT * FROM v_queries", "st": S._TOPK.format("SELECT * FROM " + S._bm25_sql("nc", "ev", "text"), 3), "br": S._TOPK.format("SELECT * FROM " + S._bm25_sql("ch", "v_queries", "text"), 3)}),
    "x4_layout_to_chunks": with_views("v_blocks", more={"r": B._REPEATED, "k": f"SELECT *, {B._NORM} AS norm_text FROM v_blocks",
        "kb": f"SELECT * FROM k WHERE norm_text <> '' AND NOT {B._MARGIN} AND NOT regexp_matches(norm_text, '{B._PN}') AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = k.doc_id AND r.norm_text = k.norm_text)",
        "sg": "SELECT doc_id * 268435456 + page * 64 + dense_rank() OVER (PARTITION BY doc_id, page ORDER BY block_no // 6) AS doc_id, block_no, text FROM kb", "sx": "SELECT doc_id, string_agg(text, chr(10) ORDER BY block_no) AS text FROM sg GROUP BY doc_id", **_cut("sx")},
        body="SELECT doc_id, chunk_index, md5(text) AS text_md5 FROM c3"),
    "x6_answer_alignment": f"WITH al AS ({D.ORACLES['d11_align']}), sk AS ({D.ORACLES['d13_skip_table_embed']}), rn AS ({D.ORACLES['d10_renumber']}) SELECT answer_id, n, first_sentence, used FROM (SELECT answer_id, count(*) AS n, min(sentence_index) AS first_sentence FROM al JOIN sk USING (answer_id, sentence_index) WHERE ref % 2 = 1 OR NOT skip GROUP BY answer_id) JOIN rn USING (answer_id)",
}
_PAGES = {
    "pg": "SELECT doc_id AS d, page, string_agg(text, chr(10) ORDER BY block_no) AS text FROM v_body GROUP BY ALL",
    "gr": "SELECT d * 1000 + page // 3 AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pg GROUP BY ALL",
    "st": "SELECT d * 1000 + page // 3 AS g, page, coalesce(sum(length(text) + 2) OVER (PARTITION BY d, page // 3 ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM pg",
}
ORACLES["b29_chunk_assembly"] = with_views("v_body", more={**_PAGES, **_cut("gr")}, body="""SELECT doc_id // 1000 AS doc_id, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, chunk_index) - 1 AS chunk_index, 's' || (doc_id % 1000) AS section,
  (SELECT max(page) FROM st WHERE st.g = c3.doc_id AND st.a <= c3."offset") AS page, length(text) AS n_chars FROM c3""")

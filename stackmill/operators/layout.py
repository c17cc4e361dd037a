"""Page layout: paragraphs, recognised lines, positions of chunks on pages; admission of tables; loading of ranked chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.functions import text as T
from stackmill.operators import assets as C
from stackmill.operators import reports as R
from stackmill.operators import search as S
from stackmill.operators import structure as B
from stackmill.plans import views
from stackmill.plans.views import with_views

#: Least confidence of a recognised line, height of a line, least cells of a recognised table, figures routed.
MIN_CONFIDENCE, LINE_HEIGHT, MIN_FILLED, ROUTED = 0.5, 12, 2, 10


def styled_sections(paragraphs: DataFrame) -> DataFrame:
    """B2. doc_id, para_no, style, text -> one row a section; a paragraph whose style begins with 'heading' opens one."""
    heading = F.lower(F.coalesce("style", F.lit(""))).startswith("heading")
    w = Window.partitionBy("doc_id").orderBy("para_no")
    rows = paragraphs.withColumn("h", heading).withColumn("section_no", F.sum(F.col("h").cast("int")).over(w))
    body = F.transform(F.sort_array(F.collect_list(F.when(~F.col("h") & (T.strip(F.col("text")) != ""), F.struct("para_no", T.strip(F.col("text")).alias("t"))))), lambda x: x["t"])
    out = rows.groupBy("doc_id", "section_no").agg(F.max(F.when(F.col("h"), T.strip(F.col("text")))).alias("section"), F.array_join(body, "\n").alias("text"))
    return out.filter((F.col("text") != "") & ~B.is_toc_text(F.col("text")))


def section_at(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """B10. points: doc_id, id, page, y. anchors: doc_id, rank (place in order of page, y, level), page, y, path (folded in
    that order). The path of the last anchor at or before each point; both sides are ordered once, without a range join."""
    a = anchors.select("doc_id", "page", "y", F.lit(0).alias("kind"), F.col("rank").cast("long").alias("id"), "path")
    p = points.select("doc_id", "page", "y", F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), F.lit(None).cast("string").alias("path"))
    w = Window.partitionBy("doc_id").orderBy("page", "y", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(p).withColumn("section", F.last("path", ignorenulls=True).over(w)).filter("kind = 1").select("doc_id", "id", "section")


def recognised_text(lines: DataFrame) -> DataFrame:
    """B22. doc_id, page, x, y, text, confidence -> the page's text, in reading order: rows of LINE_HEIGHT points, then x."""
    kept = lines.filter((F.col("confidence") >= MIN_CONFIDENCE) & (T.strip(F.col("text")) != ""))
    order = F.struct(F.bround(F.col("y") / LINE_HEIGHT).alias("row"), F.col("x").alias("x"), F.col("line_no").alias("n"), T.strip(F.col("text")).alias("t"))
    return kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda r: r["t"]), "\n").alias("text"))


def chosen_text(native: Column, recognised: Column, excluded: Column, force: Column) -> Column:
    """B20, B21. Recognised text where it was asked for and is strictly longer."""
    asked = force | ((F.length(T.strip(native)) < 30) & ~excluded)
    return F.when(asked & (F.length(F.coalesce(recognised, F.lit(""))) > F.length(native)), recognised).otherwise(native)


def chunk_regions(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """B26 to B28. chunks: doc_id, chunk_index, start, end. spans: doc_id, page, span_start, span_end, y0, y1. The pages a chunk
    touches, each with the bounds of the blocks it overlaps. Text positions are cut into tiles, on which the join is equal."""
    tile = 2000
    tiles = lambda a, b: F.sequence(F.floor(a / tile), F.floor(F.greatest(a, b - 1) / tile))
    left = chunks.select("doc_id", "chunk_index", "start", "end", F.explode(tiles(F.col("start"), F.col("end"))).alias("tile"))
    right = spans.select("doc_id", "page", "block_no", "span_start", "span_end", "y0", "y1", F.explode(tiles(F.col("span_start"), F.col("span_end"))).alias("tile"))
    hit = left.join(right, ["doc_id", "tile"]).filter("span_end > start and span_start < end").dropDuplicates(["doc_id", "chunk_index", "block_no"])
    return hit.groupBy("doc_id", "chunk_index", "page").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def merged_markdown(parts: DataFrame) -> DataFrame:
    """C11. table_id, part (each once in a table), markdown -> one table: later parts lose a header equal to the first one; cut at
    SUMMARY_CHARS. A line has six characters at least, so only the rows that can stand before the cut are brought together; each task
    drops the others before the shuffle. The width is that of the whole table. Parts are read into cells once and kept."""
    # the cells of an empty part are dropped after they are written: a filter before would read every part twice
    cells = S.kept(parts.select("table_id", "part", C.markdown_cells(F.col("markdown")).alias("rows"))).filter(F.size("rows") > 0)
    most = C.SUMMARY_CHARS // 6 + 2
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    tables = cells.groupBy("table_id").agg(F.min(F.struct("part", F.col("rows")[0].alias("head"))).alias("first"), F.max(width).alias("width"))
    # a part of two rows leaves one at least, so what comes after so many of them is beyond the cut
    full = S.first_rows(cells.filter(F.size("rows") > 1).select("table_id", "part"), Window.partitionBy("table_id").orderBy("part"), most)
    last = full.filter(F.col("rank") == most - 1).select("table_id", F.col("part").alias("last"))
    near = cells.join(tables, "table_id").join(last, "table_id", "left").filter(F.col("last").isNull() | (F.col("part") <= F.col("last")))
    again = (F.col("part") != F.col("first.part")) & (F.col("rows")[0] == F.col("first.head"))
    body = F.when(again, F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows"))
    lines = near.select("table_id", "part", "width", F.posexplode(body).alias("no", "row"))
    near = S.first_rows(lines, Window.partitionBy("table_id").orderBy("part", "no"), most)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("rank", "row"))), lambda x: x["row"])
    made = near.groupBy("table_id").agg(rows.alias("rows"), F.first("width").alias("width"))
    return made.select("table_id", F.substring(C.markdown(F.col("rows"), F.col("width")), 1, C.SUMMARY_CHARS).alias("markdown"))


def admitted_table(rows: Column, cols: Column, filled: Column, summary: Column) -> Column:
    """C6, C13. Two rows or two columns, enough filled cells, a summary."""
    return ((rows >= 2) | (cols >= 2)) & (filled >= MIN_FILLED) & (T.strip(summary) != "")


def routed_kind(caption: Column, classified: Column, structured: Column, place: Column) -> Column:
    """C14. A caption that begins '表 n' makes a table; else, for the first figures of a page, what the classifier says, a table
    only if it reads as one; figures without a result stay figures."""
    named = F.coalesce(caption.rlike(r"^\s*表\s*\d"), F.lit(False))
    return F.when(named, "table").when(place > ROUTED, "figure").when((classified == "table") & structured, "table").otherwise(F.coalesce(F.when(classified != "table", classified), F.lit("figure")))


def load_ranked(hits: DataFrame, chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """H8. Ranked ids with their chunk and its assets in order of type and page; ids without a chunk go."""
    nested = assets.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("kind", "page", "asset_id"))).alias("assets"))
    wanted = chunks.join(S.small(hits.select("query_id", "rank", "chunk_id", "score")), "chunk_id")
    return wanted.join(nested, "chunk_id", "left").withColumn("assets", F.coalesce("assets", F.array().cast(nested.schema["assets"].dataType)))


def rerank(hits: DataFrame, queries: DataFrame, k: int = S.FINAL_K) -> DataFrame:
    """G3. The default scorer: share of the query's distinct terms that the text has. The k best, by score, then the old rank."""
    q = S.small(queries.select("query_id", F.array_distinct(T.terms(F.col("query"))).alias("qs")))
    scored = hits.join(q, "query_id").withColumn("score", F.round(F.size(F.array_intersect(T.terms(F.col("text")), "qs")) / F.size("qs"), 9))
    return S.first_rows(scored.withColumnRenamed("rank", "old_rank"), Window.partitionBy("query_id").orderBy(F.desc("score"), "old_rank"), k)


# --- queries -----------------------------------------------------------------------------------------------------------


def b02_styled_sections(spark, sf_dir):
    p = views.body_blocks(spark, sf_dir).select("doc_id", F.col("block_no").alias("para_no"), F.when(F.col("block_no") % 4 == 1, "Heading 2").when(F.col("block_no") % 4 == 2, "Normal").alias("style"), "text")
    return styled_sections(p).select("doc_id", "section_no", "section", F.md5("text").alias("text_md5"))


def b10_section_at(spark, sf_dir):
    toc = views.toc_raw(spark, sf_dir)
    ranked = toc.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y", "level", "ord")))
    anchors = ranked.select("doc_id", "rank", "page", "y").join(B.section_paths(ranked.select("doc_id", "rank", "level", "title"), "rank"), ["doc_id", "rank"])
    return section_at(views.body_blocks(spark, sf_dir).select("doc_id", F.col("block_no").alias("id"), "page", (F.col("y0") + 10.0).alias("y")), anchors)


def b16_caption_blocks(spark, sf_dir):
    """Blocks in order of y, those that are captions left out."""
    b = views.caption_lines(spark, sf_dir).filter(C.caption(F.col("text")).isNull())
    return b.select("doc_id", "ord", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "y1", "ord")).alias("place"))


def b21_text_choice(spark, sf_dir):
    b = views.body_blocks(spark, sf_dir)
    other = F.when(F.col("block_no") % 3 == 0, F.concat("text", F.lit(" more"))).when(F.col("block_no") % 3 == 1, F.substring("text", 1, 5))
    return b.select("doc_id", "block_no", F.length(chosen_text(F.col("text"), other, F.col("block_no") % 2 == 0, F.col("block_no") % 5 == 0)).alias("n_chars"))


def b22_recognised_text(spark, sf_dir):
    lines = views.body_blocks(spark, sf_dir).select("doc_id", "page", F.col("block_no").alias("line_no"), (600.0 - F.col("block_no") % 7 * 10).alias("x"), (F.col("block_no") % 4 * 9.0 + 3.0).alias("y"), "text", (F.col("block_no") % 10 / 10.0).alias("confidence"))
    return recognised_text(lines).select("doc_id", "page", F.md5("text").alias("text_md5"))


def b27_chunk_regions(spark, sf_dir):
    """Pages and y-bounds of ranges of 700 characters over each document's joined lines."""
    b = views.body_blocks(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    spans = b.withColumn("span_start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long")).withColumn("span_end", F.col("span_start") + F.length("text"))
    total = spans.groupBy("doc_id").agg(F.max("span_end").alias("n")).filter("n > 0")
    ranges = total.select("doc_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(700).cast("long"))).alias("chunk_index", "start"), "n").withColumn("end", F.least("n", F.col("start") + 700))
    return chunk_regions(ranges, spans)


def c07_table_summary(spark, sf_dir):
    """Rows joined with bars, blank rows left out, where there is no markdown."""
    cells = C._lines_with_html(spark, sf_dir).select("l_orderkey", C.html_cells(F.col("html")).alias("rows"))
    text = F.array_join(F.transform(F.filter("rows", lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, " | ")), "\n")
    return cells.select("l_orderkey", F.md5(F.substring(text, 1, C.SUMMARY_CHARS)).alias("summary_md5"))


def c11_merged_markdown(spark, sf_dir):
    md = C._lines_with_html(spark, sf_dir).select((F.col("l_orderkey") % 200).alias("table_id"), F.col("l_orderkey").alias("part"), C.markdown(C.html_cells(F.col("html"))).alias("markdown"))
    return merged_markdown(md).select("table_id", F.md5("markdown").alias("markdown_md5"))


def c13_table_admission(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"))
    return li.select("l_orderkey", admitted_table(F.col("n") % 4, F.col("m") % 3, F.col("n") % 5, F.when(F.col("n") % 6 == 0, " ").otherwise("s")).alias("admitted"))


def c14_routing(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("asset_id"))
    cap = F.when(F.col("asset_id") % 7 == 0, "表 3-1 x").when(F.col("asset_id") % 7 == 1, "图 3")
    said = F.element_at(F.array(F.lit("table"), F.lit("photo"), F.lit(None).cast("string"), F.lit("diagram")), (F.col("asset_id") % 4 + 1).cast("int"))
    return a.withColumn("place", place).select("asset_id", routed_kind(cap, said, F.col("asset_id") % 3 == 0, F.col("place")).alias("kind"))


def c22_regions(spark, sf_dir):
    """Given regions without the malformed ones; the asset's own place where none is left."""
    a = views.assets(spark, sf_dir)
    box = F.array("x0", "y0", "x1", "y1")
    given = F.array(F.struct(F.when(F.col("asset_id") % 3 != 0, F.col("page")).alias("page"), F.when(F.col("asset_id") % 5 != 0, box).otherwise(F.array("x0")).alias("bbox")))
    ok = F.filter(given, lambda r: r["page"].isNotNull() & (F.size(r["bbox"]) == 4))
    out = F.when(F.size(ok) > 0, ok).otherwise(F.array(F.struct((F.col("page") + 0).alias("page"), F.array("x0", "y0", F.col("x1"), F.col("y1") + 1).alias("bbox"))))
    return a.select("asset_id", F.col("page"), out[0]["bbox"][3].alias("y1"), F.size(out).alias("n"))


def x5_attach(spark, sf_dir):
    """Assets to chunks in stages: cited ones, then mentioned ones, then by reading order; the rest are chunks of their own."""
    a, refs = views.assets(spark, sf_dir), views.ref_lines(spark, sf_dir)
    numbered = C.numbered_assets(a)
    one = C.forward_attach(C._refs(spark, sf_dir), numbered).select("doc_id", "asset_id", "chunk_index", F.lit("cited").alias("how"))
    left = numbered.join(one.select("asset_id"), "asset_id", "left_anti").select("doc_id", "kind", "figure_number", "asset_id")
    two = C.reverse_attach(refs, left).select("doc_id", "asset_id", "chunk_index", F.lit("mentioned").alias("how"))
    done = one.unionByName(two)
    three = C.reading_order_attach(refs, a.join(done.select("asset_id"), "asset_id", "left_anti")).select("doc_id", "asset_id", "chunk_index", F.lit("near").alias("how"))
    attached = done.unionByName(three)
    return a.select("doc_id", "asset_id").join(attached.drop("doc_id"), "asset_id", "left").select("doc_id", "asset_id", "chunk_index", F.coalesce("how", F.lit("orphan")).alias("how"))


def g03_rerank(spark, sf_dir):
    hits = S._text_hits(spark, sf_dir, S.RETRIEVE_K)
    loaded = S.hit_chunks(spark, sf_dir, hits, S.RETRIEVE_K).select("query_id", "rank", "chunk_id", "text")
    return rerank(loaded, views.queries(spark, sf_dir)).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def h08_load_ranked(spark, sf_dir):
    hits = S.kept(S._vector_hits(spark, sf_dir, 10))
    docs = S.hit_documents(spark, sf_dir, hits)
    assets = views.assets_of(views.laid_out(views.lines_of(docs))).select((F.col("doc_id") * 16777216).alias("chunk_id"), "kind", "page", "asset_id")
    out = load_ranked(hits, S.chunk(docs), assets)
    return out.select("query_id", "rank", "chunk_id", F.size("assets").alias("n_assets"), F.array_join(F.transform("assets", lambda a: F.concat(a["kind"], F.lit(":"), a["asset_id"].cast("string"))), ",").alias("assets"))


def h09_chunk_ids(spark, sf_dir):
    """Texts that are ids of chunks, and those that are not."""
    e = views.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.md5(F.col("event_id").cast("string"))).otherwise(F.regexp_replace(F.md5(F.col("event_id").cast("string")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).alias("raw"))
    return e.select("event_id", F.coalesce(F.lower(T.strip(F.col("raw"))).rlike(r"^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"), F.lit(False)).alias("valid"))


def h10_batch_requests(spark, sf_dir):
    """Searches of each run without blank ones, at most three."""
    q = views.queries(spark, sf_dir).select(views.int_div(F.col("query_id"), 5).alias("run"), (F.col("query_id") % 5).alias("pos"), F.when(F.col("query_id") % 4 == 1, " ").otherwise(F.col("query")).alias("query"))
    return S.first_rows(q.filter(T.strip(F.col("query")) != ""), Window.partitionBy("run").orderBy("pos"), 3).select("run", "pos", "rank", "query")


def h20_resolve_section(spark, sf_dir):
    """The best contents entry of each request."""
    best = S.toc_lookup(S.toc_scores(B._entries(spark, sf_dir), S._toc_requests(spark, sf_dir)), 1)
    return best.select("query_id", "doc_id", "path", "start_page")


def h23_document_list(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name")).join(views.page_counts(spark, sf_dir), "doc_id")
    status = F.element_at(F.array(F.lit("ready"), F.lit("failed"), F.lit("pending")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select("doc_id", F.concat("name", F.lit(" id="), F.col("doc_id").cast("string"), F.lit(" pages="), F.col("page_count").cast("string"), F.lit(" status="), status).alias("line"))


def e08_numbers_and_types(spark, sf_dir):
    """Distinct figure numbers in order and sorted distinct types of each document's page."""
    a = views.assets(spark, sf_dir).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("asset_id", "kind", "figure_number"))).alias("as"))
    numbers = F.array_distinct(F.filter(F.transform("as", lambda x: F.trim(x["figure_number"])), lambda x: x.isNotNull() & (x != "")))
    return a.select("doc_id", "page", F.array_join(numbers, ",").alias("numbers"), F.array_join(F.array_sort(F.array_distinct(F.transform("as", lambda x: x["kind"]))), ",").alias("types"))


def e12_bodies(spark, sf_dir):
    """Snippets cut at 240 and 160, whole texts where asked for."""
    r = views.ref_lines(spark, sf_dir)
    snippet = F.when(F.col("chunk_index") % 3 == 0, "").otherwise(F.substring("text", 1, 300))
    body = F.coalesce(F.nullif(snippet, F.lit("")), F.col("text"))
    return r.select("doc_id", "chunk_index", F.length(F.substring(body, 1, 240)).alias("search"), F.length(F.substring(body, 1, 160)).alias("batch"), F.length("text").alias("full"))


def e13_result_listing(spark, sf_dir):
    """The numbered hits of each query as one text."""
    hits = S._text_hits(spark, sf_dir, S.FINAL_K)
    rows = S.hit_chunks(spark, sf_dir, hits, S.FINAL_K)
    one = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), "name", F.lit("\n"), F.substring("text", 1, 240))
    g = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", one.alias("o")))), lambda x: x["o"]), "\n\n").alias("body"))
    return g.select("query_id", "n", F.md5("body").alias("listing_md5"))


def i07_evidence_index(spark, sf_dir):
    ev = R.accumulate_evidence(R._evidence(spark, sf_dir)).filter("ord < 10")
    line = F.concat(F.lit("["), (F.col("ord") + 1).cast("string"), F.lit("] "), "key")
    return ev.groupBy("run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("evidence"))


def j09_token_state(spark, sf_dir):
    """Tokens by state: unknown, expired, owner disabled or valid."""
    t = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), F.when(F.col("o_orderkey") % 8 != 0, F.col("o_custkey")).alias("owner"), (F.col("o_orderkey") % 5 == 0).alias("old"))
    u = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") % 6 == 0).alias("disabled"))
    state = F.when(F.col("disabled").isNull(), "unknown").when(F.col("old"), "expired").when(F.col("disabled"), "disabled").otherwise("valid")
    return t.join(u, "owner", "left").select("token", state.alias("state"))


def j12_reindex_reset(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("ready").alias("status"), F.col("n_chars").alias("progress"), F.lit("e").alias("error"))
    hit = F.col("status") == "failed"
    return d.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "progress": F.when(hit, 0).otherwise(F.col("progress")), "error": F.when(~hit, F.col("error"))})


QUERIES = {f.__name__: f for f in (
    b02_styled_sections, b10_section_at, b16_caption_blocks, b21_text_choice, b22_recognised_text, b27_chunk_regions, c07_table_summary, c11_merged_markdown, c13_table_admission, c14_routing, c22_regions, x5_attach,
    g03_rerank, h08_load_ranked, h09_chunk_ids, h10_batch_requests, h20_resolve_section, h23_document_list, e08_numbers_and_types, e12_bodies, e13_result_listing, i07_evidence_index, j09_token_state, j12_reindex_reset,
)}

_WS = r"E' \t\n\r\x0b\x0c'"
_TOCLIKE = f"(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 2 AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '{B.TOC_ENTRY}'))) >= greatest(2, 0.4 * len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))))"
_MD = "'| ' || a || ' | ' || CASE WHEN b = '' THEN ' ' ELSE b END || ' | ' || CASE WHEN c = '' THEN ' ' ELSE c END || ' |'"
_TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
ORACLES = {
    "b02_styled_sections": with_views("v_body", more={"s": f"SELECT doc_id, (block_no + 3) // 4 AS section_no, max(trim(text, {_WS})) FILTER (block_no % 4 = 1) AS section, string_agg(trim(text, {_WS}), chr(10) ORDER BY block_no) FILTER (block_no % 4 <> 1 AND trim(text, {_WS}) <> '') AS text FROM v_body GROUP BY ALL"},
        body=f"SELECT doc_id, section_no, section, md5(text) AS text_md5 FROM s WHERE text <> '' AND NOT {_TOCLIKE}"),
    "b10_section_at": with_views("v_toc", more={"q": B._PATHS, "x": "SELECT v_toc.doc_id, page, y, ord, p.path FROM v_toc JOIN q p USING (doc_id, ord)"}, body="SELECT b.doc_id, b.block_no AS id, (SELECT arg_max(x.path, x.ord) FROM x WHERE x.doc_id = b.doc_id AND (x.page < b.page OR (x.page = b.page AND x.y <= b.y0 + 10))) AS section FROM v_body b"),
    "b16_caption_blocks": with_views("v_captions", body=f"SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, y1, ord) AS place FROM v_captions WHERE NOT regexp_matches(trim(text, {_WS}), '{C.CAPTION}')"),
    "b21_text_choice": with_views("v_body", more={"o": "SELECT *, CASE WHEN block_no % 3 = 0 THEN text || ' more' WHEN block_no % 3 = 1 THEN substr(text, 1, 5) ELSE '' END AS o FROM v_body"},
        body=f"SELECT doc_id, block_no, CASE WHEN (block_no % 5 = 0 OR (length(trim(text, {_WS})) < 30 AND block_no % 2 = 1)) AND length(o) > length(text) THEN length(o) ELSE length(text) END AS n_chars FROM o"),
    "b22_recognised_text": with_views("v_body", body=f"SELECT doc_id, page, md5(string_agg(trim(text, {_WS}), chr(10) ORDER BY round_even((block_no % 4 * 9.0 + 3) / 12, 0), 600 - block_no % 7 * 10, block_no)) AS text_md5 FROM v_body WHERE block_no % 10 >= 5 AND trim(text, {_WS}) <> '' GROUP BY doc_id, page"),
    "b27_chunk_regions": with_views("v_body", more={"s": "SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(text) AS len FROM v_body", "t": "SELECT doc_id, max(a + len) AS n FROM s GROUP BY doc_id HAVING n > 0",
        "r": "SELECT doc_id, n, unnest(range(0, n::BIGINT, 700)) AS st FROM t"}, body="SELECT r.doc_id, (st // 700)::INT AS chunk_index, s.page, min(y0) AS y0, max(y1) AS y1 FROM r JOIN s ON s.doc_id = r.doc_id AND s.a + s.len > r.st AND s.a < least(r.n, r.st + 700) GROUP BY ALL"),
    "c07_table_summary": with_views(body="SELECT l_orderkey, md5(substr('no | flag' || chr(10) || string_agg(a || ' | ' || b || ' | ' || c, chr(10) ORDER BY l_linenumber, b, c), 1, 4000)) AS summary_md5 FROM ro GROUP BY l_orderkey", more=C._HTML),
    "c11_merged_markdown": with_views(body=f"SELECT l_orderkey % 200 AS table_id, md5(substr('| no | flag |   |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg({_MD}, chr(10) ORDER BY l_orderkey, l_linenumber, b, c), 1, 4000)) AS markdown_md5 FROM ro GROUP BY l_orderkey % 200", more=C._HTML),
    "c13_table_admission": "SELECT l_orderkey, (count(*) % 4 >= 2 OR max(l_linenumber) % 3 >= 2) AND count(*) % 5 >= 2 AND count(*) % 6 <> 0 AS admitted FROM lineitem GROUP BY l_orderkey",
    "c14_routing": with_views("v_assets", more={"p": "SELECT asset_id, (['table', 'photo', NULL, 'diagram'])[asset_id % 4 + 1] AS said, row_number() OVER (PARTITION BY doc_id ORDER BY asset_id) AS place FROM v_assets"},
        body="SELECT asset_id, CASE WHEN asset_id % 7 = 0 THEN 'table' WHEN place > 10 THEN 'figure' WHEN said = 'table' AND asset_id % 3 = 0 THEN 'table' WHEN said <> 'table' THEN said ELSE 'figure' END AS kind FROM p"),
    "c22_regions": with_views("v_assets", body="SELECT asset_id, page, CASE WHEN asset_id % 3 <> 0 AND asset_id % 5 <> 0 THEN y1 ELSE y1 + 1 END AS y1, 1 AS n FROM v_assets"),
    "x5_attach": with_views("v_refs", "v_assets", more={"nu": C._NUMBERED, "rf": C._REFS, "ev": "SELECT * FROM rf", "f1": C._FORWARD.format("ev"),
        "f2": "SELECT asset_id, chunk_index FROM rf JOIN (SELECT * FROM nu WHERE asset_id NOT IN (SELECT asset_id FROM f1)) USING (doc_id, kind, figure_number) QUALIFY row_number() OVER (PARTITION BY doc_id, asset_id ORDER BY chunk_index) = 1",
        "dn": "SELECT asset_id, chunk_index, 'cited' AS how FROM f1 UNION ALL SELECT asset_id, chunk_index, 'mentioned' FROM f2", "c": "SELECT * FROM v_refs", "nr": C._READING.format("c")},
        body="SELECT a.doc_id, a.asset_id, coalesce(dn.chunk_index, nr.chunk_index) AS chunk_index, coalesce(dn.how, CASE WHEN nr.chunk_index IS NOT NULL THEN 'near' END, 'orphan') AS how FROM v_assets a LEFT JOIN dn USING (asset_id) LEFT JOIN nr ON nr.asset_id = a.asset_id"),
    "g03_rerank": S._sql("SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) - 1 AS rank FROM (SELECT query_id, th.rank AS old, chunk_id, round(len(list_intersect(" + _TERMS.format("text") + ", " + _TERMS.format("query") + ")) * 1.0 / len(list_distinct(" + _TERMS.format("query") + ")), 9)::DOUBLE AS score FROM th JOIN ch USING (chunk_id) JOIN v_queries USING (query_id))) WHERE rank < 3", more={"th": S._HITS["th"]}),
    "h08_load_ranked": S._sql("SELECT query_id, rank, vh.chunk_id, coalesce(n, 0)::INT AS n_assets, coalesce(a, '') AS assets FROM vh JOIN ch ON ch.chunk_id = vh.chunk_id LEFT JOIN (SELECT doc_id * 16777216 AS chunk_id, count(*) AS n, string_agg(kind || ':' || asset_id, ',' ORDER BY kind, page, asset_id) AS a FROM v_assets GROUP BY doc_id) x ON x.chunk_id = vh.chunk_id", "v_assets", more={"vh": S._HITS["vh"]}),
    "h09_chunk_ids": "SELECT event_id, event_id % 3 <> 0 AS valid FROM events",
    "h10_batch_requests": with_views("v_queries", body="SELECT run, pos, rank, query FROM (SELECT (query_id // 5)::INT AS run, query_id % 5 AS pos, query, row_number() OVER (PARTITION BY query_id // 5 ORDER BY query_id) - 1 AS rank FROM v_queries WHERE query_id % 4 <> 1) WHERE rank < 3"),
    "h20_resolve_section": S._sql("SELECT query_id, doc_id, path, start_page FROM (SELECT sc.query_id, sc.doc_id, sc.path, x.start_page, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, sc.ord) AS n FROM sc JOIN x USING (doc_id, ord) WHERE score > 0) WHERE n = 1", "v_toc", "v_pages", more=S._TOC, chunks=False),
    "h23_document_list": with_views("v_pages", body="SELECT doc_id, 'doc-' || doc_id || ' id=' || doc_id || ' pages=' || page_count || ' status=' || (['ready', 'failed', 'pending'])[doc_id % 3 + 1] AS line FROM v_pages"),
    "e08_numbers_and_types": with_views("v_assets", body="SELECT doc_id, page, coalesce(array_to_string(list_filter(list(figure_number ORDER BY asset_id), lambda x: x IS NOT NULL), ','), '') AS numbers, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM v_assets GROUP BY doc_id, page"),
    "e12_bodies": with_views("v_refs", more={"b": "SELECT *, length(CASE WHEN chunk_index % 3 = 0 OR text = '' THEN text ELSE substr(text, 1, 300) END) AS n FROM v_refs"}, body="SELECT doc_id, chunk_index, least(n, 240)::INT AS search, least(n, 160)::INT AS batch, length(text)::INT AS full FROM b"),
    "e13_result_listing": S._sql("SELECT query_id, count(*) AS n, md5(string_agg('[' || (rank + 1) || '] ' || name || chr(10) || substr(text, 1, 240), chr(10) || chr(10) ORDER BY rank)) AS listing_md5 FROM th JOIN ch USING (chunk_id) WHERE rank < 3 GROUP BY query_id", more={"th": S._HITS["th"]}),
    "i07_evidence_index": R._EV + " SELECT run, string_agg('[' || (ord + 1) || '] ' || key, chr(10) ORDER BY ord) AS evidence FROM ev WHERE ord < 10 GROUP BY run",
    "j09_token_state": "SELECT o_orderkey AS token, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN o_orderkey % 5 = 0 THEN 'expired' WHEN c_custkey % 6 = 0 THEN 'disabled' ELSE 'valid' END AS state FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 8 <> 0",
    "j12_reindex_reset": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'ready' END AS status, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END AS progress, CASE WHEN doc_id % 4 <> 0 THEN 'e' END AS error FROM documents",
}

"""Structuring of documents: blocks, bookmarks and sections, page rows, chunk assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackmill.plans import views
from stackmill.plans.views import PAGE_HEIGHT, with_views

#: Margins as shares of the page height, share of pages for a repeated text, least repetitions.
MARGIN, REPEAT_SHARE, REPEAT_LEAST = 0.08, 0.35, 3
#: Fixed value: share of a block's area that a table or figure must cover.
COVERED = 0.35
SECTION_PATH_MAX, SECTION_SEPARATOR = 512, " > "
#: Fixed patterns.
PAGE_NUMBER = r"(?i)^(?:第\s*)?\d+\s*(?:页|/|\s|$)|^(?:page|p\.?)\s*\d+\s*$"
TOC_ENTRY = r"^(?:\d+(?:\.\d+)*)?\s*.+?(?:\.{3,}|…{2,}|·{4,}|\s{2,})\s*\d+\s*$"
TOC_LEADER = r"\.{4,}|…{2,}|·{4,}"
TOC_DOTS = r"^[\.\s·…]{4,}\s*\d+$"
CHAPTER_ONE = r"(?i)第[一1壹]章|chapter\s*1\b"
CHAPTER_TITLE = r"(?i)第[一二三四五六七八九十百千零两\d]+章|chapter\s+\d+"
HEADING = r"^#{1,6}\s+.+$"


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_page_number(text: Column) -> Column:
    return F.coalesce(squeeze(text).rlike(PAGE_NUMBER), F.lit(False))


def in_margin(y0: Column, y1: Column, height: float = PAGE_HEIGHT) -> Column:
    centre = (y0 + y1) / 2
    return (centre <= height * MARGIN) | (centre >= height * (1 - MARGIN))


def is_toc_text(text: Column) -> Column:
    """Two or more lines, and at least 40 % of them, look like entries of a table of contents."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    like = F.filter(lines, lambda x: x.rlike(TOC_ENTRY) | (x.rlike(TOC_LEADER) & x.rlike(r"\d+\s*$")) | x.rlike(TOC_DOTS))
    return (F.size(lines) >= 2) & (F.size(like) >= 2) & (F.size(like) / F.size(lines) >= 0.4)


def markdown_sections(docs: DataFrame) -> DataFrame:
    """B1, B3. doc_id, text -> doc_id, section_no, section, text. A heading line opens a section and is dropped; blank and
    contents-like sections go; a document without any section left is one row."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    heading = F.col("line").rlike(HEADING)
    rows = rows.withColumn("heading", heading).withColumn("section_no", F.sum(F.col("heading").cast("int")).over(Window.partitionBy("doc_id").orderBy("no")))
    grouped = rows.groupBy("doc_id", "section_no").agg(
        F.max(F.when(F.col("heading"), F.regexp_replace("line", r"^#{1,6}\s+", ""))).alias("section"),
        F.sort_array(F.collect_list(F.when(~F.col("heading"), F.struct("no", "line")))).alias("ls"),
    )
    text = F.trim(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit(" \t\n\r"))
    found = grouped.select("doc_id", "section_no", F.trim("section").alias("section"), text.alias("text")).filter((F.col("text") != "") & ~is_toc_text(F.col("text")))
    whole = docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", F.lit(0).cast("long").alias("section_no"), F.lit(None).cast("string").alias("section"), F.trim("text", F.lit(" \t\n\r")).alias("text")
    )
    return found.unionByName(whole.filter("text <> ''"))


def toc_intervals(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """B5. Adds end_page: one before the page of the next bookmark of the same or a shallower level, never before the own
    page; the page count where there is none. A bookmark stands in the sequence of its own level and of every deeper level of its document, so
    what follows it in its own one ends it: rows grow with the depth of a document, and one shuffle by document serves all."""
    levels = F.collect_set("level").over(Window.partitionBy("doc_id"))
    deeper = toc.withColumn("_ls", levels).withColumn("_l", F.explode_outer(F.filter("_ls", lambda x: x >= F.col("level")))).drop("_ls")
    after = F.when(F.col("level").isNotNull(), F.lead("page").over(Window.partitionBy("doc_id", "_l").orderBy("ord")))
    out = deeper.withColumn("next_page", after).filter(F.col("level").eqNullSafe(F.col("_l"))).join(pages.select("doc_id", "page_count"), "doc_id")
    end = F.greatest(F.col("page"), F.coalesce(F.col("next_page") - 1, F.col("page_count")))
    return out.select("doc_id", "ord", "level", "title", F.col("page").alias("start_page"), end.alias("end_page"))


def truncate_path(path: Column) -> Column:
    return F.when(F.length(path) <= SECTION_PATH_MAX, path).otherwise(F.concat(F.substring(path, 1, SECTION_PATH_MAX - 1), F.lit("…")))


def section_paths(toc: DataFrame, order: str = "ord") -> DataFrame:
    """B6. doc_id, order, level, title -> doc_id, order, path: a stack by level folded over each document's bookmarks."""
    rows = toc.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order, "level", "title"))).alias("es"))
    state = "struct<stack:array<struct<level:int,title:string>>,out:array<struct<ord:bigint,path:string>>>"

    def push(acc: Column, e: Column) -> Column:
        stack = F.concat(F.filter(acc["stack"], lambda s: s["level"] < e["level"].cast("int")), F.array(F.struct(e["level"].cast("int").alias("level"), e["title"].alias("title"))))
        path = truncate_path(F.array_join(F.transform(stack, lambda s: s["title"]), SECTION_SEPARATOR))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(e[order].cast("bigint").alias("ord"), path.alias("path")))).alias("out"))

    start = F.struct(F.array().alias("stack"), F.array().alias("out")).cast(state)
    folded = rows.select("doc_id", F.explode(F.aggregate("es", start, push)["out"]).alias("e"))
    return folded.select("doc_id", F.col("e.ord").alias(order), F.col("e.path").alias("path"))


def section_for_page(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """B9. For each (doc_id, page) the path of the deepest entry whose interval holds the page, the first one on ties. The pages of
    an interval are enumerated, between the first and the last page asked for; levels nest, so rows grow with the depth of a document."""
    asked = pages.groupBy("doc_id").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    held = entries.join(asked, "doc_id").withColumn("low", F.greatest("low", "start_page")).withColumn("high", F.least("high", "end_page")).filter("start_page <= end_page and low <= high")
    best = held.select("doc_id", "level", "ord", "path", F.explode(F.sequence("low", "high")).alias("page")).groupBy("doc_id", "page").agg(F.max_by("path", F.struct(F.col("level"), -F.col("ord"))).alias("section"))
    return best.join(pages, ["doc_id", "page"], "left_semi")


def front_matter_start(entries: DataFrame) -> DataFrame:
    """B11. doc_id, content_start."""
    one = F.col("title").rlike(CHAPTER_ONE) | F.col("path").rlike(CHAPTER_ONE)
    titled = (F.col("level") == 1) & F.col("title").rlike(CHAPTER_TITLE)
    return entries.groupBy("doc_id").agg(
        F.coalesce(
            F.min_by("start_page", F.when(one, F.col("ord"))),
            F.min_by("start_page", F.when(titled, F.col("ord"))),
            F.min(F.when(F.col("level") == 1, F.col("start_page"))),
            F.min("start_page"),
        ).alias("content_start")
    )


def coordinate_votes(points: DataFrame) -> DataFrame:
    """B8. doc_id, page, ord, y, height -> doc_id, top_down: neighbours on a page vote for raw or flipped order, single
    bookmarks by zone (under 45 % or over 55 % of the height)."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    seen = points.withColumn("prev", F.lag("y").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page")))
    down = F.when(F.col("prev").isNotNull() & (F.col("y") >= F.col("prev")), 1).otherwise(0)
    up = F.when(F.col("prev").isNotNull() & (F.col("y") <= F.col("prev")), 1).otherwise(0)
    single = F.col("n") == 1
    raw = F.when(single & (F.col("y") <= 0.45 * F.col("height")), 1).when(single, 0).otherwise(down)
    flip = F.when(single & (F.col("y") >= 0.55 * F.col("height")), 1).when(single, 0).otherwise(up)
    return seen.groupBy("doc_id").agg(F.sum(raw).alias("raw_votes"), F.sum(flip).alias("flip_votes")).withColumn("top_down", F.col("raw_votes") > F.col("flip_votes"))


def repeated_margin_texts(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """B12. doc_id, norm_text, n of margin texts that recur on enough of a document's pages."""
    found = blocks.filter(in_margin(F.col("y0"), F.col("y1"))).select("doc_id", squeeze(F.col("text")).alias("norm_text")).filter("norm_text <> ''")
    counts = found.filter(~is_page_number(F.col("norm_text"))).groupBy("doc_id", "norm_text").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(REPEAT_LEAST), F.floor(F.col("page_count") * REPEAT_SHARE))
    return counts.join(pages.select("doc_id", "page_count"), "doc_id").filter(F.col("n") >= least).select("doc_id", "norm_text", "n")


def content_blocks(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """B13. Blocks that are not blank, not in a margin and not a repeated margin text."""
    kept = blocks.withColumn("norm_text", squeeze(F.col("text"))).filter((F.col("norm_text") != "") & ~in_margin(F.col("y0"), F.col("y1")) & ~is_page_number(F.col("norm_text")))
    return kept.join(repeated.select("doc_id", "norm_text"), ["doc_id", "norm_text"], "left_anti").drop("norm_text")


def uncovered_blocks(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """B15. Blocks of which no box covers COVERED of the area or more. boxes: doc_id, page, x0, y0, x1, y1."""
    b = boxes.select("doc_id", "page", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = F.greatest(F.lit(0.0), F.least("x1", "bx1") - F.greatest("x0", "bx0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "by1") - F.greatest("y0", "by0"))
    area = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    hit = blocks.join(b, ["doc_id", "page"]).filter(wide * high / area >= COVERED).select("doc_id", "block_no").distinct()
    return blocks.join(hit, ["doc_id", "block_no"], "left_anti")


def segments(rows: DataFrame) -> DataFrame:
    """B17, B18. doc_id, page, ord, section, text, box -> one row for each run of one section on a page."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    new = (~F.col("section").eqNullSafe(F.lag("section").over(w))).cast("int")
    island = F.sum("new").over(w)
    runs = rows.withColumn("new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("segment", island)
    return runs.groupBy("doc_id", "page", "segment").agg(
        F.min("section").alias("section"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def block_spans(rows: DataFrame) -> DataFrame:
    """B19. doc_id, page, ord, text -> span_start, span_end of every block in its page's joined text."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long")
    return rows.select("doc_id", "page", "ord", "text", start.alias("span_start")).withColumn("span_end", F.col("span_start") + F.length("text"))


def contiguous_sections(page_rows: DataFrame) -> DataFrame:
    """B23, B24. doc_id, page, section, text in page order -> group_no, and page_start: the offset of the page in the text of its
    group, pages joined by two line feeds."""
    w = Window.partitionBy("doc_id").orderBy("page")
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col("section").eqNullSafe(F.lag("section").over(w))).cast("int"))
    grouped = page_rows.withColumn("new", new).withColumn("group_no", F.sum("new").over(w))
    before = Window.partitionBy("doc_id", "group_no").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.select("doc_id", "group_no", "page", "section", "text", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("long").alias("page_start"))


def merge_reading_order(texts: DataFrame, orphans: DataFrame) -> DataFrame:
    """B30. Orphan asset chunks come before the text chunks of their page, by y; then all are numbered. Null pages count as 0."""
    a = texts.select("doc_id", "page", F.lit(float("inf")).alias("sort_key"), F.col("chunk_index").alias("ord"), "text")
    b = orphans.select("doc_id", "page", "sort_key", F.col("ord"), F.lit("").alias("text"))
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("page", F.lit(0)), "sort_key", "ord")
    return a.unionByName(b).withColumn("chunk_index", F.row_number().over(w) - 1).select("doc_id", "chunk_index", "page", "text")


# --- queries -------------------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = views.toc_raw(spark, sf_dir)
    return toc_intervals(toc, views.page_counts(spark, sf_dir)).join(section_paths(toc), ["doc_id", "ord"])


def b01_markdown_sections(spark, sf_dir):
    rows = views.lines(spark, sf_dir)
    made = F.when(F.col("block_no") % 5 == 0, F.concat(F.lit("## Part "), views.int_div(F.col("block_no"), 5).cast("string"), F.lit("\n"), "text")).otherwise(F.col("text"))
    docs = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", made.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return markdown_sections(docs).select("doc_id", "section_no", "section", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def b04_toc_text(spark, sf_dir):
    toc = views.toc_raw(spark, sf_dir)
    line = F.concat("title", F.when(F.col("ord") % 2 == 0, " ..... ").otherwise(" "), F.col("page").cast("string"))
    pages = toc.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return pages.select("doc_id", is_toc_text(F.col("text")).alias("is_toc"))


def b05_toc_intervals(spark, sf_dir):
    return toc_intervals(views.toc_raw(spark, sf_dir), views.page_counts(spark, sf_dir)).select("doc_id", "ord", "level", "start_page", "end_page")


def b06_section_paths(spark, sf_dir):
    return section_paths(views.toc_raw(spark, sf_dir)).select("doc_id", "ord", "path")


def b07_toc_anchors(spark, sf_dir):
    toc = views.toc_raw(spark, sf_dir).withColumn("y", F.when(F.col("ord") % 4 != 0, F.col("y")))
    out = toc.select("doc_id", "title", "level", "page", F.coalesce("y", F.lit(0.0)).alias("y"), F.col("y").isNotNull().alias("has_y"), "ord")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y", "level", "ord"))).drop("title")


def b08_coordinate_votes(spark, sf_dir):
    toc = views.toc_raw(spark, sf_dir).select("doc_id", "page", "ord", F.when(F.col("doc_id") % 2 == 0, F.col("y")).otherwise(PAGE_HEIGHT - F.col("y")).alias("y"), F.lit(PAGE_HEIGHT).alias("height"))
    return coordinate_votes(toc)


def b09_section_for_page(spark, sf_dir):
    pages = views.page_counts(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    return section_for_page(_entries(spark, sf_dir), pages)


def b11_front_matter(spark, sf_dir):
    return front_matter_start(_entries(spark, sf_dir))


def b12_repeated_margin_text(spark, sf_dir):
    return repeated_margin_texts(views.blocks(spark, sf_dir), views.page_counts(spark, sf_dir))


def b13_content_blocks(spark, sf_dir):
    blocks = views.blocks(spark, sf_dir)
    kept = content_blocks(blocks, repeated_margin_texts(blocks, views.page_counts(spark, sf_dir)))
    return kept.groupBy("doc_id", "page").agg(F.count("*").alias("n_blocks"), F.sum("block_no").alias("block_sum"))


def b14_page_number(spark, sf_dir):
    return views.blocks(spark, sf_dir).groupBy("doc_id").agg(F.count_if(is_page_number(F.col("text"))).alias("n_page_numbers"), F.count("*").alias("n_blocks"))


def b15_uncovered_blocks(spark, sf_dir):
    return uncovered_blocks(views.body_blocks(spark, sf_dir), views.assets(spark, sf_dir)).select("doc_id", "block_no", "page")


def b17_segments(spark, sf_dir):
    rows = views.body_blocks(spark, sf_dir).withColumn("ord", F.col("block_no")).withColumn("section", F.concat(F.lit("s"), views.int_div(F.col("block_no"), 3).cast("string")))
    out = segments(rows)
    return out.select("doc_id", "page", "segment", "section", F.md5("text").alias("text_md5"), "x0", "y0", "x1", "y1")


def b19_block_spans(spark, sf_dir):
    return block_spans(views.body_blocks(spark, sf_dir).withColumn("ord", F.col("block_no"))).drop("text")


def b20_needs_ocr(spark, sf_dir):
    pages = views.body_blocks(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return pages.select("doc_id", "page", (F.length(F.trim("text", F.lit(" \t\n\r"))) < 30).alias("needs_ocr"))


def b23_contiguous_sections(spark, sf_dir):
    rows = views.body_blocks(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    rows = rows.withColumn("section", F.when(views.int_div(F.col("page"), 3) % 2 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("s"), views.int_div(F.col("page"), 3).cast("string"))))
    return contiguous_sections(rows).drop("text")


def b30_reading_order(spark, sf_dir):
    texts = views.ref_lines(spark, sf_dir)
    orphans = views.assets(spark, sf_dir).filter("figure_number is null").select("doc_id", "page", "sort_key", F.col("asset_id").alias("ord"))
    return merge_reading_order(texts, orphans).select("doc_id", "chunk_index", "page", F.length("text").alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    b01_markdown_sections, b04_toc_text, b05_toc_intervals, b06_section_paths, b07_toc_anchors, b08_coordinate_votes, b09_section_for_page, b11_front_matter, b12_repeated_margin_text,
    b13_content_blocks, b14_page_number, b15_uncovered_blocks, b17_segments, b19_block_spans, b20_needs_ocr, b23_contiguous_sections, b30_reading_order,
)}

_PN = r"(?i)^(?:第\s*)?\d+\s*(?:页|/|\s|$)|^(?:page|p\.?)\s*\d+\s*$"
_NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_MARGIN = "((y0 + y1) / 2 <= 64 OR (y0 + y1) / 2 >= 736)"
_INTERVALS = """SELECT t.doc_id, t.ord, t.level, t.title, t.page AS start_page,
  greatest(t.page, coalesce((SELECT arg_min(n.page, n.ord) FROM v_toc n WHERE n.doc_id = t.doc_id AND n.ord > t.ord AND n.level <= t.level) - 1, p.page_count)) AS end_page
  FROM v_toc t JOIN v_pages p USING (doc_id)"""
# levels come in the order 1, 2, 3, so the ancestors of a bookmark are the one or two before it
_PATHS = """SELECT t.doc_id, t.ord, CASE WHEN length(p) <= 512 THEN p ELSE substr(p, 1, 511) || '…' END AS path FROM (
  SELECT doc_id, ord, CASE level WHEN 1 THEN title WHEN 2 THEN lag(title) OVER w || ' > ' || title ELSE lag(title, 2) OVER w || ' > ' || lag(title) OVER w || ' > ' || title END AS p
  FROM v_toc WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) t"""
_REPEATED = f"""SELECT b.doc_id, norm_text, count(*) AS n FROM (SELECT doc_id, {_NORM} AS norm_text FROM v_blocks WHERE {_MARGIN}) b JOIN v_pages p USING (doc_id)
  WHERE norm_text <> '' AND NOT regexp_matches(norm_text, '{_PN}') GROUP BY b.doc_id, norm_text, p.page_count HAVING count(*) >= greatest(3, floor(p.page_count * 0.35))"""
_PAGE_TEXT = "SELECT doc_id, page, string_agg(text, chr(10) ORDER BY block_no) AS text FROM v_body GROUP BY ALL"

ORACLES = {
    "b01_markdown_sections": with_views("v_lines", more={
        "s": "SELECT doc_id, block_no // 5 + 1 AS section_no, 'Part ' || (block_no // 5) AS section, trim(string_agg(text, chr(10) ORDER BY block_no), E' \\t\\n\\r') AS text FROM v_lines GROUP BY ALL",
        "k": f"SELECT * FROM s WHERE text <> '' AND NOT (len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 2 AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '{TOC_ENTRY}') OR (regexp_matches(x, '{TOC_LEADER}') AND regexp_matches(x, '\\d+\\s*$')))) >= greatest(2, 0.4 * len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))))",
        "w": "SELECT doc_id, 0 AS section_no, NULL AS section, trim(string_agg(CASE WHEN block_no % 5 = 0 THEN '## Part ' || (block_no // 5) || chr(10) || text ELSE text END, chr(10) ORDER BY block_no), E' \\t\\n\\r') AS text FROM v_lines WHERE doc_id NOT IN (SELECT doc_id FROM k) GROUP BY doc_id",
    }, body="SELECT doc_id, section_no, section, length(text) AS n_chars, md5(text) AS text_md5 FROM (SELECT * FROM k UNION ALL SELECT * FROM w)"),
    "b04_toc_text": with_views("v_toc", more={"l": "SELECT doc_id, trim(title || CASE WHEN ord % 2 = 0 THEN ' ..... ' ELSE ' ' END || page) AS x FROM v_toc"},
        body=f"SELECT doc_id, count(*) >= 2 AND count(*) FILTER (hit) >= 2 AND count(*) FILTER (hit) * 1.0 / count(*) >= 0.4 AS is_toc FROM (SELECT doc_id, regexp_matches(x, '{TOC_ENTRY}') OR (regexp_matches(x, '{TOC_LEADER}') AND regexp_matches(x, '\\d+\\s*$')) OR regexp_matches(x, '{TOC_DOTS}') AS hit FROM l) GROUP BY doc_id"),
    "b05_toc_intervals": with_views("v_toc", "v_pages", more={"e": _INTERVALS}, body="SELECT doc_id, ord, level, start_page, end_page FROM e"),
    "b06_section_paths": with_views("v_toc", body=_PATHS),
    "b07_toc_anchors": with_views("v_toc", more={"a": "SELECT doc_id, level, page, CASE WHEN ord % 4 <> 0 THEN y ELSE 0 END AS y, ord % 4 <> 0 AS has_y, ord FROM v_toc"}, body="SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, level, ord) AS rank FROM a"),
    "b08_coordinate_votes": with_views("v_toc", more={
        "p": "SELECT doc_id, page, ord, CASE WHEN doc_id % 2 = 0 THEN y ELSE 800 - y END AS y FROM v_toc",
        "s": "SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY ord) AS prev, count(*) OVER (PARTITION BY doc_id, page) AS n FROM p"},
        body="SELECT doc_id, sum(CASE WHEN n = 1 THEN (y <= 360)::INT ELSE coalesce((y >= prev)::INT, 0) END) AS raw_votes, sum(CASE WHEN n = 1 THEN (y >= 440.00000000000006)::INT ELSE coalesce((y <= prev)::INT, 0) END) AS flip_votes, raw_votes > flip_votes AS top_down FROM s GROUP BY doc_id"),
    "b09_section_for_page": with_views("v_toc", "v_pages", more={"e": _INTERVALS, "q": _PATHS, "g": "SELECT doc_id, unnest(range(1, page_count + 1)) AS page FROM v_pages"},
        body="SELECT DISTINCT ON (g.doc_id, g.page) g.doc_id, g.page, q.path AS section FROM g JOIN e ON g.doc_id = e.doc_id AND g.page BETWEEN e.start_page AND e.end_page JOIN q ON q.doc_id = e.doc_id AND q.ord = e.ord ORDER BY g.doc_id, g.page, e.level DESC, e.ord"),
    "b11_front_matter": with_views("v_toc", "v_pages", more={"e": _INTERVALS, "q": _PATHS, "x": "SELECT e.*, q.path FROM e JOIN q USING (doc_id, ord)"},
        body=f"SELECT doc_id, coalesce(arg_min(start_page, ord) FILTER (regexp_matches(title, '{CHAPTER_ONE}') OR regexp_matches(path, '{CHAPTER_ONE}')), arg_min(start_page, ord) FILTER (level = 1 AND regexp_matches(title, '{CHAPTER_TITLE}')), min(start_page) FILTER (level = 1), min(start_page)) AS content_start FROM x GROUP BY doc_id"),
    "b12_repeated_margin_text": with_views("v_blocks", body=_REPEATED),
    "b13_content_blocks": with_views("v_blocks", more={"r": _REPEATED, "k": f"SELECT *, {_NORM} AS norm_text FROM v_blocks"},
        body=f"SELECT doc_id, page, count(*) AS n_blocks, sum(block_no)::BIGINT AS block_sum FROM k WHERE norm_text <> '' AND NOT {_MARGIN} AND NOT regexp_matches(norm_text, '{_PN}') AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = k.doc_id AND r.norm_text = k.norm_text) GROUP BY doc_id, page"),
    "b14_page_number": with_views("v_blocks", body=f"SELECT doc_id, count(*) FILTER (regexp_matches({_NORM}, '{_PN}')) AS n_page_numbers, count(*) AS n_blocks FROM v_blocks GROUP BY doc_id"),
    "b15_uncovered_blocks": with_views("v_assets", body="""SELECT doc_id, block_no, page FROM v_body b WHERE NOT EXISTS (SELECT 1 FROM v_assets a WHERE a.doc_id = b.doc_id AND a.page = b.page
      AND greatest(0, least(b.x1, a.x1) - greatest(b.x0, a.x0)) * greatest(0, least(b.y1, a.y1) - greatest(b.y0, a.y0)) / greatest(1, (b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.35)"""),
    "b17_segments": with_views("v_body", more={"r": "SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY block_no // 3) AS segment FROM v_body"},
        body="SELECT doc_id, page, segment, 's' || (block_no // 3) AS section, md5(string_agg(text, chr(10) ORDER BY block_no)) AS text_md5, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r GROUP BY doc_id, page, segment, block_no // 3"),
    "b19_block_spans": with_views("v_body", more={"s": "SELECT doc_id, page, block_no AS ord, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS span_start FROM v_body"},
        body="SELECT doc_id, page, ord, span_start, span_start + n AS span_end FROM s"),
    "b20_needs_ocr": with_views("v_body", more={"p": _PAGE_TEXT}, body="SELECT doc_id, page, length(trim(text, E' \\t\\n\\r')) < 30 AS needs_ocr FROM p"),
    "b23_contiguous_sections": with_views("v_body", more={"p": _PAGE_TEXT,
        "q": "SELECT doc_id, page, CASE WHEN (page // 3) % 2 = 0 THEN NULL ELSE 's' || (page // 3) END AS section, length(text) AS n, page // 3 + 1 AS group_no FROM p"},
        body="SELECT doc_id, group_no, page, section, coalesce(sum(n + 2) OVER (PARTITION BY doc_id, group_no ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_start FROM q"),
    "b30_reading_order": with_views("v_refs", "v_assets", more={
        "u": "SELECT doc_id, page, 'inf'::DOUBLE AS k, chunk_index AS o, length(text) AS n_chars FROM v_refs UNION ALL SELECT doc_id, page, sort_key, asset_id, 0 FROM v_assets WHERE figure_number IS NULL"},
        body="SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, k, o) - 1 AS chunk_index, page, n_chars FROM u"),
}

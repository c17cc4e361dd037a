"""Figures and tables of manuals: captions, references, attachment to chunks, table text, merges across pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.functions.text import WS
from stackmill.plans import views
from stackmill.plans.views import PAGE_HEIGHT, with_views

#: Fixed patterns and values.
CAPTION = r"^(图|表|(?i:figure|fig\.?|table))\s*(\d+)\s*[-–—]\s*(\d+)\s*(.*)$"
NUMBER = r"(\d+)\s*[-–—]\s*(\d+)"
_EN_PREFIX, _EN_FIGURE, _EN_TABLE, _NO_MORE = r"(?i:as shown in|see|refer to|referring to)", r"(?i:figure|fig\.?)", r"(?i:table)", r"(?!\s*[-–—]\s*\d)"
FIGURE_REFS = (
    rf"(?:如图|参考图|见图|参见图)\s*{NUMBER}",
    rf"图\s*{NUMBER}\s*所示",
    rf"图\s*{NUMBER}{_NO_MORE}",
    rf"(?:{_EN_PREFIX}\s+)?{_EN_FIGURE}\s*{NUMBER}",
    rf"{_EN_FIGURE}\s*{NUMBER}\s*(?i:shows?|below)",
    rf"{_EN_FIGURE}\s*{NUMBER}{_NO_MORE}",
)
TABLE_REFS = (
    rf"(?:见表|参考表|参见表)\s*{NUMBER}",
    rf"表\s*{NUMBER}\s*所示",
    rf"表\s*{NUMBER}{_NO_MORE}",
    rf"(?:{_EN_PREFIX}\s+)?{_EN_TABLE}\s*{NUMBER}",
    rf"{_EN_TABLE}\s*{NUMBER}\s*(?i:shows?|below)",
    rf"{_EN_TABLE}\s*{NUMBER}{_NO_MORE}",
)
MAX_CAPTION_GAP, PAGES_BACK, Y_TOLERANCE = 80.0, 2, 4.0
BOTTOM_SHARE, TOP_SHARE = 0.82, 0.18
MIN_FIGURE, MAX_PAGE_SHARE, MAX_FIGURES = 64, 0.85, 20
SUMMARY_CHARS = 4000


def plain_number(chapter: Column, num: Column) -> Column:
    return F.concat(chapter.cast("bigint").cast("string"), F.lit("-"), num.cast("bigint").cast("string"))


def caption(line: Column) -> Column:
    """C1. struct<kind, number, description, full_text> of a caption line; null for any other line."""
    stripped = F.trim(line, F.lit(WS))
    part = lambda k: F.regexp_extract(stripped, CAPTION, k)
    kind = F.when(F.lower(part(1)).rlike("^(图|fig)"), "figure").otherwise("table")
    return F.when(
        stripped.rlike(CAPTION),
        F.struct(kind.alias("kind"), plain_number(part(2), part(3)).alias("number"), F.trim(part(4), F.lit(WS)).alias("description"), stripped.alias("full_text")),
    )


def references(text: Column, kind: str) -> Column:
    """C16. Numbers that a text refers to, each once, in order of the patterns and then of the text."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (FIGURE_REFS if kind == "figure" else TABLE_REFS)]
    return F.array_distinct(F.transform(F.flatten(F.array(*found)), lambda m: plain_number(F.regexp_extract(m, NUMBER, 1), F.regexp_extract(m, NUMBER, 2))))


def page_captions(blocks: DataFrame) -> DataFrame:
    """C2. Captions among one-line blocks."""
    one = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(WS)) != "")) == 1
    return blocks.filter(one).withColumn("c", caption(F.col("text"))).filter("c is not null").select("doc_id", "page", "x0", "y0", "x1", "y1", "c.*")


def pair_captions(captions: DataFrame, assets: DataFrame) -> DataFrame:
    """C3. asset_id, number, full_text: captions of a page and kind, from the top, each take the nearest free asset above
    them. The few captions and assets of one page are folded in one expression."""
    c = captions.groupBy("doc_id", "page", "kind").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "number", "full_text"))).alias("cs"))
    a = assets.groupBy("doc_id", "page", "kind").agg(F.sort_array(F.collect_list(F.struct("sort_key", "asset_id", "x0", "x1", "y1"))).alias("as"))
    kind = "array<struct<asset_id:bigint,number:string,full_text:string>>"

    def take(acc: Column, cap: Column) -> Column:
        gap = lambda x: cap["y0"] - x["y1"]
        free = F.filter(
            "as",
            lambda x: (gap(x) >= 0) & (gap(x) <= MAX_CAPTION_GAP) & (F.least(x["x1"], cap["x1"]) > F.greatest(x["x0"], cap["x0"])) & ~F.exists(acc, lambda t: t["asset_id"] == x["asset_id"]),
        )
        best = F.array_min(F.transform(free, lambda x, i: F.struct(gap(x).alias("g"), i.alias("i"), x["asset_id"].alias("asset_id"))))
        return F.when(best.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(best["asset_id"].alias("asset_id"), cap["number"].alias("number"), cap["full_text"].alias("full_text")))))

    both = c.join(a, ["doc_id", "page", "kind"])
    return both.select("doc_id", "page", "kind", F.explode(F.aggregate("cs", F.array().cast(kind), take)).alias("m")).select("doc_id", "page", "kind", "m.*")


def admit_figures(placements: DataFrame) -> DataFrame:
    """C4. Large enough in pixels and on the page, not the whole page, each placement once, at most MAX_FIGURES a page."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    big = (F.col("px_w") >= MIN_FIGURE) & (F.col("px_h") >= MIN_FIGURE) & (w >= MIN_FIGURE) & (h >= MIN_FIGURE)
    fit = placements.filter(big & (w * h <= MAX_PAGE_SHARE * views.PAGE_WIDTH * PAGE_HEIGHT))
    box = [F.bround(c, 1).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")]
    once = fit.select("*", *box).withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "page", "image_id", "rx0", "ry0", "rx1", "ry1").orderBy("ord")))
    return once.filter("copy = 1").withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord"))).filter(F.col("n") <= MAX_FIGURES)


def uncovered_figures(figures: DataFrame, tables: DataFrame, share: float = 0.35) -> DataFrame:
    """C5."""
    t = tables.select("doc_id", "page", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    cut = F.greatest(F.lit(0.0), F.least("x1", "tx1") - F.greatest("x0", "tx0")) * F.greatest(F.lit(0.0), F.least("y1", "ty1") - F.greatest("y0", "ty0"))
    area = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    hit = figures.join(t, ["doc_id", "page"]).filter(cut / area >= share).select("asset_id").distinct()
    return figures.join(hit, "asset_id", "left_anti")


def html_cells(html: Column) -> Column:
    """C8. array<array<string>>: the cells of the rows that have any, tags removed."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    clean = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"<[^>]+>", ""), F.lit(WS)), "\n", " ")
    return F.filter(F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), clean)), lambda r: F.size(r) > 0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def markdown(rows: Column, width: Column | None = None) -> Column:
    """C9. Cells as a markdown table: ragged rows padded (to width, where more rows are not given), blank cells one space, a
    separator only above a body."""

    def table(rows: Column, width: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.when(c == "", " ").otherwise(c)), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        lines = lambda made: F.when(F.size(made) > 1, F.concat(F.slice(made, 1, 1), F.array(rule), F.slice(made, F.lit(2), F.size(made) - 1))).otherwise(made)
        return F.when(F.size(rows) == 0, "").otherwise(F.array_join(bound(F.transform(rows, line), lines), "\n"))

    return bound(rows, lambda rows: bound(F.array_max(F.transform(rows, lambda r: F.size(r))) if width is None else width, lambda width: table(rows, width)))


def markdown_cells(md: Column) -> Column:
    """C10. array<array<string>>: cells of the table's rows, separator lines left out."""
    lines = F.filter(F.transform(F.split(md, "\n"), lambda x: F.trim(x, F.lit(WS))), lambda x: x.rlike(r"^\|") & ~x.rlike(r"^\|\s*[-:| ]+\|\s*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.trim(x, F.lit("|")), r"\|"), lambda c: F.trim(c, F.lit(WS))))


def merge_across_pages(tables: DataFrame) -> DataFrame:
    """C12. tables: doc_id, ord, page, section, x0, y0, x1, y1, figure_number, caption, n_cols. Neighbours chain when the
    next one begins at the top of the following page where the last one ended at the bottom, in the same section, with
    equal numbers, or compatible ones and as many columns. A chain keeps its first box and number and its last caption."""
    w = Window.partitionBy("doc_id").orderBy("page", "ord")
    p = F.lag(F.struct("page", "section", "figure_number", "y1", "n_cols")).over(w)
    blank = lambda c: F.nullif(c, F.lit(""))
    equal = F.coalesce(blank(F.col("p.figure_number")) == blank(F.col("figure_number")), F.lit(False))
    open_ = blank(F.col("p.figure_number")).isNull() | blank(F.col("figure_number")).isNull()
    chain = (
        (F.col("page") == F.col("p.page") + 1)
        & blank(F.col("p.section")).eqNullSafe(blank(F.col("section")))
        & (F.col("p.y1") >= PAGE_HEIGHT * BOTTOM_SHARE)
        & (F.col("y0") <= PAGE_HEIGHT * TOP_SHARE)
        & (equal | (open_ & (F.col("n_cols") > 0) & (F.col("n_cols") == F.col("p.n_cols"))))
    )
    marked = tables.withColumn("p", p).withColumn("new", F.when(F.coalesce(chain, F.lit(False)), 0).otherwise(1))
    parts = marked.withColumn("island", F.sum("new").over(w))
    at = F.struct("page", "ord")
    first = lambda c: F.min_by(c, at).alias(c)
    return parts.groupBy("doc_id", "island").agg(
        first("page"), first("x0"), first("y0"), first("x1"), first("y1"),
        F.min_by("figure_number", F.when(blank(F.col("figure_number")).isNotNull(), at)).alias("figure_number"),
        F.max_by("caption", F.when(blank(F.col("caption")).isNotNull(), at)).alias("caption"),
        F.count("*").alias("n_parts"), F.max("page").alias("last_page"),
    )


def vision_result(raw: Column) -> Column:
    """C15. struct<kind, caption> of a model's JSON answer, or of the first object without nesting in it; null without caption."""
    schema = "kind string, caption string"
    parsed = F.coalesce(
        F.when(F.trim(raw, F.lit(WS)).rlike(r"(?s)^\{.*\}$"), F.from_json(raw, schema)),
        F.from_json(F.nullif(F.regexp_extract(raw, r"(\{[^{}]*\})", 1), F.lit("")), schema),
    )
    kind = F.lower(F.trim(F.coalesce(F.nullif(parsed["kind"], F.lit("")), F.lit("figure"))))
    said = F.nullif(F.trim(parsed["caption"], F.lit(WS)), F.lit(""))
    normal = F.when(kind == "table", "table").when(kind.isin("diagram", "wiring", "schematic"), "diagram").when(kind == "photo", "photo").otherwise("figure")
    return F.when(said.isNotNull(), F.struct(normal.alias("kind"), said.alias("caption")))


def numbered_assets(assets: DataFrame) -> DataFrame:
    """C17. The first asset of each kind and number of a document."""
    w = Window.partitionBy("doc_id", "kind", "figure_number").orderBy("page", "sort_key", "asset_id")
    return assets.filter("figure_number is not null").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def forward_attach(refs: DataFrame, numbered: DataFrame) -> DataFrame:
    """C18. refs: doc_id, chunk_index, ref_no, kind, figure_number. Each numbered asset goes to the earliest chunk that cites
    it, and each place on a page is claimed once."""
    hits = refs.join(numbered, ["doc_id", "kind", "figure_number"])
    one = Window.partitionBy("doc_id", "kind", "figure_number").orderBy("chunk_index", "ref_no")
    place = Window.partitionBy("doc_id", "page", "x0", "y0", "x1", "y1").orderBy("chunk_index", "ref_no")
    first = hits.withColumn("n", F.row_number().over(one)).filter("n = 1")
    return first.withColumn("m", F.row_number().over(place)).filter("m = 1").select("doc_id", "chunk_index", "asset_id", "kind", "figure_number")


def reverse_attach(chunks: DataFrame, left: DataFrame) -> DataFrame:
    """C19. Numbered assets without a forward reference go to the first chunk that mentions the number anyhow."""
    mentions = lambda kind: F.transform(references(F.col("text"), kind), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("figure_number")))
    found = chunks.select("doc_id", "chunk_index", F.explode(F.concat(mentions("figure"), mentions("table"))).alias("m")).select("doc_id", "chunk_index", "m.*")
    w = Window.partitionBy("doc_id", "asset_id").orderBy("chunk_index")
    return found.join(left, ["doc_id", "kind", "figure_number"]).withColumn("n", F.row_number().over(w)).filter("n = 1").select("doc_id", "chunk_index", "asset_id", "kind", "figure_number")


def reading_order_attach(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """C20. chunks: doc_id, chunk_index, page, y0, y1, text. The chunk that ends closest above an asset on its page, else the
    latest chunk of the two pages before; pages are enumerated, so the join is on equality."""
    near = assets.select("doc_id", "asset_id", F.col("page").alias("a_page"), F.col("y0").alias("top"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - PAGES_BACK), F.col("page"))).alias("page"))
    pairs = near.join(chunks.filter(F.trim("text", F.lit(WS)) != "").select("doc_id", "page", "chunk_index", F.col("y0").alias("c_top"), "y1"), ["doc_id", "page"])
    here = (F.col("page") == F.col("a_page")) & (F.col("y1") <= F.col("top") + Y_TOLERANCE) & (F.col("c_top") <= F.col("top") + Y_TOLERANCE)
    rank = F.when(here, F.struct(F.lit(2).alias("tier"), F.col("y1").alias("a"), F.col("c_top").alias("b"), F.col("chunk_index").cast("double").alias("c"))).when(
        F.col("page") < F.col("a_page"), F.struct(F.lit(1).alias("tier"), F.col("page").cast("double").alias("a"), F.lit(0.0).alias("b"), F.col("chunk_index").cast("double").alias("c"))
    )
    return pairs.withColumn("rank", rank).filter("rank is not null").groupBy("doc_id", "asset_id").agg(F.max_by("chunk_index", "rank").alias("chunk_index"))


# --- queries -----------------------------------------------------------------------------------------------------------


def _refs(spark, sf_dir) -> DataFrame:
    r = views.ref_lines(spark, sf_dir)
    both = [r.select("doc_id", "chunk_index", F.posexplode(references(F.col("text"), k)).alias("ref_no", "figure_number"), F.lit(k).alias("kind")) for k in ("figure", "table")]
    return both[0].unionByName(both[1])


def _lines_with_html(spark, sf_dir) -> DataFrame:
    """A small HTML table for each order: a header and a row for each of its lines."""
    li = views.table(spark, sf_dir, "lineitem")
    row = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td><b>"), F.coalesce("l_returnflag", F.lit("")), F.lit("</b></td><td> "), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise(""), F.lit(" </td></tr>"))
    g = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    return g.select("l_orderkey", F.concat(F.lit("<table><tr><th>no</th><th>flag</th></tr>\n"), "rows", F.lit("</table>")).alias("html"))


def c01_caption_parse(spark, sf_dir):
    return views.caption_lines(spark, sf_dir).withColumn("c", caption(F.col("text"))).select("doc_id", "ord", "c.kind", "c.number", "c.description")


def c02_page_captions(spark, sf_dir):
    return page_captions(views.caption_lines(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("number").alias("first_number"))


def c03_caption_pairs(spark, sf_dir):
    a = views.assets(spark, sf_dir).withColumns({"y0": F.col("y0") - 160.0, "y1": F.col("y1") - 160.0})
    return pair_captions(page_captions(views.caption_lines(spark, sf_dir)), a).select("doc_id", "asset_id", "kind", "number")


def c04_figure_admission(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    p = a.select("doc_id", "page", F.col("asset_id").alias("ord"), (F.col("asset_id") % 3).alias("image_id"), "x0", "y0", (F.col("x0") + 40.0 + F.col("asset_id") % 60).alias("x1"), "y1", (F.col("asset_id") % 200).alias("px_w"), F.lit(100).alias("px_h"))
    return admit_figures(p).select("doc_id", "page", "ord", "n")


def c05_uncovered_figures(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    shifted = a.filter("kind = 'table'").withColumn("y0", F.col("y0") - 160.0 + F.col("doc_id") % 3 * 20.0).withColumn("y1", F.col("y1") - 160.0)
    return uncovered_figures(a.filter("kind = 'figure'"), shifted).select("doc_id", "asset_id")


def c08_html_cells(spark, sf_dir):
    cells = _lines_with_html(spark, sf_dir).withColumn("rows", html_cells(F.col("html")))
    return cells.select("l_orderkey", F.size("rows").alias("n_rows"), F.array_max(F.transform("rows", lambda r: F.size(r))).alias("n_cols"), F.size(F.filter(F.flatten("rows"), lambda c: c != "")).alias("n_filled"))


def c09_markdown(spark, sf_dir):
    return _lines_with_html(spark, sf_dir).select("l_orderkey", F.substring(markdown(html_cells(F.col("html"))), 1, SUMMARY_CHARS).alias("markdown"))


def c10_markdown_cells(spark, sf_dir):
    md = _lines_with_html(spark, sf_dir).select("l_orderkey", markdown_cells(markdown(html_cells(F.col("html")))).alias("rows"))
    return md.select("l_orderkey", F.size("rows").alias("n_rows"), F.array_max(F.transform("rows", lambda r: F.size(r))).alias("n_cols"), F.md5(F.array_join(F.flatten("rows"), "|")).alias("cells_md5"))


def c12_merge_tables(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    top = F.col("asset_id") % 2 == 0
    t = a.select(
        "doc_id", F.col("asset_id").alias("ord"), (F.col("asset_id") % 16777216 / 3).cast("int").alias("page"), F.lit(None).cast("string").alias("section"), "x0",
        F.when(top, 40.0).otherwise(100.0).alias("y0"), "x1", F.lit(760.0).alias("y1"), F.when(F.col("asset_id") % 5 == 0, F.lit("")).otherwise(F.concat((F.col("asset_id") % 16777216 / 9).cast("int").cast("string"), F.lit("-1"))).alias("figure_number"),
        F.when(F.col("asset_id") % 4 == 0, F.col("summary")).alias("caption"), (F.col("doc_id") % 3).cast("int").alias("n_cols"),
    )
    return merge_across_pages(t).select("doc_id", "island", "page", "last_page", "y0", "figure_number", "caption", "n_parts")


def c15_vision_json(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    said = F.concat(F.lit('{"kind": "'), F.element_at(F.array(*map(F.lit, ("Table", "wiring", "photo", "chart"))), (F.col("event_id") % 4 + 1).cast("int")), F.lit('", "caption": "'), F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_type")), F.lit('"}'))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Answer: "), said, F.lit(" done"))).when(F.col("event_id") % 7 == 0, "no json").otherwise(said)
    return e.select("event_id", vision_result(raw).alias("v")).select("event_id", "v.kind", "v.caption")


def c16_references(spark, sf_dir):
    return _refs(spark, sf_dir).select("doc_id", "chunk_index", "kind", "figure_number", "ref_no")


def c17_numbered_assets(spark, sf_dir):
    return numbered_assets(views.assets(spark, sf_dir)).select("doc_id", "kind", "figure_number", "asset_id")


def c18_forward_attach(spark, sf_dir):
    return forward_attach(_refs(spark, sf_dir), numbered_assets(views.assets(spark, sf_dir)))


def c19_reverse_attach(spark, sf_dir):
    return reverse_attach(views.ref_lines(spark, sf_dir), numbered_assets(views.assets(spark, sf_dir)).select("doc_id", "kind", "figure_number", "asset_id"))


def c20_reading_order_attach(spark, sf_dir):
    return reading_order_attach(views.ref_lines(spark, sf_dir), views.assets(spark, sf_dir))


def c21_orphan_chunks(spark, sf_dir):
    """Assets that no text cites, as chunks of their own."""
    a = views.assets(spark, sf_dir)
    attached = forward_attach(_refs(spark, sf_dir), numbered_assets(a))
    return a.join(attached.select("asset_id"), "asset_id", "left_anti").select("doc_id", "asset_id", "page", F.lit("").alias("text"))


def a09_index_payload(spark, sf_dir):
    """Each chunk with the sorted distinct types of the assets attached to it."""
    attached = reading_order_attach(views.ref_lines(spark, sf_dir), views.assets(spark, sf_dir)).join(views.assets(spark, sf_dir).select("asset_id", "kind"), "asset_id")
    kinds = attached.groupBy("doc_id", "chunk_index").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("asset_types"))
    return views.ref_lines(spark, sf_dir).join(kinds, ["doc_id", "chunk_index"], "left").select("doc_id", "chunk_index", "page", F.coalesce("asset_types", F.lit("")).alias("asset_types"))


QUERIES = {f.__name__: f for f in (
    c01_caption_parse, c02_page_captions, c03_caption_pairs, c04_figure_admission, c05_uncovered_figures, c08_html_cells, c09_markdown, c10_markdown_cells, c12_merge_tables, c15_vision_json,
    c16_references, c17_numbered_assets, c18_forward_attach, c19_reverse_attach, c20_reading_order_attach, c21_orphan_chunks, a09_index_payload,
)}

_CAP = "SELECT *, regexp_extract(text, '{0}', ['kind', 'a', 'b', 'd']) AS m FROM v_captions".format(CAPTION)
_CAPS = "SELECT *, CASE WHEN m.kind = '' THEN NULL WHEN regexp_matches(lower(m.kind), '^(图|fig)') THEN 'figure' ELSE 'table' END AS kind, m.a::BIGINT || '-' || m.b::BIGINT AS number, trim(m.d) AS description FROM cap WHERE m.kind <> ''"
_REF = r"SELECT doc_id, chunk_index, '{0}' AS kind, regexp_extract(text, '(?:{1})\s*(\d+)\s*[-–—]\s*(\d+)', 1)::BIGINT || '-' || regexp_extract(text, '(?:{1})\s*(\d+)\s*[-–—]\s*(\d+)', 2)::BIGINT AS figure_number, 0 AS ref_no FROM v_refs WHERE regexp_matches(text, '(?:{1})\s*\d+\s*[-–—]\s*\d+')"
_REFS = _REF.format("figure", r"图|(?i:figure|fig\.?)") + " UNION ALL " + _REF.format("table", "表|(?i:table)")
_NUMBERED = "SELECT * FROM v_assets WHERE figure_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, kind, figure_number ORDER BY page, sort_key, asset_id) = 1"
_FORWARD = "SELECT doc_id, chunk_index, asset_id, kind, figure_number FROM (SELECT * FROM {0} r JOIN nu USING (doc_id, kind, figure_number) QUALIFY row_number() OVER (PARTITION BY doc_id, kind, figure_number ORDER BY chunk_index, ref_no) = 1) QUALIFY row_number() OVER (PARTITION BY doc_id, page, x0, y0, x1, y1 ORDER BY chunk_index, ref_no) = 1"
_READING = """SELECT a.doc_id, a.asset_id, arg_max(c.chunk_index, CASE WHEN c.page = a.page THEN [2.0, c.y1, c.y0, c.chunk_index] ELSE [1.0, c.page, 0, c.chunk_index] END) AS chunk_index FROM v_assets a JOIN {0} c
  ON a.doc_id = c.doc_id AND c.page BETWEEN a.page - 2 AND a.page AND (c.page < a.page OR (c.y1 <= a.y0 + 4 AND c.y0 <= a.y0 + 4)) WHERE trim(c.text) <> '' GROUP BY a.doc_id, a.asset_id"""
_HTML = {"ro": "SELECT l_orderkey, l_linenumber::VARCHAR AS a, coalesce(l_returnflag, '') AS b, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE '' END AS c, l_linenumber FROM lineitem"}
_ISLANDS = {
    "t": """SELECT doc_id, asset_id AS ord, floor(asset_id % 16777216 / 3)::INT AS page, (CASE WHEN asset_id % 2 = 0 THEN 40.0 ELSE 100.0 END)::DOUBLE AS y0, 760.0 AS y1, CASE WHEN asset_id % 5 = 0 THEN NULL ELSE floor(asset_id % 16777216 / 9)::INT || '-1' END AS fn,
      CASE WHEN asset_id % 5 = 0 THEN '' ELSE floor(asset_id % 16777216 / 9)::INT || '-1' END AS figure_number, CASE WHEN asset_id % 4 = 0 THEN summary END AS caption, (doc_id % 3)::INT AS n_cols FROM v_assets""",
    "u": "SELECT *, CASE WHEN coalesce(page = lag(page) OVER w + 1 AND y0 <= 144 AND (coalesce(fn = lag(fn) OVER w, false) OR ((fn IS NULL OR lag(fn) OVER w IS NULL) AND n_cols > 0 AND n_cols = lag(n_cols) OVER w)), false) THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page, ord)",
    "i": "SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page, ord)::BIGINT AS island FROM u"}

ORACLES = {
    "c01_caption_parse": with_views("v_captions", more={"cap": _CAP, "k": _CAPS}, body="SELECT v.doc_id, v.ord, k.kind, k.number, k.description FROM v_captions v LEFT JOIN k USING (doc_id, ord)"),
    "c02_page_captions": with_views("v_captions", more={"cap": _CAP, "k": _CAPS}, body="SELECT doc_id, kind, count(*) AS n, min(number) AS first_number FROM k GROUP BY doc_id, kind"),
    "c03_caption_pairs": with_views("v_captions", "v_assets", more={"cap": _CAP, "k": _CAPS,
        "p": "SELECT a.doc_id, a.asset_id, k.kind, k.number, row_number() OVER (PARTITION BY k.doc_id, k.ord ORDER BY k.y0 - a.y1) AS n, row_number() OVER (PARTITION BY a.asset_id ORDER BY k.y0) AS m FROM k JOIN (SELECT * REPLACE (y1 - 160 AS y1) FROM v_assets) a ON a.doc_id = k.doc_id AND a.page = k.page AND a.kind = k.kind AND k.y0 - a.y1 BETWEEN 0 AND 80"},
        body="SELECT doc_id, asset_id, kind, number FROM p WHERE n = 1 AND m = 1"),
    "c04_figure_admission": with_views("v_assets", more={"p": "SELECT doc_id, page, asset_id AS ord, asset_id % 3 AS image_id, x0, y0, x0 + 40 + asset_id % 60 AS x1, y1, asset_id % 200 AS px_w FROM v_assets",
        "k": "SELECT * FROM p WHERE px_w >= 64 AND x1 - x0 >= 64 AND y1 - y0 >= 64 AND (x1 - x0) * (y1 - y0) <= 0.85 * 480000 QUALIFY row_number() OVER (PARTITION BY doc_id, page, image_id, x0, y0, x1, y1 ORDER BY ord) = 1"},
        body="SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS n FROM k QUALIFY n <= 20"),
    "c05_uncovered_figures": with_views("v_assets", more={"t": "SELECT doc_id, page, x0, x1, y0 - 160 + doc_id % 3 * 20 AS y0, y1 - 160 AS y1 FROM v_assets WHERE kind = 'table'"},
        body="SELECT doc_id, asset_id FROM v_assets f WHERE kind = 'figure' AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = f.doc_id AND t.page = f.page AND greatest(0, least(f.x1, t.x1) - greatest(f.x0, t.x0)) * greatest(0, least(f.y1, t.y1) - greatest(f.y0, t.y0)) / greatest(1, (f.x1 - f.x0) * (f.y1 - f.y0)) >= 0.35)"),
    "c08_html_cells": with_views(body="SELECT l_orderkey, (count(*) + 1)::INT AS n_rows, 3 AS n_cols, (2 + sum((a <> '')::INT + (b <> '')::INT + (c <> '')::INT))::INT AS n_filled FROM ro GROUP BY l_orderkey", more=_HTML),
    "c09_markdown": with_views(body="SELECT l_orderkey, substr('| no | flag |   |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || a || ' | ' || CASE WHEN b = '' THEN ' ' ELSE b END || ' | ' || CASE WHEN c = '' THEN ' ' ELSE c END || ' |', chr(10) ORDER BY l_linenumber, b, c), 1, 4000) AS markdown FROM ro GROUP BY l_orderkey", more=_HTML),
    "c10_markdown_cells": with_views(body="SELECT l_orderkey, (count(*) + 1)::INT AS n_rows, 3 AS n_cols, md5('no|flag||' || string_agg(a || '|' || b || '|' || c, '|' ORDER BY l_linenumber, b, c)) AS cells_md5 FROM ro GROUP BY l_orderkey", more=_HTML),
    "c12_merge_tables": with_views("v_assets", more=_ISLANDS, body="SELECT doc_id, island, arg_min(page, page::BIGINT * 1000000000 + ord % 16777216) AS page, max(page) AS last_page, arg_min(y0, page::BIGINT * 1000000000 + ord % 16777216) AS y0, arg_min(fn, page::BIGINT * 1000000000 + ord % 16777216) FILTER (fn IS NOT NULL) AS figure_number, arg_max(caption, page::BIGINT * 1000000000 + ord % 16777216) FILTER (caption <> '') AS caption, count(*) AS n_parts FROM i GROUP BY doc_id, island"),
    "c15_vision_json": "SELECT event_id, CASE WHEN ok THEN (['table', 'diagram', 'photo', 'figure'])[event_id % 4 + 1] END AS kind, CASE WHEN ok THEN event_type END AS caption FROM (SELECT *, event_id % 5 <> 0 AND (event_id % 3 = 0 OR event_id % 7 <> 0) AS ok FROM events)",
    "c16_references": with_views("v_refs", body=_REFS),
    "c17_numbered_assets": with_views("v_assets", more={"nu": _NUMBERED}, body="SELECT doc_id, kind, figure_number, asset_id FROM nu"),
    "c18_forward_attach": with_views("v_refs", "v_assets", more={"nu": _NUMBERED, "rf": _REFS}, body=_FORWARD.format("rf")),
    "c19_reverse_attach": with_views("v_refs", "v_assets", more={"nu": _NUMBERED, "rf": _REFS, "ev": "SELECT * FROM rf WHERE false", "dn": _FORWARD.format("ev")},
        body="SELECT doc_id, chunk_index, asset_id, kind, figure_number FROM rf JOIN (SELECT * FROM nu WHERE asset_id NOT IN (SELECT asset_id FROM dn)) USING (doc_id, kind, figure_number) QUALIFY row_number() OVER (PARTITION BY doc_id, asset_id ORDER BY chunk_index) = 1"),
    "c20_reading_order_attach": with_views("v_refs", "v_assets", body=_READING.format("v_refs")),
    "c21_orphan_chunks": with_views("v_refs", "v_assets", more={"nu": _NUMBERED, "rf": _REFS, "dn": _FORWARD.format("rf")}, body="SELECT doc_id, asset_id, page, '' AS text FROM v_assets WHERE asset_id NOT IN (SELECT asset_id FROM dn)"),
    "a09_index_payload": with_views("v_refs", "v_assets", more={"r": _READING.format("v_refs"), "k": "SELECT r.doc_id, r.chunk_index, string_agg(DISTINCT kind, ',' ORDER BY kind) AS asset_types FROM r JOIN v_assets USING (asset_id) GROUP BY ALL"},
        body="SELECT v.doc_id, v.chunk_index, page, coalesce(asset_types, '') AS asset_types FROM v_refs v LEFT JOIN k USING (doc_id, chunk_index)"),
}

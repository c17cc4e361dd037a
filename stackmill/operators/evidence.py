"""What a model is shown of evidence: caption fields and header lines of chunks, listings of past steps cut short, tables admitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.functions import text as T
from stackmill.operators.assets import SUMMARY_CHARS
from stackmill.plans import views
from stackmill.plans.views import with_views

#: Fixed values of compaction: listings that keep no snippet, and further ones; characters of a snippet, a summary and a short text.
READS = ("read_section", "read_pages", "read_neighbor_chunks")
SEARCHES = ("search_chunks", "lookup_toc", "lookup_asset")
BATCH = "search_chunks_batch"
SNIPPET, SUMMARY, SHORT_TEXT = 60, 300, 200
#: Least similarity that a header does not show, being as good as one.
SURE = 0.999
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ASSET = "array<struct<kind:string,figure_number:string,caption:string,figure_caption:string,vlm_caption:string>>"


def _field(assets: Column, name: str) -> Column:
    """The values of a field of the assets, stripped, in order, without nulls and blank ones."""
    return F.filter(F.transform(F.coalesce(assets, F.array().cast(ASSET)), lambda a: T.blank_to_null(a[name])), lambda x: x.isNotNull())


def caption_fields(assets: Column) -> Column:
    """E1. The captions of a chunk's assets by kind, as E2 takes them: struct of figure_captions, asset_captions and vlm_captions."""
    return F.struct(_field(assets, "figure_caption").alias("figure_captions"), _field(assets, "caption").alias("asset_captions"), _field(assets, "vlm_caption").alias("vlm_captions"))


def score_label(score: Column) -> Column:
    """' score=' and three places; '' for none, and for a similarity as good as one."""
    shown = score.isNotNull() & ~score.between(SURE, 1.0)
    return F.when(shown, F.format_string(" score=%.3f", score)).otherwise("")


def detailed_header(number: Column, name: Column, page: Column, section: Column, assets: Column, caption: Column, score: Column, chunk_id: Column, chunk_index: Column) -> Column:
    """E10, long form: number and name, then what there is of page, section, kinds, figure numbers, marks for assets and captions, score,
    id and place. A part whose column is null, or text empty, is left out; the place 0 is not."""
    part = lambda head, value: F.coalesce(F.concat(F.lit(head), F.nullif(value.cast("string"), F.lit(""))), F.lit(""))
    given = F.coalesce(assets, F.array().cast(ASSET))
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform(given, lambda a: F.nullif(a["kind"], F.lit(""))), lambda k: k.isNotNull())))
    said = lambda a: F.concat(*[F.coalesce(a[c], F.lit("")) for c in ("caption", "figure_caption", "vlm_caption")]) != ""
    captioned = (F.coalesce(caption, F.lit("")) != "") | F.exists(given, said)
    return F.concat(
        T.strip(F.concat(F.coalesce(F.concat(F.lit("["), number.cast("string"), F.lit("]")), F.lit("")), F.lit(" "), F.coalesce(name, F.lit("")))),
        part(" p.", page),
        part(" §", section),
        part(" assets=", F.array_join(kinds, ",")),
        part(" fig=", F.array_join(F.array_distinct(_field(given, "figure_number")), ",")),
        F.when(F.size(given) > 0, " visual=1").otherwise(""),
        F.when(captioned, " caption=1").otherwise(""),
        score_label(score),
        part(" id=", chunk_id),
        part(" idx=", chunk_index),
    )


def _note(action: Column, count: Column, more: Column) -> Column:
    return F.concat(F.lit("（历史步压缩 · "), action, F.lit(" · "), count.cast("string"), F.lit(" 条"), more, F.lit("）\n"))


def _listing(text: Column, action: Column) -> Column:
    """Blocks between blank lines: the first is the summary, the others a header line and a snippet."""
    parts = F.split(text, "\n\n")
    summary, read = T.strip(parts[0]), action.isin(*READS)

    # a block is stripped once and its header cut once, not again wherever they are used
    stripped = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda b: T.strip(b))
    headed = F.transform(stripped, lambda b: F.struct(b.alias("b"), F.substring_index(b, "\n", 1).alias("head")))
    snippet = lambda x: F.substring(T.strip(F.substring(x["b"], F.length(x["head"]) + 2, F.length(x["b"]))), 1, SNIPPET)
    alone = lambda x: read | (F.length(x["b"]) == F.length(x["head"]))
    blocks = F.transform(headed, lambda x: F.when(alone(x), T.strip(x["head"])).otherwise(F.concat(T.strip(x["head"]), F.lit("\n"), snippet(x))))
    clipped = F.concat(F.substring(summary, 1, SUMMARY), F.when(F.length(summary) > SUMMARY, "…").otherwise(""))
    whole = F.concat(_note(action, F.size(blocks), F.when(read, " · 正文见证据池").otherwise("")), summary, F.lit("\n\n"), F.array_join(blocks, "\n\n"))
    return F.when(F.size(blocks) == 0, clipped).otherwise(whole)


def _batch_listing(text: Column, action: Column) -> Column:
    """Lines: titles and hits stay, snippets are cut and set in."""
    lines = F.filter(F.transform(F.split(text, _LINE_ENDS), lambda x: F.struct(x.alias("line"), T.strip(x).alias("bare"))), lambda x: x["bare"] != "")
    hit = lambda x: x["bare"].startswith("[")
    title = lambda x: x["bare"].startswith("并行检索") | x["bare"].startswith("--- 检索") | (x["bare"] == "（无结果）")
    out = F.transform(lines, lambda x: F.when(title(x), x["bare"]).when(hit(x), F.rtrim(x["line"], F.lit(T.WS))).otherwise(F.concat(F.lit("    "), F.substring(x["bare"], 1, SNIPPET))))
    return F.concat(_note(action, F.size(F.filter(lines, hit)), F.lit("")), F.array_join(out, "\n"))


def compacted_listing(text: Column, action: Column) -> Column:
    """E16. What a past search or reading step keeps of its listing; null for other actions, and short texts whole."""
    known = action.isin(BATCH, *SEARCHES, *READS)
    return F.when(known & (F.length(text) <= SHORT_TEXT), text).when(action == BATCH, _batch_listing(text, action)).when(known, _listing(text, action))


def admitted_tables(tables: DataFrame) -> DataFrame:
    """C6. rows, cols, summary, x0, y0, x1, y1 -> the tables of two rows or two columns that have a summary and an area, their
    summaries cut at SUMMARY_CHARS. Nulls admit nothing."""
    cut = F.substring("summary", 1, SUMMARY_CHARS)
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    complete = F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull()
    return tables.withColumn("summary", cut).filter(((F.col("rows") >= 2) | (F.col("cols") >= 2)) & (T.strip(F.col("summary")) != "") & complete & (area > 0))


# --- queries -----------------------------------------------------------------------------------------------------------


def _page_chunks(spark, sf_dir) -> DataFrame:
    """A chunk for each page of a document, with the page's assets in order and captions that are partly blank."""
    lines = views.ref_lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.min_by("text", "chunk_index").alias("text"))
    a = views.assets(spark, sf_dir)
    caption = F.when(F.col("asset_id") % 5 == 0, "  ").when(F.col("asset_id") % 5 != 1, F.concat(F.lit(" "), "summary"))
    figure = F.when(F.col("asset_id") % 3 == 0, F.concat(F.lit("Figure "), "figure_number"))
    fields = F.struct("asset_id", F.struct("kind", "figure_number", caption.alias("caption"), figure.alias("figure_caption"), F.when(F.col("asset_id") % 4 == 0, "seen ").alias("vlm_caption")).alias("a"))
    nested = a.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(fields)), lambda x: x["a"]).cast(ASSET).alias("assets"))
    own = F.when(F.col("page") % 6 == 0, "").when(F.col("page") % 2 == 0, F.substring("text", 1, 20))
    return lines.join(nested, ["doc_id", "page"], "left").withColumn("caption", own)


def e01_caption_fields(spark, sf_dir):
    """The caption fields of the assets of every page, and what is indexed of them."""
    c = _page_chunks(spark, sf_dir).withColumn("f", caption_fields(F.col("assets")))
    merged = T.merged_captions(F.col("caption"), F.col("f.figure_captions"), F.col("f.asset_captions"), F.col("f.vlm_captions"))
    joined = [F.array_join(f"f.{k}", "|").alias(k) for k in ("figure_captions", "asset_captions", "vlm_captions")]
    return c.select("doc_id", "page", *joined, F.md5(merged).alias("merged_md5"))


def e10_detailed_header(spark, sf_dir):
    """The long header of every page as evidence."""
    c = _page_chunks(spark, sf_dir)
    score = F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("double")).when(F.col("doc_id") % 11 == 1, 1.0).otherwise((F.col("doc_id") % 97) / 97.0 * 1.3)
    section = F.when(F.col("page") % 3 == 0, "").when(F.col("page") % 3 == 1, F.concat(F.lit("Part "), F.col("page").cast("string")))
    head = detailed_header(F.col("page"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.when(F.col("page") % 7 != 0, F.col("page")), section, F.col("assets"), F.col("caption"), score, F.col("doc_id") * 16777216 + F.col("page"), F.col("page") - 1)
    return c.select("doc_id", "page", head.alias("header"))


def e16_listing_compaction(spark, sf_dir):
    """A listing of every document's lines, of another kind for every fourth document, as a past step keeps it."""
    lines = views.ref_lines(spark, sf_dir).withColumn("head", F.concat(F.lit("["), (F.col("chunk_index") + 1).cast("string"), F.lit("] doc-"), F.col("doc_id").cast("string"), F.lit(" p."), F.col("page").cast("string")))
    rows = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "head", "text"))).alias("ls"))
    action = F.element_at(F.array(*map(F.lit, ("search_chunks", "read_section", BATCH, "lookup_asset"))), (F.col("doc_id") % 4 + 1).cast("int"))
    n = F.size("ls").cast("string")
    listing = F.concat(F.lit("检索工具："), "action", F.lit("，命中 "), n, F.lit(" 条："), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("\n\n"), x["head"], F.lit("\n"), x["text"])), ""))
    batch = F.concat(F.lit("并行检索 2 路，合计命中 "), n, F.lit(" 条：\n\n--- 检索 1 ---"), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("\n  "), x["head"], F.lit(" \n    "), x["text"])), ""), F.lit("\n--- 检索 2 ---\n（无结果）"))
    made = rows.withColumn("action", action).withColumn("text", F.when(F.col("action") == BATCH, batch).otherwise(listing))
    kept = compacted_listing(F.col("text"), F.col("action"))
    return made.select("doc_id", "action", kept.alias("kept")).select("doc_id", "action", F.length("kept").alias("n_chars"), F.md5("kept").alias("listing_md5"))


def c06_table_admission(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    summary = F.when(a["asset_id"] % 7 == 0, " \n").otherwise(F.repeat("summary", F.lit(120)))
    tables = a.select("asset_id", (F.col("asset_id") % 4).alias("rows"), (F.col("asset_id") % 3).alias("cols"), summary.alias("summary"), "x0", "y0", F.when(F.col("asset_id") % 5 == 0, F.col("x0")).otherwise(F.col("x1")).alias("x1"), "y1")
    return admitted_tables(tables).select("asset_id", F.length("summary").alias("n_chars"), F.md5("summary").alias("summary_md5"))


QUERIES = {f.__name__: f for f in (c06_table_admission, e01_caption_fields, e10_detailed_header, e16_listing_compaction)}

_WS = r"E' \t\n\r\x0b\x0c'"
_PAGES = {
    "pa": f"""SELECT doc_id, page, asset_id, kind, figure_number, CASE WHEN asset_id % 5 = 0 THEN '  ' WHEN asset_id % 5 <> 1 THEN ' ' || summary END AS caption,
      CASE WHEN asset_id % 3 = 0 THEN 'Figure ' || figure_number END AS figure_caption, CASE WHEN asset_id % 4 = 0 THEN 'seen ' END AS vlm_caption FROM v_assets""",
    "pn": f"""SELECT doc_id, page, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, bool_or(coalesce(caption, '') || coalesce(figure_caption, '') || coalesce(vlm_caption, '') <> '') AS said,
      list(figure_number ORDER BY asset_id) FILTER (figure_number IS NOT NULL) AS figs,
      coalesce(list(trim(figure_caption, {_WS}) ORDER BY asset_id) FILTER (trim(figure_caption, {_WS}) <> ''), []) AS fc, coalesce(list(trim(caption, {_WS}) ORDER BY asset_id) FILTER (trim(caption, {_WS}) <> ''), []) AS ac,
      coalesce(list(trim(vlm_caption, {_WS}) ORDER BY asset_id) FILTER (trim(vlm_caption, {_WS}) <> ''), []) AS vc FROM pa GROUP BY doc_id, page""",
    "pc": "SELECT *, CASE WHEN page % 6 = 0 THEN '' WHEN page % 2 = 0 THEN substr(text, 1, 20) END AS own FROM (SELECT doc_id, page, arg_min(text, chunk_index) AS text FROM v_refs GROUP BY doc_id, page) LEFT JOIN pn USING (doc_id, page)",
    # captions of a page in order, each at its first place
    "pm": f"SELECT doc_id, page, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, page, list_filter([trim(own, {_WS})] || coalesce(fc, []) || coalesce(ac, []) || coalesce(vc, []), lambda x: x <> '') AS ps FROM pc)",
    "pt": "SELECT doc_id, page, string_agg(x, chr(10) ORDER BY i) AS merged FROM (SELECT doc_id, page, x, min(i) AS i FROM pm GROUP BY doc_id, page, x) GROUP BY doc_id, page",
}
_SNIP = f"substr(trim(text, {_WS}), 1, 60)"
_HEAD = "'[' || (chunk_index + 1) || '] doc-' || doc_id || ' p.' || page"

ORACLES = {
    "c06_table_admission": with_views("v_assets", more={"t": "SELECT *, CASE WHEN asset_id % 7 = 0 THEN '' ELSE substr(repeat(summary, 120), 1, 4000) END AS s FROM v_assets"},
        body=f"SELECT asset_id, length(s) AS n_chars, md5(s) AS summary_md5 FROM t WHERE (asset_id % 4 >= 2 OR asset_id % 3 >= 2) AND trim(s, {_WS}) <> '' AND asset_id % 5 <> 0"),
    "e01_caption_fields": with_views("v_assets", "v_refs", more=_PAGES,
        body="SELECT doc_id, page, coalesce(array_to_string(fc, '|'), '') AS figure_captions, coalesce(array_to_string(ac, '|'), '') AS asset_captions, coalesce(array_to_string(vc, '|'), '') AS vlm_captions, md5(coalesce(merged, '')) AS merged_md5 FROM pc LEFT JOIN pt USING (doc_id, page)"),
    "e10_detailed_header": with_views("v_assets", "v_refs", more={k: _PAGES[k] for k in ("pa", "pn", "pc")},
        body="""SELECT doc_id, page, '[' || page || '] doc-' || doc_id || CASE WHEN page % 7 <> 0 THEN ' p.' || page ELSE '' END || CASE WHEN page % 3 = 1 THEN ' §Part ' || page ELSE '' END
      || CASE WHEN kinds IS NULL THEN '' ELSE ' assets=' || kinds END || CASE WHEN figs IS NULL THEN '' ELSE ' fig=' || array_to_string(figs, ',') END || CASE WHEN kinds IS NULL THEN '' ELSE ' visual=1' END
      || CASE WHEN coalesce(own, '') <> '' OR coalesce(said, false) THEN ' caption=1' ELSE '' END || CASE WHEN doc_id % 11 <= 1 OR (doc_id % 97) / 97.0 * 1.3 BETWEEN 0.999 AND 1 THEN '' ELSE ' score=' || printf('%.3f', ((doc_id % 97) / 97.0 * 1.3)::DOUBLE) END
      || ' id=' || (doc_id * 16777216 + page) || ' idx=' || (page - 1) AS header FROM pc"""),
    "e16_listing_compaction": with_views("v_refs", more={
        "d": f"""SELECT doc_id, (['search_chunks', 'read_section', 'search_chunks_batch', 'lookup_asset'])[doc_id % 4 + 1] AS action, count(*) AS n,
      string_agg({_HEAD} || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_index) AS listed, string_agg('  ' || {_HEAD} || chr(32) || chr(10) || '    ' || text, chr(10) ORDER BY chunk_index) AS listed_batch, string_agg({_HEAD}, chr(10) || chr(10) ORDER BY chunk_index) AS heads,
      string_agg({_HEAD} || CASE WHEN {_SNIP} = '' THEN '' ELSE chr(10) || {_SNIP} END, chr(10) || chr(10) ORDER BY chunk_index) AS snips,
      string_agg('  ' || {_HEAD} || CASE WHEN {_SNIP} = '' THEN '' ELSE chr(10) || '    ' || {_SNIP} END, chr(10) ORDER BY chunk_index) AS batch FROM v_refs GROUP BY doc_id""",
        "s": "SELECT *, '检索工具：' || action || '，命中 ' || n || ' 条：' AS summary, '（历史步压缩 · ' || action || ' · ' || n || ' 条' AS note FROM d",
        "f": """SELECT *, CASE WHEN action = 'search_chunks_batch' THEN '并行检索 2 路，合计命中 ' || n || ' 条：' || chr(10) || chr(10) || '--- 检索 1 ---' || chr(10) || listed_batch || chr(10) || '--- 检索 2 ---' || chr(10) || '（无结果）'
      ELSE summary || chr(10) || chr(10) || listed END AS whole FROM s""",
        "k": """SELECT doc_id, action, CASE WHEN length(whole) <= 200 THEN whole WHEN action = 'search_chunks_batch' THEN note || '）' || chr(10) || '并行检索 2 路，合计命中 ' || n || ' 条：' || chr(10) || '--- 检索 1 ---' || chr(10) || batch || chr(10) || '--- 检索 2 ---' || chr(10) || '（无结果）'
      WHEN action = 'read_section' THEN note || ' · 正文见证据池）' || chr(10) || summary || chr(10) || chr(10) || heads ELSE note || '）' || chr(10) || summary || chr(10) || chr(10) || snips END AS kept FROM f"""},
        body="SELECT doc_id, action, length(kept) AS n_chars, md5(kept) AS listing_md5 FROM k"),
}

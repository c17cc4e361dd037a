"""What comes in with a request and what goes out with an answer: contents questions, filters with scope, public rows.

Requests are rows, so that a batch of them is parsed, checked and merged by column functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.functions.text import WS, upper
from stackmill.plans import views
from stackmill.plans.views import with_views

#: What names a chapter, what marks a term, words of navigation, trimmed marks, digits in order of value.
CHAPTER = r"第([一二三四五六七八九十百千零两\d]+)章"
TERM = r"[「“\"']([^」”\"']{2,40})[」”\"']|(?:关于|有关)\s*([^\s，,？?。!！]{2,30}?)(?:章|节|部分|章节)"
NAVIGATION = r"(?i)(?:第几页|哪一页|哪页|从哪页|从第几页|页码|多少页|目录|contents|table\s+of\s+contents|在哪一页|在哪页|哪页开始|从.*页开始|which\s+page|what\s+page|starts?\s+on\s+page|page\s+number|开始)"
MARKS = " ，,？?。!！"
NUMERALS = "零一二三四五六七八九"
#: Kinds of assets that a filter may name.
ASSET_TYPES = ("table", "figure")


def chapter_number(token: Column) -> Column:
    """H17. Digits above zero, or a numeral up to 九十; null for others."""
    n = F.translate(token, "两", "二")
    value = lambda c: F.instr(F.lit(NUMERALS), c) - 1
    first, last = F.substring(n, 1, 1), F.substring(n, -1, 1)
    digits = n.try_cast("int")
    two = F.length(n) == 2
    return (
        F.when(n.rlike(r"^\d+$"), F.when(digits > 0, digits))
        .when(n == "十", 10)
        .when(two & (first == "十") & (value(last) >= 0), 10 + value(last))
        .when(two & (last == "十") & (value(first) >= 0), value(first) * 10)
        .when((F.length(n) == 1) & (value(n) >= 0), value(n))
    )


def toc_query(question: Column) -> tuple[Column, Column]:
    """H17. (chapter, terms) of a contents question: the number of the chapter it names, or null; the chapter as written,
    quoted terms and subjects, and what remains without words of navigation, each once whatever its case."""
    text = F.trim(F.coalesce(question, F.lit("")), F.lit(WS))
    named = F.regexp_extract(text, CHAPTER, 0)
    marked = F.zip_with(F.regexp_extract_all(text, F.lit(TERM), 1), F.regexp_extract_all(text, F.lit(TERM), 2), lambda a, b: F.trim(F.when(a != "", a).otherwise(b), F.lit(WS)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, NAVIGATION, " "), CHAPTER, " "), r"\s+", " ")
    rest = F.trim(rest, F.lit(MARKS))
    found = F.filter(F.concat(F.array(named), marked, F.array(F.when(F.length(rest) >= 2, rest).otherwise(""))), lambda t: t != "")
    folded = F.transform(found, F.lower)
    return chapter_number(F.regexp_extract(text, CHAPTER, 1)), F.filter(found, lambda t, i: F.array_position(folded, F.lower(t)) == i + 1)


def toc_requests(questions: DataFrame) -> DataFrame:
    """query_id, question -> query_id, chapter, terms, as ``search.toc_scores`` takes them."""
    chapter, terms = toc_query(F.col("question"))
    return questions.select("query_id", chapter.alias("chapter"), terms.alias("terms"))


FIELDS = ("document_ids", "asset_types", "page_gte", "page_lte", "section_prefix", "section_contains")


def merged_filters(requests: DataFrame) -> DataFrame:
    """F4. Rows with an explicit and an inferred filter (structs of FIELDS, either may be null) and a scope (documents of the
    session; null or empty: no limit): each field from the explicit filter where it has one, else from the inferred one;
    the documents cut to the scope, which stands for them where the filter names none."""
    one = lambda f: F.coalesce(F.col(f"explicit.{f}"), F.col(f"inferred.{f}"))
    scoped = F.size(F.coalesce("scope", F.array().cast("array<bigint>"))) > 0
    ids = F.col("document_ids")
    cut = F.when(~scoped, ids).when(F.coalesce(F.size(ids), F.lit(0)) > 0, F.filter(ids, lambda d: F.array_contains("scope", d))).otherwise(F.col("scope"))
    return requests.withColumns({f: one(f) for f in FIELDS}).withColumn("document_ids", cut)


def filter_reasons(requests: DataFrame) -> DataFrame:
    """F6. reason (null: valid) of each request's explicit filter: a page below 1, a kind of asset that is none, pages in the
    wrong order, or documents of which none is in the scope. The first that holds is named."""
    f = lambda name: F.col(f"explicit.{name}")
    some = lambda a: F.coalesce(F.size(a), F.lit(-1)) > 0
    outside = some(f("document_ids")) & some(F.col("scope")) & ~F.arrays_overlap(f("document_ids"), F.col("scope"))
    reason = (
        F.when(F.least(f("page_gte"), f("page_lte")) < 1, "page")
        .when(F.exists(f("asset_types"), lambda t: ~t.isin(*ASSET_TYPES)), "asset_types")
        .when(f("page_gte") > f("page_lte"), "page_order")
        .when(outside, "scope")
    )
    return requests.withColumn("reason", reason)


def regions_of(regions: Column) -> Column:
    """D16. Regions with a page and a box of four numbers; null gives none."""
    good = F.filter(F.coalesce(regions, F.array().cast("array<struct<page:int,bbox:array<double>>>")), lambda r: r["page"].isNotNull() & (F.coalesce(F.size(r["bbox"]), F.lit(0)) == 4))
    return F.transform(good, lambda r: F.struct(r["page"].cast("int").alias("page"), r["bbox"].cast("array<double>").alias("bbox")))


def public_citations(chunks: DataFrame) -> DataFrame:
    """D16. What of a cited chunk leaves the engine."""
    return chunks.select("document_id", "document_name", "page", "section", "snippet", "score", regions_of(F.col("layout_regions")).alias("regions"))


EMBED = {"ref": "int", "sentence_index": "int", "document_id": "bigint", "document_name": "string", "page": "int", "type": "string", "url": "string", "asset_id": "bigint", "content_hash": "string", "regions": "array<struct<page:int,bbox:array<double>>>", "caption": "string"}


def public_embeds(embeds: DataFrame) -> DataFrame:
    """D16. What of an embed leaves the engine; columns it lacks are null, but for the type (page) and the regions (none)."""
    have = {c: F.col(c) if c in embeds.columns else F.lit(None).cast(t) for c, t in EMBED.items()}
    if "type" not in embeds.columns:
        have["type"] = F.lit("page")
    have["regions"] = F.coalesce(have["regions"], F.array().cast(EMBED["regions"]))
    return embeds.select(*[have[c].alias(c) for c in EMBED])


# --- queries -----------------------------------------------------------------------------------------------------------


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contents question of every benchmark item, in four forms: by chapter, by quoted words, by subject, by its whole text."""
    item = views.table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    word = lambda k: F.get(F.split("text", " "), F.lit(k))
    number = F.element_at(F.array(*map(F.lit, ("三", "十", "十二", "二十", "7", "两", "0", "百"))), (F.floor(F.col("item_id") / 4) % 8 + 1).cast("int"))
    question = (
        F.when(F.col("item_id") % 4 == 0, F.concat(F.lit(" 第"), number, F.lit("章从哪页开始？")))
        .when(F.col("item_id") % 4 == 1, F.concat(F.lit('Which page does "'), F.concat_ws(" ", word(0), word(1)), F.lit('" start, and "'), F.concat_ws(" ", upper(word(0)), upper(word(1))), F.lit('"?')))
        .when(F.col("item_id") % 4 == 2, F.concat(F.lit("关于"), word(0), F.lit("章节 目录 页码")))
        .otherwise(F.col("text"))
    )
    return item.select((F.col("item_id") * 50).alias("query_id"), question.alias("question"))


def h17_toc_query(spark, sf_dir):
    return toc_requests(questions(spark, sf_dir)).select("query_id", "chapter", F.size("terms").alias("n_terms"), F.concat_ws("|", "terms").alias("terms"))


def filter_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered request of every event: event_id, explicit, inferred, scope."""
    e = views.table(spark, sf_dir, "events").select("event_id", "user_id")
    k, u = F.col("event_id"), F.col("user_id")
    null = F.lit(None)
    empty = F.array().cast("array<bigint>")
    explicit = F.struct(
        F.when(k % 3 == 0, null).when(k % 7 == 0, empty).otherwise(F.array(k % 7, k % 11 + 3)).alias("document_ids"),
        F.when(k % 5 == 0, F.array(F.lit("table"))).when(k % 5 == 1, F.array(F.lit("figure"), F.lit("page"))).alias("asset_types"),
        F.when(k % 2 == 0, (k % 13).cast("int")).alias("page_gte"),
        F.when(k % 4 < 3, (k % 17 + 1).cast("int")).alias("page_lte"),
        F.when(k % 6 == 0, "Part").alias("section_prefix"),
        F.lit(None).cast("string").alias("section_contains"),
    )
    inferred = F.struct(
        F.when(k % 9 == 0, F.array(u % 5)).alias("document_ids"),
        F.array(F.lit("figure")).alias("asset_types"),
        F.lit(2).alias("page_gte"),
        F.lit(None).cast("int").alias("page_lte"),
        F.lit("Chapter").alias("section_prefix"),
        F.when(k % 10 == 0, "valve").alias("section_contains"),
    )
    scope = F.when(k % 4 == 0, null).when(k % 8 == 1, empty).otherwise(F.array(u % 7, u % 5 + 7))
    return e.select("event_id", explicit.alias("explicit"), F.when(k % 5 != 2, inferred).alias("inferred"), scope.alias("scope"))


_ids = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))


def f04_merged_filters(spark, sf_dir):
    """Empty where a field is null."""
    m = merged_filters(filter_requests(spark, sf_dir))
    return m.select("event_id", _ids("document_ids").alias("document_ids"), F.concat_ws(",", "asset_types").alias("asset_types"), "page_gte", "page_lte", "section_prefix", "section_contains")


def f06_filter_reasons(spark, sf_dir):
    return filter_reasons(filter_requests(spark, sf_dir)).select("event_id", F.col("reason").isNull().alias("valid"), "reason")


def d16_public(spark, sf_dir):
    """Public rows of every asset, as citation and as embed."""
    a = views.assets(spark, sf_dir)
    box = F.array("x0", "y0", "x1", "y1")
    regions = F.array(
        F.struct(F.col("page").alias("page"), F.when(F.col("asset_id") % 2 == 0, box).otherwise(F.slice(box, 1, 3)).alias("bbox")),
        F.struct(F.when(F.col("asset_id") % 3 != 0, F.col("page")).alias("page"), box.alias("bbox")),
    )
    cited = public_citations(a.select(
        F.col("doc_id").alias("document_id"), F.lit("doc").alias("document_name"), "page", F.col("kind").alias("section"), F.col("summary").alias("snippet"), F.col("asset_id").alias("score"),
        F.when(F.col("asset_id") % 5 != 0, regions).alias("layout_regions"), F.col("sort_key").alias("internal"),
    ))
    shown = public_embeds(a.select(F.lit(1).alias("ref"), F.col("doc_id").alias("document_id"), "page", F.col("kind").alias("type"), F.lit("u").alias("url"), "asset_id", F.col("summary").alias("caption"), F.col("sort_key").alias("internal")))
    cited = cited.select(F.lit("citation").alias("row_kind"), "document_id", F.col("score").alias("asset_id"), "page", F.col("section").alias("type"), F.col("snippet").alias("text"), F.size("regions").alias("n_regions"), F.coalesce(F.aggregate("regions", F.lit(0.0), lambda s, r: s + r["bbox"][1]), F.lit(0.0)).alias("top_sum"))
    return cited.unionByName(shown.select(F.lit("embed").alias("row_kind"), "document_id", "asset_id", "page", "type", F.col("caption").alias("text"), F.size("regions").alias("n_regions"), F.lit(0.0).alias("top_sum")))


QUERIES = {f.__name__: f for f in (h17_toc_query, f04_merged_filters, f06_filter_reasons, d16_public)}

_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_P = {"chapter": _quoted(CHAPTER), "term": _quoted(TERM), "nav": _quoted(NAVIGATION), "marks": _quoted(MARKS), "ws": "E' \\t\\n\\r\\x0b\\x0c'"}
#: question rows of ``questions``, then query_id, chapter and terms of each (H17).
TOC_REQUESTS = {
    "tq": r"""SELECT item_id * 50 AS query_id, CASE item_id % 4
        WHEN 0 THEN ' 第' || (['三', '十', '十二', '二十', '7', '两', '0', '百'])[((item_id // 4) % 8 + 1)::INT] || '章从哪页开始？'
        WHEN 1 THEN 'Which page does "' || array_to_string(w[1:2], ' ') || '" start, and "' || upper(array_to_string(w[1:2], ' ')) || '"?'
        WHEN 2 THEN '关于' || w[1] || '章节 目录 页码' ELSE text END AS question
      FROM (SELECT item_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), ' ') AS w FROM benchmark)""",
    "tp": "SELECT query_id, q, regexp_extract(q, {chapter}, 0) AS named, replace(regexp_extract(q, {chapter}, 1), '两', '二') AS tok, trim(regexp_replace(regexp_replace(regexp_replace(q, {nav}, ' ', 'g'), {chapter}, ' ', 'g'), '\\s+', ' ', 'g'), {marks}) AS rest FROM (SELECT query_id, trim(coalesce(question, ''), {ws}) AS q FROM tq)".format(**_P),
    "tf": "SELECT *, list_filter(list_concat([named], list_concat(list_transform(range(1, len(regexp_extract_all(q, {term}, 0)) + 1), lambda i: trim(coalesce(nullif(regexp_extract_all(q, {term}, 1)[i], ''), regexp_extract_all(q, {term}, 2)[i]), {ws})), [CASE WHEN length(rest) >= 2 THEN rest ELSE '' END])), lambda t: t <> '') AS found FROM tp".format(**_P),
    "rq": """SELECT query_id, CASE WHEN regexp_full_match(tok, '[0-9]+') THEN nullif(try_cast(tok AS INT), 0) WHEN tok = '十' THEN 10
        WHEN length(tok) = 2 AND tok[1] = '十' AND strpos('零一二三四五六七八九', tok[2]) > 0 THEN 9 + strpos('零一二三四五六七八九', tok[2])
        WHEN length(tok) = 2 AND tok[2] = '十' AND strpos('零一二三四五六七八九', tok[1]) > 0 THEN 10 * (strpos('零一二三四五六七八九', tok[1]) - 1)
        WHEN length(tok) = 1 AND strpos('零一二三四五六七八九', tok) > 0 THEN strpos('零一二三四五六七八九', tok) - 1 END::INT AS chapter,
      list_filter(found, lambda t, i: list_position(list_transform(found, lambda x: lower(x)), lower(t)) = i) AS terms FROM tf""",
}
_REQUESTS = """SELECT event_id,
    CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN []::BIGINT[] ELSE [event_id % 7, event_id % 11 + 3] END AS e_docs,
    CASE event_id % 5 WHEN 0 THEN ['table'] WHEN 1 THEN ['figure', 'page'] END AS e_types,
    CASE WHEN event_id % 2 = 0 THEN event_id % 13 END::INT AS e_gte, CASE WHEN event_id % 4 < 3 THEN event_id % 17 + 1 END::INT AS e_lte,
    CASE WHEN event_id % 6 = 0 THEN 'Part' END AS e_prefix, event_id % 5 <> 2 AS guessed, CASE WHEN event_id % 9 = 0 THEN [user_id % 5] END AS i_docs,
    CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 8 = 1 THEN []::BIGINT[] ELSE [user_id % 7, user_id % 5 + 7] END AS scope FROM events"""
_TOPS = "list_sum(list_transform(list_filter([CASE WHEN asset_id % 2 = 0 THEN y0 END, CASE WHEN asset_id % 3 <> 0 THEN y0 END], lambda v: v IS NOT NULL), lambda v: v))"
ORACLES = {
    "h17_toc_query": with_views(body="SELECT query_id, chapter, len(terms)::INT AS n_terms, array_to_string(terms, '|') AS terms FROM rq", more=TOC_REQUESTS),
    "f04_merged_filters": f"""WITH r AS ({_REQUESTS}), m AS (SELECT *, coalesce(e_docs, CASE WHEN guessed THEN i_docs END) AS docs FROM r)
      SELECT event_id, coalesce(array_to_string(CASE WHEN coalesce(len(scope), 0) = 0 THEN docs WHEN coalesce(len(docs), 0) > 0 THEN list_filter(docs, lambda d: list_contains(scope, d)) ELSE scope END, ','), '') AS document_ids,
        coalesce(array_to_string(coalesce(e_types, CASE WHEN guessed THEN ['figure'] END), ','), '') AS asset_types, coalesce(e_gte, CASE WHEN guessed THEN 2 END)::INT AS page_gte, e_lte AS page_lte,
        coalesce(e_prefix, CASE WHEN guessed THEN 'Chapter' END) AS section_prefix, CASE WHEN guessed AND event_id % 10 = 0 THEN 'valve' END AS section_contains FROM m""",
    "f06_filter_reasons": f"""WITH r AS ({_REQUESTS}), v AS (SELECT event_id, CASE WHEN e_gte < 1 OR e_lte < 1 THEN 'page' WHEN event_id % 5 = 1 THEN 'asset_types' WHEN e_gte > e_lte THEN 'page_order'
        WHEN len(e_docs) > 0 AND len(scope) > 0 AND NOT list_has_any(e_docs, scope) THEN 'scope' END AS reason FROM r) SELECT event_id, reason IS NULL AS valid, reason FROM v""",
    "d16_public": with_views("v_assets", body=f"""SELECT 'citation' AS row_kind, doc_id AS document_id, asset_id, page, kind AS type, summary AS text,
        (CASE WHEN asset_id % 5 = 0 THEN 0 ELSE (asset_id % 2 = 0)::INT + (asset_id % 3 <> 0)::INT END)::INT AS n_regions, (CASE WHEN asset_id % 5 = 0 THEN 0 ELSE coalesce({_TOPS}, 0) END)::DOUBLE AS top_sum FROM v_assets
      UNION ALL SELECT 'embed', doc_id, asset_id, page, kind, summary, 0::INT, 0::DOUBLE FROM v_assets"""),
}

"""Sentences, citations and their alignment with source assets; texts for indexing and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.functions import text as T
from stackmill.operators.search import cosine
from stackmill.plans import views
from stackmill.plans.views import with_views

#: Least similarity of an aligned sentence, sentences looked back for a table, length of a shown caption.
MIN_COSINE, LOOK_BACK, CAPTION_MAX = 0.42, 2, 120
#: Fixed patterns. _MARK separates sentences while a text is taken apart.
_MARK = "\x01"
MARKER = r"(?:\[\s*\d+\s*\]|【\s*\d+\s*】)"
GFM_RULE = r"^\|?[\s:-]+\|[\s|:-]+$"
VECTOR_DIMS = 16


def chunk_sentences(text: Column) -> Column:
    """D1. Parts after 。！？!?；; without blanks; a text without any is one part."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[。！？!?；;])"), lambda x: T.strip(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).when(T.strip(text) != "", F.array(T.strip(text))).otherwise(F.array().cast("array<string>"))


def answer_sentences(text: Column) -> Column:
    """D6, D7. Raw sentences of an answer, each with the citation markers that follow it. A full stop after a digit ends none."""
    marked = F.regexp_replace(T.strip(text), r"((?<![0-9])\.|[。！？!?;:；])[ \t\n\r]*", f"$1{_MARK}")
    pulled = F.regexp_replace(marked, f"{_MARK}((?:{MARKER}[ \\t\\n\\r]*)+)", f"$1{_MARK}")
    return F.filter(F.split(pulled, _MARK), lambda x: T.strip(x) != "")


def citation_refs(raw: Column) -> Column:
    """D8. Cited numbers, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(MARKER), F.lit(0)), lambda m: F.regexp_extract(m, r"\d+", 0).cast("int")))


def without_markers(raw: Column) -> Column:
    """D9."""
    return T.strip(F.regexp_replace(raw, MARKER, ""))


def renumbered(text: Column, n_sources: Column) -> Column:
    """D10. struct<text, used>: markers of existing sources numbered anew by first appearance, in their own brackets; used
    lists the old numbers in the new order. Markers of no source stay."""
    marks = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
    number = lambda m: F.regexp_extract(m, r"\d+", 0).cast("int")
    used = F.array_distinct(F.filter(F.transform(marks, number), lambda k: (k >= 1) & (k <= n_sources)))
    place = lambda m: F.array_position(used, number(m)).cast("string")
    fresh = F.transform(
        marks,
        lambda m: F.when(F.array_position(used, number(m)) == 0, m).when(m.startswith("【"), F.concat(F.lit("【"), place(m), F.lit("】"))).otherwise(F.concat(F.lit("["), place(m), F.lit("]"))),
    )
    rebuilt = F.array_join(F.zip_with(F.split(text, MARKER), fresh, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.struct(rebuilt.alias("text"), used.alias("used"))


def has_markdown_table(text: Column) -> Column:
    """D12. Two lines with two pipes or more, or a separator line among two lines or more."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: T.strip(x)), lambda x: x != "")
    piped = F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    return (F.size(lines) >= 2) & ((F.size(piped) >= 2) | F.exists(lines, lambda x: x.rlike(GFM_RULE)))


def dedupe_key(content_hash: Column, asset_id: Column, url: Column, doc_id: Column, page: Column) -> Column:
    """D14."""
    tag = lambda name, c: F.concat(F.lit(f"{name}:"), F.nullif(c, F.lit("")))
    return F.coalesce(tag("hash", content_hash), tag("asset", asset_id), tag("url", url), F.concat(F.lit("page:"), doc_id.cast("string"), F.lit(":"), page.cast("string")))


def embed_caption(figure_caption: Column, caption: Column, number: Column, kind: Column, section: Column) -> Column:
    """D15. The first caption there is, cut with an ellipsis; else a label from the number; else the section."""
    cut = lambda c: F.when(F.length(c) <= CAPTION_MAX, c).otherwise(F.concat(F.substring(c, 1, CAPTION_MAX - 1), F.lit("…")))
    label = F.concat(F.when(kind == "figure", "图").otherwise("表"), F.lit(" "), T.blank_to_null(number))
    return F.coalesce(cut(T.blank_to_null(figure_caption)), cut(T.blank_to_null(caption)), label, T.blank_to_null(section))


def hashed_vector(terms: Column, dims: int = VECTOR_DIMS) -> Column:
    """G1, G2. The default encoder: term counts by hash bucket, built without Python."""
    slot = F.transform(terms, lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dims)
    # the slots are bound once, not worked out again for every dimension
    counts = lambda slots: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(slots, lambda s: s == d)).cast("double"))
    return F.element_at(F.transform(F.array(slot), counts), 1)


def align(sentences: DataFrame, subs: DataFrame) -> DataFrame:
    """D11. sentences: answer_id, sentence_index, refs, vector. subs: answer_id, ref, vector. The sentence that cites the ref
    and is most similar to it, at least MIN_COSINE; the later one on equal similarity."""
    cited = sentences.select("answer_id", "sentence_index", F.explode("refs").alias("ref"), F.col("vector").alias("sv"))
    scored = cited.join(subs, ["answer_id", "ref"]).withColumn("score", F.round(cosine(F.col("sv"), F.col("vector")), 9))
    return scored.filter(F.col("score") >= MIN_COSINE).groupBy("answer_id", "ref").agg(F.max_by("sentence_index", F.struct("score", "sentence_index")).alias("sentence_index"), F.max("score").alias("score"))


# --- queries -----------------------------------------------------------------------------------------------------------


def answers(spark, sf_dir) -> DataFrame:
    """Assistant turns with a citation before each sentence end, and a table in every sixth conversation."""
    c = views.table(spark, sf_dir, "conversations").filter("role = 'assistant' and text is not null")
    body = F.split("text", r"\. ")
    cited = F.array_join(F.transform(body, lambda s, i: F.when(i < F.size(body) - 1, F.concat(s, F.lit("."), F.when(i % 3 == 2, F.concat(F.lit(" 【"), (i % 5 + 1).cast("string"), F.lit("】"))).otherwise(F.concat(F.lit(" ["), (i % 5 + 1).cast("string"), F.lit("]"))))).otherwise(s)), " ")
    table = F.when(F.col("conv_id") % 6 == 0, "\n| a | b |\n| --- | --- |\n| 1 | 2 |").otherwise("")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.concat(cited, table).alias("answer"))


def _sentences(spark, sf_dir) -> DataFrame:
    s = answers(spark, sf_dir).select("answer_id", F.posexplode(answer_sentences(F.col("answer"))).alias("sentence_index", "raw"))
    return s.withColumn("refs", citation_refs(F.col("raw")))


def _captioned(spark, sf_dir) -> DataFrame:
    r = views.ref_lines(spark, sf_dir)
    odd = F.col("chunk_index") % 2 == 1
    return r.select(
        "doc_id", "chunk_index", "page", F.when(F.col("chunk_index") % 7 == 3, F.lit("  ")).otherwise(F.col("text")).alias("text"), F.when(F.col("page") % 3 != 0, F.concat(F.lit("Part "), F.col("page").cast("string"))).alias("section"),
        F.when(odd, F.concat(F.lit(" "), F.substring_index("text", " ", 3))).alias("caption"),
        F.array(F.concat(F.lit("Fig "), F.col("page").cast("string")), F.lit(" ")).alias("figs"), F.array(F.when(odd, F.substring_index("text", " ", 3))).alias("caps"), F.array().cast("array<string>").alias("vlms"),
    ).withColumn("visual", F.when(F.col("chunk_index") % 5 == 0, "").otherwise(T.merged_captions(F.col("caption"), F.col("figs"), F.col("caps"), F.col("vlms"))))


def d01_chunk_sentences(spark, sf_dir):
    made = views.ref_lines(spark, sf_dir).select("doc_id", "chunk_index", F.posexplode(chunk_sentences(F.replace("text", F.lit(". "), F.lit("! ")))).alias("no", "s"))
    return made.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


def d06_answer_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir).select("answer_id", "sentence_index", F.md5(T.strip(F.col("raw"))).alias("raw_md5"))


def d08_citation_refs(spark, sf_dir):
    return _sentences(spark, sf_dir).select("answer_id", "sentence_index", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"), F.md5(without_markers(F.col("raw"))).alias("text_md5"))


def d10_renumber(spark, sf_dir):
    out = answers(spark, sf_dir).withColumn("r", renumbered(F.col("answer"), (F.col("answer_id") % 4 + 1).cast("int")))
    return out.select("answer_id", F.array_join(F.col("r.used").cast("array<string>"), ",").alias("used"), F.length("r.text").alias("n_chars"), F.array_join(F.transform(F.regexp_extract_all("r.text", F.lit(MARKER), F.lit(0)), lambda m: m), "").alias("markers"))


def d11_align(spark, sf_dir):
    s = _sentences(spark, sf_dir).withColumn("vector", hashed_vector(T.terms(F.col("raw"))))
    refs = answers(spark, sf_dir).select("answer_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("ref"))
    docs = views.table(spark, sf_dir, "documents")
    source = docs.select(F.col("doc_id").alias("d"), hashed_vector(T.terms(F.col("text"))).alias("vector"))
    refs = refs.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))  # one row
    subs = refs.withColumn("d", (F.col("answer_id") * 4 + F.col("ref")) % F.col("n")).join(source, "d").select("answer_id", "ref", "vector")
    return align(s, subs).withColumn("score", F.round("score", 6))


def d12_markdown_table(spark, sf_dir):
    return answers(spark, sf_dir).select("answer_id", has_markdown_table(F.col("answer")).alias("has_table"))


def d13_skip_table_embed(spark, sf_dir):
    """Sentences whose window of two sentences back and themselves shows a table."""
    w = Window.partitionBy("answer_id").orderBy("sentence_index").rowsBetween(-LOOK_BACK, 0)
    s = _sentences(spark, sf_dir).withColumn("near", F.array_join(F.collect_list("raw").over(w), "\n"))
    return s.select("answer_id", "sentence_index", (has_markdown_table(F.col("near")) & (F.size("refs") > 0)).alias("skip"))


def d14_embed_dedupe(spark, sf_dir):
    """Embeds in emit order; of equal keys the first stays."""
    a = views.assets(spark, sf_dir)
    key = dedupe_key(F.when(F.col("asset_id") % 3 == 0, F.md5("summary")), F.when(F.col("asset_id") % 5 == 0, F.col("figure_number")), F.lit(""), F.col("doc_id"), F.col("page"))
    w = Window.partitionBy("doc_id", "key").orderBy("sort_key", "asset_id")
    return a.withColumn("key", key).withColumn("n", F.row_number().over(w)).filter("n = 1").select("doc_id", "asset_id", "key")


def d15_embed_rows(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    cap = embed_caption(F.when(F.col("asset_id") % 3 == 0, F.repeat("summary", F.lit(4))), F.when(F.col("asset_id") % 3 == 1, F.lit(" ")), F.col("figure_number"), F.col("kind"), F.concat(F.lit("Part "), F.col("page").cast("string")))
    return a.select("asset_id", "page", F.when(F.col("kind") == "figure", "figure").otherwise("table").alias("type"), cap.alias("caption"))


def e02_merged_captions(spark, sf_dir):
    return _captioned(spark, sf_dir).select("doc_id", "chunk_index", T.merged_captions(F.col("caption"), F.col("figs"), F.col("caps"), F.col("vlms")).alias("visual"))


def e03_captions_in_text(spark, sf_dir):
    return _captioned(spark, sf_dir).select("doc_id", "chunk_index", T.captions_in_text(F.col("text"), F.filter("caps", lambda c: c.isNotNull())).alias("merged"))


def e04_index_texts(spark, sf_dir):
    """E4 to E7 for every chunk."""
    c = _captioned(spark, sf_dir)
    h = lambda x: F.md5(x)
    return c.select(
        "doc_id", "chunk_index", h(T.embedding_text(F.col("text"), F.col("section"), F.col("visual"))).alias("embedding"), h(T.rerank_text(F.col("text"), F.col("visual"))).alias("rerank"),
        h(T.display_snippet(F.col("text"), F.col("visual"))).alias("snippet"), h(T.context_body(F.col("text"), F.col("visual"))).alias("body"),
    )


def e09_score_label(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 11 == 0, "0.9995").otherwise((F.col("event_id") % 1000 / 1000).cast("string"))
    return e.select("event_id", T.score_label(raw).alias("label"))


def e14_token_estimate(spark, sf_dir):
    return views.ref_lines(spark, sf_dir).select("doc_id", "chunk_index", T.token_estimate(F.col("text")).alias("tokens"))


def e15_asset_number(spark, sf_dir):
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("图 ", "Table ", "fig. ", "", "No "))), (F.col("doc_id") % 5 + 1).cast("int")), F.lit("0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" – "), (F.col("asset_id") % 40).cast("string"))
    return views.assets(spark, sf_dir).select("asset_id", T.asset_number(raw).alias("p")).select("asset_id", "p.kind", "p.number")


def e17_contacts(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    phone = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("+86 138-0000-"), F.lpad(F.col("c_custkey").cast("string"), 4, "0"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("1390000"), F.lpad(F.col("c_custkey").cast("string"), 4, "0"))).otherwise("12345")
    return c.select("c_custkey", T.normal_phone(phone).alias("phone"), T.normal_email(F.concat(F.lit(" "), "c_name", F.lit("@X.Org "))).alias("email"), T.masked(F.when(F.col("c_custkey") % 4 == 0, "abc").when(F.col("c_custkey") % 4 == 1, "").otherwise(F.col("c_name"))).alias("masked"))


def g01_hashed_vectors(spark, sf_dir):
    b = views.body_blocks(spark, sf_dir)
    return b.select("doc_id", "block_no", F.array_join(F.transform(hashed_vector(T.terms(F.col("text"))), lambda x: x.cast("int").cast("string")), ",").alias("vector"))


QUERIES = {f.__name__: f for f in (
    d01_chunk_sentences, d06_answer_sentences, d08_citation_refs, d10_renumber, d11_align, d12_markdown_table, d13_skip_table_embed, d14_embed_dedupe, d15_embed_rows,
    e02_merged_captions, e03_captions_in_text, e04_index_texts, e09_score_label, e14_token_estimate, e15_asset_number, e17_contacts, g01_hashed_vectors,
)}

_W = r"E' \t\n\r\x0b\x0c'"
_MK = r"(?:\[\s*\d+\s*\]|【\s*\d+\s*】)"
_ANSWERS = {
    "a0": "SELECT conv_id * 100 + turn AS answer_id, conv_id, string_split(text, '. ') AS b FROM conversations WHERE role = 'assistant' AND text IS NOT NULL",
    "an": r"""SELECT answer_id, array_to_string(list_transform(b, lambda s, i: CASE WHEN i < len(b) THEN s || '.' || CASE WHEN (i - 1) % 3 = 2 THEN ' 【' || ((i - 1) % 5 + 1) || '】' ELSE ' [' || ((i - 1) % 5 + 1) || ']' END ELSE s END), ' ')
      || CASE WHEN conv_id % 6 = 0 THEN E'\n| a | b |\n| --- | --- |\n| 1 | 2 |' ELSE '' END AS answer FROM a0""",
    "s0": rf"""SELECT answer_id, list_filter(string_split(replace(regexp_replace(regexp_replace(regexp_replace(trim(answer, {_W}), '([0-9])\.', '\1' || chr(2), 'g'), '([.。！？!?;:；])[ \t\n\r]*', '\1' || chr(1), 'g'), chr(1) || '((?:{_MK}[ \t\n\r]*)+)', '\1' || chr(1), 'g'), chr(2), '.'), chr(1)), lambda x: trim(x, {_W}) <> '') AS ss FROM an""",
    "s1": "SELECT answer_id, unnest(ss) AS raw, generate_subscripts(ss, 1) - 1 AS sentence_index FROM s0",
    "s2": rf"SELECT *, list_transform(regexp_extract_all(raw, '{_MK}'), lambda m: regexp_extract(m, '\d+')::INT) AS r0 FROM s1",
    "se": "SELECT *, list_filter(r0, lambda x, i: list_position(r0, x) = i) AS refs FROM s2",
}
_HAS = rf"(len(list_filter(string_split({{0}}, chr(10)), lambda x: trim(x, {_W}) <> '')) >= 2 AND (len(list_filter(string_split({{0}}, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2 OR len(list_filter(string_split({{0}}, chr(10)), lambda x: trim(x, {_W}) <> '' AND regexp_matches(trim(x, {_W}), '{GFM_RULE}'))) > 0))"
_TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_VEC = "list_transform(range(0, 16), lambda d: len(list_filter(" + _TERMS + ", lambda t: ('0x' || substr(md5(t), 1, 4))::INT % 16 = d))::DOUBLE)"
_CAPTIONED = {
    "k0": "SELECT doc_id, chunk_index, page, CASE WHEN chunk_index % 7 = 3 THEN '  ' ELSE text END AS text, CASE WHEN page % 3 <> 0 THEN 'Part ' || page END AS section, CASE WHEN chunk_index % 2 = 1 THEN array_to_string(string_split(text, ' ')[1:3], ' ') END AS cap FROM v_refs",
    "k1": f"SELECT *, CASE WHEN trim(cap, {_W}) <> '' THEN trim(cap, {_W}) || chr(10) || 'Fig ' || page ELSE 'Fig ' || page END AS merged, CASE WHEN chunk_index % 5 = 0 THEN '' ELSE merged END AS visual, trim(text, {_W}) AS t FROM k0",
}
_BOTH = "CASE WHEN visual = '' THEN text WHEN t = '' THEN visual ELSE t || chr(10) || '{0}[visual] ' || visual END"

ORACLES = {
    "d01_chunk_sentences": with_views("v_refs", more={"x": "SELECT doc_id, chunk_index, unnest(string_split(regexp_replace(replace(text, '. ', '! '), '([。！？!?；;])', '\\1' || chr(1), 'g'), chr(1))) AS s FROM v_refs"}, body=f"SELECT doc_id, chunk_index, count(*) AS n, sum(length(trim(s, {_W})))::BIGINT AS chars FROM x WHERE trim(s, {_W}) <> '' GROUP BY ALL"),
    "d06_answer_sentences": with_views(more=_ANSWERS, body=f"SELECT answer_id, sentence_index, md5(trim(raw, {_W})) AS raw_md5 FROM s1"),
    "d08_citation_refs": with_views(more=_ANSWERS, body=f"SELECT answer_id, sentence_index, array_to_string(refs, ',') AS refs, md5(trim(regexp_replace(raw, '{_MK}', '', 'g'), {_W})) AS text_md5 FROM se"),
    "d10_renumber": with_views(more={"a0": _ANSWERS["a0"], "an": _ANSWERS["an"],
        "m": rf"SELECT answer_id, answer, answer_id % 4 + 1 AS n, regexp_extract_all(answer, '{_MK}') AS ms FROM an",
        "u": r"SELECT *, list_transform(ms, lambda x: regexp_extract(x, '\d+')::INT) AS ns, list_filter(ns, lambda x, i: x <= n AND list_position(ns, x) = i) AS us FROM m",
        "r": r"SELECT *, list_transform(ms, lambda x, i: CASE WHEN ns[i] > n THEN x WHEN x[1] = '【' THEN '【' || list_position(us, ns[i]) || '】' ELSE '[' || list_position(us, ns[i]) || ']' END) AS fs FROM u"},
        body="SELECT answer_id, array_to_string(us, ',') AS used, (length(answer) - length(array_to_string(ms, '')) + length(array_to_string(fs, '')))::INT AS n_chars, array_to_string(fs, '') AS markers FROM r"),
    "d11_align": with_views("v_body", more={**_ANSWERS, "sv": f"SELECT answer_id, sentence_index, unnest(refs) AS ref, {_VEC.format('raw')} AS v FROM se", "so": f"SELECT doc_id AS d, {_VEC.format('text')} AS v FROM documents",
        "sc": "SELECT sv.answer_id, sv.ref, sentence_index, round(coalesce(list_cosine_similarity(sv.v, so.v), 0), 9) AS score FROM sv JOIN so ON so.d = (sv.answer_id * 4 + sv.ref) % (SELECT count(*) FROM documents) WHERE sv.ref <= 4"},
        body="SELECT answer_id, ref, sentence_index, round(score, 6) AS score FROM sc WHERE score >= 0.42 QUALIFY row_number() OVER (PARTITION BY answer_id, ref ORDER BY score DESC, sentence_index DESC) = 1"),
    "d12_markdown_table": with_views(more=_ANSWERS, body=f"SELECT answer_id, {_HAS.format('answer')} AS has_table FROM an"),
    "d13_skip_table_embed": with_views(more={**_ANSWERS, "nw": "SELECT *, string_agg(raw, chr(10)) OVER (PARTITION BY answer_id ORDER BY sentence_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM se"}, body=f"SELECT answer_id, sentence_index, {_HAS.format('near')} AND len(refs) > 0 AS skip FROM nw"),
    "d14_embed_dedupe": with_views("v_assets", more={"k": "SELECT *, CASE WHEN asset_id % 3 = 0 THEN 'hash:' || md5(summary) WHEN asset_id % 5 = 0 AND figure_number IS NOT NULL THEN 'asset:' || figure_number ELSE 'page:' || doc_id || ':' || page END AS key FROM v_assets"}, body="SELECT doc_id, asset_id, key FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY sort_key, asset_id) = 1"),
    "d15_embed_rows": with_views("v_assets", more={"k": f"SELECT *, trim(repeat(summary, 4), {_W}) AS f FROM v_assets"}, body="SELECT asset_id, page, kind AS type, CASE WHEN asset_id % 3 = 0 AND f <> '' THEN CASE WHEN length(f) <= 120 THEN f ELSE substr(f, 1, 119) || '…' END WHEN figure_number IS NOT NULL THEN CASE WHEN kind = 'figure' THEN '图 ' ELSE '表 ' END || figure_number ELSE 'Part ' || page END AS caption FROM k"),
    "e02_merged_captions": with_views("v_refs", more=_CAPTIONED, body="SELECT doc_id, chunk_index, merged AS visual FROM k1"),
    "e03_captions_in_text": with_views("v_refs", more=_CAPTIONED, body=f"SELECT doc_id, chunk_index, cap IS NOT NULL AND contains(text, trim(cap, {_W})) AS merged FROM k1"),
    "e04_index_texts": with_views("v_refs", more=_CAPTIONED, body=f"SELECT doc_id, chunk_index, md5(CASE WHEN concat_ws(chr(10), section, nullif(t, ''), CASE WHEN visual <> '' THEN '[visual] ' || visual END) = '' THEN text ELSE concat_ws(chr(10), section, nullif(t, ''), CASE WHEN visual <> '' THEN '[visual] ' || visual END) END) AS embedding, md5({_BOTH.format(chr(39) + ' || chr(10) || ' + chr(39))}) AS rerank, md5(substr({_BOTH.format('')}, 1, 300)) AS snippet, md5(CASE WHEN t = '' AND visual = '' THEN text ELSE concat_ws(chr(10), nullif(t, ''), CASE WHEN visual <> '' THEN '[图像描述] ' || visual END) END) AS body FROM k1"),
    "e09_score_label": "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 1000 = 999 THEN NULL ELSE 'score=' || printf('%.3f', event_id % 1000 / 1000.0) END AS label FROM events",
    "e14_token_estimate": with_views("v_refs", body="SELECT doc_id, chunk_index, (CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '[^㐀-鿿]', '', 'g')) + greatest(1, (length(text) - length(regexp_replace(text, '[^㐀-鿿]', '', 'g')) + 3) // 4) END)::INT AS tokens FROM v_refs"),
    "e15_asset_number": with_views("v_assets", body="SELECT asset_id, (['figure', 'table', 'figure', NULL, NULL])[doc_id % 5 + 1] AS kind, CASE WHEN doc_id % 5 < 4 THEN (doc_id % 9 + 1) || '-' || (asset_id % 40) END AS number FROM v_assets"),
    "e17_contacts": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+861380000' || lpad(c_custkey::VARCHAR, 4, '0') WHEN 1 THEN '+861390000' || lpad(c_custkey::VARCHAR, 4, '0') END AS phone, lower(c_name) || '@x.org' AS email, CASE WHEN c_custkey % 4 = 0 THEN '****' WHEN c_custkey % 4 = 1 THEN '' ELSE '********' || right(c_name, 4) END AS masked FROM customer",
    "g01_hashed_vectors": with_views("v_body", more={"v": f"SELECT doc_id, block_no, {_VEC.format('text')} AS v FROM v_body"}, body="SELECT doc_id, block_no, array_to_string(list_transform(v, lambda x: x::INT::VARCHAR), ',') AS vector FROM v"),
}

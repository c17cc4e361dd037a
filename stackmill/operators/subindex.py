"""The sub-index of a chunk: its sentences that cite figures or tables, with their assets, and the gaps between them.

D2 (``ref_rows``) is native. D3 to D5 assign the assets that no sentence cites: to the text between two citing sentences
whose assets lie before and after them, else to the nearer of the two, else to the nearest citing sentence at all. Every
assignment moves the place of the sentence that got the asset, so the gaps of one chunk are a sequence; they run in Arrow
batches, one chunk at a time, and need no shuffle beyond the one that nests assets under their chunk.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from stackmill.operators import assets as C
from stackmill.plans import views
from stackmill.plans.views import with_views

_FIRST, _LAST = (-1, float("-inf")), (10**9, float("inf"))
_ENDS = re.compile(r"(?<=[。！？!?；;])")
_PATTERNS = {kind: [re.compile(p) for p in found] for kind, found in (("figure", C.FIGURE_REFS), ("table", C.TABLE_REFS))}
_NUMBER = re.compile(C.NUMBER)
SUB = ty.ArrayType(
    ty.StructType(
        [ty.StructField("sub_index", ty.IntegerType()), ty.StructField("kind", ty.StringType()), ty.StructField("text", ty.StringType()), ty.StructField("index_text", ty.StringType()), ty.StructField("asset_ids", ty.ArrayType(ty.LongType()))]
    )
)


def cited(sentence: str) -> list[tuple[str, str]]:
    """(kind, number) of a sentence's references, each once."""
    out: dict[tuple[str, str], None] = {}
    for kind, patterns in _PATTERNS.items():
        for p in patterns:
            for m in p.finditer(sentence):
                a, b = _NUMBER.search(m.group(0)).groups()
                out[kind, f"{int(a)}-{int(b)}"] = None
    return list(out)


def _apart(a: tuple, b: tuple) -> tuple:
    """Pages first, then points."""
    return tuple(abs(x - y) for x, y in zip(a, b))


def _indexed(text: str, captions: list[str]) -> str:
    """The text, followed by the captions that it does not hold yet."""
    for caption in captions:
        text = text.strip() if caption in text else "\n".join(x for x in (text.strip(), caption) if x)
    return text


def placed_assets(links: list[list[int]], between: list[bool], places: list[tuple]) -> list[list[int]]:
    """Members of every entry of a chunk. Entry 2 * r + 1 is the r-th citing sentence (links: the assets it cites), entry
    2 * r the text before it, and the last entry the text after all; between tells which of these texts there are.

    The assets that no sentence cites are dealt in order of the texts: those strictly between what the sentences on both
    sides hold belong to the text, or, where there is none, to the nearer sentence (the earlier one on a tie), which then
    reaches further. What lies in no such range joins the sentence whose last asset is nearest.
    """
    members: list[list[int]] = [[] for _ in between + links]
    members[1::2] = [list(dict.fromkeys(x)) for x in links]
    free = [j for j in range(len(places)) if not any(j in x for x in links)]
    first = lambda e: min((places[j] for j in members[e]), default=_LAST)
    last = lambda e: max((places[j] for j in members[e]), default=_FIRST)
    refs = range(1, len(members), 2)
    for e in range(0, len(members), 2):
        low, high = last(e - 1) if e - 1 in refs else _FIRST, first(e + 1) if e + 1 in refs else _LAST
        inside = [j for j in free if low < places[j] < high]
        free = [j for j in free if j not in inside]
        for j in inside:
            near = [(_apart(places[j], last(r) if r < e else first(r)), r) for r in (e - 1, e + 1) if r in refs]
            members[e if between[e // 2] or not near else min(near)[1]].append(j)
    for j in free:
        members[min((_apart(places[j], last(r)), r) for r in refs)[1]].append(j)
    return members


def sub_index(text: str | None, assets: list[dict]) -> list[dict]:
    """assets: asset_id, kind, number, page, y, caption in the chunk's order. Null or empty texts have no sentence. A text
    without any citing sentence gives one entry of its assets, without the text."""
    sentences = [s.strip() for s in _ENDS.split((text or "").strip()) if s.strip()]
    numbers = {(a["kind"], a["number"]): j for j, a in reversed(list(enumerate(assets))) if a["number"]}
    cites = {i: found for i, s in enumerate(sentences) if (found := cited(s))}
    edges = [-1, *cites, len(sentences)]
    texts = ["".join(sentences[a + 1 : b]).strip() for a, b in zip(edges, edges[1:])] if cites else [""]
    links = [[numbers[c] for c in found if c in numbers] for found in cites.values()]
    members = placed_assets(links, [t != "" for t in texts], [(a["page"], a["y"]) for a in assets])
    out = []
    for e, held in enumerate(members):
        if e % 2 == 0 and not held:
            continue
        body = sentences[list(cites)[e // 2]] if e % 2 else texts[e // 2]
        captions = [c for j in held if (c := (assets[j].get("caption") or "").strip())]
        out.append({"sub_index": len(out), "kind": "ref" if e % 2 else "gap", "text": body, "index_text": _indexed(body, captions), "asset_ids": [assets[j]["asset_id"] for j in held]})
    return out


@F.pandas_udf(SUB)
def sub_index_of(text: pd.Series, assets: pd.Series) -> pd.Series:
    return pd.Series([sub_index(t, [] if a is None else list(a)) for t, a in zip(text, assets)])


def ref_rows(sentences: DataFrame, numbered: DataFrame) -> DataFrame:
    """D2. sentences: doc_id, chunk_index, no, text -> kind, figure_number and the linked asset of every reference."""
    refs = [sentences.select("doc_id", "chunk_index", "no", F.posexplode(C.references(F.col("text"), k)).alias("ref_no", "figure_number"), F.lit(k).alias("kind")) for k in ("figure", "table")]
    return refs[0].unionByName(refs[1]).join(numbered.select("doc_id", "kind", "figure_number", "asset_id"), ["doc_id", "kind", "figure_number"], "left")


# --- queries -----------------------------------------------------------------------------------------------------------


def _nested(spark, sf_dir) -> DataFrame:
    """Chunks of a page's lines with the page's assets nested in order."""
    lines = views.ref_lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "! ").alias("text"))
    item = F.struct("asset_id", "kind", F.col("figure_number").alias("number"), "page", F.col("y0").alias("y"), F.col("summary").alias("caption"))
    a = views.assets(spark, sf_dir).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(item)).alias("assets"))
    return lines.join(a, ["doc_id", "page"], "left")


def d02_ref_rows(spark, sf_dir):
    s = views.ref_lines(spark, sf_dir).select("doc_id", "chunk_index", F.lit(0).alias("no"), "text")
    return ref_rows(s, C.numbered_assets(views.assets(spark, sf_dir))).select("doc_id", "chunk_index", "kind", "figure_number", "asset_id")


def d05_sub_index(spark, sf_dir):
    n = _nested(spark, sf_dir)
    out = n.select("doc_id", "page", F.explode(sub_index_of("text", "assets")).alias("s"))
    return out.select("doc_id", "page", "s.sub_index", "s.kind", F.array_join(F.col("s.asset_ids").cast("array<string>"), ",").alias("asset_ids"))


def d17_visual_assets(spark, sf_dir):
    """Assets of a chunk that are tables or figures and have an id."""
    n = _nested(spark, sf_dir)
    ok = F.filter(F.coalesce("assets", F.array().cast(n.schema["assets"].dataType)), lambda a: a["kind"].isin("table", "figure") & (a["asset_id"] % 3 != 0))
    return n.select("doc_id", "page", F.size(ok).alias("n"))


QUERIES = {f.__name__: f for f in (d02_ref_rows, d05_sub_index, d17_visual_assets)}

ORACLES = {
    "d02_ref_rows": with_views("v_refs", "v_assets", more={"nu": C._NUMBERED, "rf": C._REFS}, body="SELECT rf.doc_id, chunk_index, rf.kind, rf.figure_number, asset_id FROM rf LEFT JOIN nu ON nu.doc_id = rf.doc_id AND nu.kind = rf.kind AND nu.figure_number = rf.figure_number"),
    "d17_visual_assets": with_views("v_body", "v_assets", body="SELECT DISTINCT b.doc_id, b.page, coalesce(n, 0)::INT AS n FROM v_body b LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM v_assets WHERE asset_id % 3 <> 0 GROUP BY ALL) USING (doc_id, page)"),
}

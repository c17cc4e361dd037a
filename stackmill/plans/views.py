"""Derived tables over the given ones: manual-like blocks, bookmarks, assets, chunks and logs.

Each view exists twice with one meaning: a function (spark, sf_dir) -> DataFrame, and DuckDB SQL for the oracles.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points of a page.
PAGE_WIDTH, PAGE_HEIGHT = 600.0, 800.0
BLOCKS_PER_PAGE = 4


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share. Where none is configured, a temporary one in local mode
    (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stackmill-")
    return f"{base}/stackmill/{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def int_div(a: Column, n: int) -> Column:
    """Integer division of a non-negative column."""
    return F.floor(a / n).cast("int")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block_no (from 0), text: the lines of every document."""
    return lines_of(table(spark, sf_dir, "documents"), "source")


def lines_of(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("block_no", "text"))


def body_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines laid out four to a page: doc_id, block_no, page, x0, y0, x1, y1, text."""
    return laid_out(lines(spark, sf_dir))


def laid_out(lines: DataFrame) -> DataFrame:
    y0 = 90.0 + (F.col("block_no") % BLOCKS_PER_PAGE) * 160.0
    return lines.select(
        "doc_id", "block_no", (int_div(F.col("block_no"), BLOCKS_PER_PAGE) + 1).alias("page"),
        F.lit(50.0).alias("x0"), y0.alias("y0"), F.lit(550.0).alias("x1"), (y0 + 120.0).alias("y1"), "text",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """body_blocks with a running header (the source) and a page number on every page; those have block_no -1 and -2."""
    body = body_blocks(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (int_div(F.size(F.split("text", "\n")) - 1, BLOCKS_PER_PAGE) + 1).alias("pages"))
    pages = docs.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    at = lambda no, y0, y1, text: pages.select("doc_id", F.lit(no).alias("block_no"), "page", F.lit(50.0).alias("x0"), F.lit(y0).alias("y0"), F.lit(550.0).alias("x1"), F.lit(y1).alias("y1"), text.alias("text"))
    header = at(-1, 10.0, 40.0, F.col("source"))
    footer = at(-2, 760.0, 780.0, F.concat(F.lit("Page "), F.col("page").cast("string")))
    return body.unionByName(header).unionByName(footer)


def toc_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bookmark for every third line: doc_id, ord, level, title, page, y."""
    b = body_blocks(spark, sf_dir).filter(F.col("block_no") % 3 == 0)
    ord_ = int_div(F.col("block_no"), 3)
    return b.select("doc_id", ord_.alias("ord"), (ord_ % 3 + 1).alias("level"), F.substring_index("text", " ", 3).alias("title"), "page", F.col("y0").alias("y"))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", (int_div(F.size(F.split("text", "\n")) - 1, BLOCKS_PER_PAGE) + 1).alias("page_count"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset under every third line: doc_id, asset_id, kind, figure_number (null for every fourth), page, x0, y0, x1, y1, sort_key, summary."""
    return assets_of(body_blocks(spark, sf_dir))


def assets_of(blocks: DataFrame) -> DataFrame:
    b = blocks.filter(F.col("block_no") % 3 == 1)
    n = int_div(F.col("block_no"), 3)
    number = F.when(n % 4 != 3, F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("-"), (n + 1).cast("string")))
    return b.select(
        "doc_id", (F.col("doc_id") * 16777216 + F.col("block_no")).alias("asset_id"),
        F.when(n % 2 == 0, "figure").otherwise("table").alias("kind"), number.alias("figure_number"), "page",
        F.lit(100.0).alias("x0"), (F.col("y0") + 60.0).alias("y0"), F.lit(400.0).alias("x1"), (F.col("y0") + 140.0).alias("y1"),
        (F.col("y0") + 60.0).alias("sort_key"), F.substring("text", 1, 40).alias("summary"),
    )


def ref_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks that cite assets: doc_id, chunk_index, page, text. Every second line names a figure or table, in
    Chinese for every fifth document."""
    b = body_blocks(spark, sf_dir)
    n = int_div(F.col("block_no"), 3)
    number = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("-"), (n + 1).cast("string"))
    figure = n % 2 == 0
    cite = F.when(F.col("doc_id") % 5 == 0, F.concat(F.when(figure, "如图").otherwise("见表"), number)).otherwise(
        F.concat(F.when(figure, "see Figure ").otherwise("see Table "), number)
    )
    text = F.when(F.col("block_no") % 2 == 0, F.concat("text", F.lit(" "), cite, F.lit("."))).otherwise(F.col("text"))
    return b.select("doc_id", F.col("block_no").alias("chunk_index"), "page", "y0", "y1", text.alias("text"))


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for every bookmark, most of them captions: doc_id, page, y0, y1, x0, x1, text."""
    t = toc_raw(spark, sf_dir)
    label = F.element_at(F.array(*[F.lit(x) for x in ("Figure", "Table", "Fig.", "图", "表", "figure", "Note")]), (F.col("ord") % 7 + 1).cast("int"))
    dash = F.when(F.col("ord") % 2 == 0, "-").otherwise(" – ")
    text = F.concat(label, F.lit(" 0"), (F.col("doc_id") % 9 + 1).cast("string"), dash, (F.col("ord") + 1).cast("string"), F.lit(" "), F.col("title"))
    return t.select("doc_id", "ord", "page", F.lit(100.0).alias("x0"), (F.col("y") + 150.0).alias("y0"), F.lit(400.0).alias("x1"), (F.col("y") + 160.0).alias("y1"), text.alias("text"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests: the whole text of every benchmark item, under the id of a vector request (every 50th vector)."""
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") * 50).alias("query_id"), F.col("text").alias("query"))


_LINES = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_no FROM documents"
SQL = {
    "v_lines": _LINES,
    "v_body": "SELECT doc_id, block_no, (block_no // 4 + 1)::INT AS page, 50.0::DOUBLE AS x0, (90.0 + (block_no % 4) * 160.0)::DOUBLE AS y0, 550.0::DOUBLE AS x1, (210.0 + (block_no % 4) * 160.0)::DOUBLE AS y1, text FROM v_lines",
    "v_pages": "SELECT doc_id, source, ((len(string_split(text, chr(10))) - 1) // 4 + 1)::INT AS page_count FROM documents",
    "v_blocks": """SELECT * FROM v_body
      UNION ALL SELECT doc_id, -1, p::INT, 50.0, 10.0, 550.0, 40.0, source FROM (SELECT doc_id, source, unnest(range(1, page_count + 1)) AS p FROM v_pages)
      UNION ALL SELECT doc_id, -2, p::INT, 50.0, 760.0, 550.0, 780.0, 'Page ' || p FROM (SELECT doc_id, unnest(range(1, page_count + 1)) AS p FROM v_pages)""",
    "v_toc": "SELECT doc_id, block_no // 3 AS ord, (block_no // 3) % 3 + 1 AS level, array_to_string(string_split(text, ' ')[1:3], ' ') AS title, page, y0 AS y FROM v_body WHERE block_no % 3 = 0",
    "v_assets": """SELECT doc_id, doc_id * 16777216 + block_no AS asset_id, CASE WHEN (block_no // 3) % 2 = 0 THEN 'figure' ELSE 'table' END AS kind,
      CASE WHEN (block_no // 3) % 4 <> 3 THEN (doc_id % 9 + 1) || '-' || (block_no // 3 + 1) END AS figure_number, page,
      100.0::DOUBLE AS x0, y0 + 60 AS y0, 400.0::DOUBLE AS x1, y0 + 140 AS y1, y0 + 60 AS sort_key, substr(text, 1, 40) AS summary FROM v_body WHERE block_no % 3 = 1""",
    "v_refs": """SELECT doc_id, block_no AS chunk_index, page, y0, y1, CASE WHEN block_no % 2 = 0 THEN text || ' ' ||
      (CASE WHEN doc_id % 5 = 0 THEN (CASE WHEN (block_no // 3) % 2 = 0 THEN '如图' ELSE '见表' END) ELSE (CASE WHEN (block_no // 3) % 2 = 0 THEN 'see Figure ' ELSE 'see Table ' END) END)
      || (doc_id % 9 + 1) || '-' || (block_no // 3 + 1) || '.' ELSE text END AS text FROM v_body""",
    "v_captions": """SELECT doc_id, ord, page, 100.0::DOUBLE AS x0, y + 150 AS y0, 400.0::DOUBLE AS x1, y + 160 AS y1,
      (['Figure', 'Table', 'Fig.', '图', '表', 'figure', 'Note'])[ord % 7 + 1] || ' 0' || (doc_id % 9 + 1) || (CASE WHEN ord % 2 = 0 THEN '-' ELSE ' – ' END) || (ord + 1) || ' ' || title AS text FROM v_toc""",
    "v_queries": "SELECT item_id * 50 AS query_id, text AS query FROM benchmark",
}
_NEEDS = {"v_body": ("v_lines",), "v_blocks": ("v_body", "v_pages"), "v_toc": ("v_body",), "v_assets": ("v_body",), "v_refs": ("v_body",), "v_captions": ("v_toc",)}


def with_views(*names: str, body: str, more: dict[str, str] | None = None) -> str:
    """WITH clause of the named views (and what they need), further common tables, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({s})" for n, s in (more or {}).items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body

"""Chat formatting with typed content parts, by DataFrame functions only.

A conversation is a set of turns; a turn is a role and an ordered array of content parts. ``flatten_parts`` visits the
parts in order and turns each into text: text parts are escaped, image, audio and document parts become a placeholder
that names the kind and the running number of the attachment. Attachment references and the tokens that each placeholder
expands to are recorded beside the text. ``format_turns`` puts the turns of a conversation into the template

    <|turn|>ROLE\\nBODY<|end|>\\n

and records the loss mask as spans in code points over the formatted string. ``<`` and ``\\`` of texts are escaped as
``\\l`` and ``\\b``, so a text never holds a control string, and ``unescape`` gives the text back exactly.

Defined cases: null text, role or parts count as empty; a null conversation id is a conversation of its own; turns with
equal numbers come in order of role, then text; an empty table gives no rows; columns beside the named ones are ignored.
A part of an unknown kind is shown as a placeholder of that kind with no tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.llm.common import table

TURN, END = "<|turn|>", "<|end|>"
PART_TYPE = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens of a placeholder: image by tiles of PATCH x PATCH pixels, audio by second, document by page.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 512


def escape(col: Column) -> Column:
    """Reversible: afterwards every backslash starts \\b (a backslash) or \\l (a less-than sign)."""
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(col: Column) -> Column:
    """As escape; a line feed becomes \\n, since it ends the role in the template."""
    return F.replace(escape(col), F.lit("\n"), F.lit("\\n"))


def unescape_role(col: Column) -> Column:
    return unescape(F.replace(col, F.lit("\\n"), F.lit("\n")))


def expanded_tokens(part: Column) -> Column:
    """Tokens that the placeholder of a part stands for; 0 for text and unknown kinds, nulls count as 0."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    return (
        F.when(part["kind"] == "image", tiles)
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * TOKENS_PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def flatten_parts(parts: Column) -> Column:
    """struct<body, attachments: array<struct<no, kind, ref, tokens>>, tokens> of one turn's ordered parts."""
    parts = F.filter(F.coalesce(parts, F.array().cast(PART_TYPE)), lambda p: p.isNotNull())
    attached = F.filter(parts, lambda p: ~is_text(p))
    # the number of an attachment is its place among the attachments before it
    body = F.transform(
        parts,
        lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), escape(p["kind"]), F.lit(":"), (F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda q: ~is_text(q)))).cast("string"), F.lit("|>"))
        ),
    )
    records = F.transform(
        attached,
        lambda p, i: F.struct((i + 1).alias("no"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
    )
    return F.struct(
        F.array_join(body, "").alias("body"),
        records.alias("attachments"),
        F.aggregate(records, F.lit(0).cast("long"), lambda a, r: a + r["tokens"]).alias("tokens"),
    )


def as_parts(text: Column) -> Column:
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    return F.array(
        F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null("string", "ref"), null("int", "width"), null("int", "height"), null("double", "seconds"), null("int", "pages"))
    )


def format_turns(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, role, parts -> conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    Each turn is rendered where it is read; only the rendered turn is shuffled, once, by conversation.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    rendered = (
        turns.select("conv_id", "turn", role.alias("role"), flatten_parts(F.col("parts")).alias("flat"))
        .withColumn("head", F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")))
        .select(
            "conv_id",
            F.struct(
                "turn", "role",
                F.col("flat.body").alias("body"),
                "head",
                F.col("flat.attachments").alias("attachments"),
                F.col("flat.tokens").alias("tokens"),
            ).alias("t"),
        )
    )
    # equal turns and roles come in order of the text, not of its escaped form
    ordered = lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), unescape(t["body"]).alias("raw"), *[t[c].alias(c) for c in ("body", "head", "attachments", "tokens")])
    grouped = rendered.groupBy("conv_id").agg(F.sort_array(F.transform(F.collect_list("t"), ordered)).alias("ts"))
    piece = lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))
    # one pass over the turns: (characters so far, spans of the loss mask)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,len:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("len"))
        return F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END) + 1).cast("long").alias("at"),
            F.when(t["role"].isin(*trained_roles), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return grouped.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", piece), "").alias("formatted"),
        F.aggregate("ts", start, step)["spans"].alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    chunks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda c: c != "")
    return F.transform(
        chunks,
        lambda c: F.struct(
            unescape_role(F.substring_index(c, "\n", 1)).alias("role"),
            unescape(F.substring_index(F.substr(c, F.length(F.substring_index(c, "\n", 1)) + 2), END, 1)).alias("text"),
        ),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, and conversation -7, and reads roles, texts and the loss mask back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    out = format_turns(rows.unionByName(planted).withColumn("parts", as_parts(F.col("text"))))
    lines = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["len"].cast("int"))))
    return (
        out.withColumn("lines", lines)
        .withColumn("masked", F.array_join(masked, ""))
        .select(
            "conv_id",
            F.size("lines").cast("long").alias("n_turns"),
            F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("turns_sha256"),
            F.length("masked").cast("long").alias("loss_chars"),
            F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


_ESC = "replace(replace({0}, '\\', '\\b'), '<', '\\l')"
ORACLE_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length(replace({_ESC.format('role')}, chr(10), '\\n')) + 1 + length({_ESC.format('text')}) + 8)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

QUERIES = {"op10_chat_format": op10_chat_format}
ORACLES = {"op10_chat_format": ORACLE_SQL}

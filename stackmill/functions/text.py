"""Text functions: chunk splitting, analysis into terms, caption and header formatting, normalisation."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ty

CHUNK_SIZE, CHUNK_OVERLAP = 500, 80
WS = " \t\n\r\x0b\x0c"
#: Fixed pattern: citation markers of answers.
CITATION = r"\[\s*(\d+)\s*\]|【\s*(\d+)\s*】"


#: Where a piece may end, best first.
_MARKS = ("\n", "。", ". ")
_MARK, _BLANK_LINES = re.compile(r"\n|。|\. "), re.compile(r"\n{3,}")


def chunk_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[int, int]]:
    """B25. (start, stop) of the pieces of a stripped text. The places where pieces may stop are listed once, a sorted list
    for each mark; a piece then takes the last one of the best mark that has any in its second half."""
    stops: dict[str, list[int]] = {mark: [] for mark in _MARKS}
    for found in _MARK.finditer(text):
        stops[found.group()].append(found.start() + 1)
    start = stop = 0
    while stop < len(text):
        least, stop = start + size // 2, min(start + size, len(text))
        if stop < len(text):
            # a mark lies within the piece as a whole, though a piece stops after the mark's first character
            last = ((places, bisect_right(places, stop + 1 - len(mark)) - 1) for mark, places in stops.items())
            stop = next((places[k] for places, k in last if k >= 0 and places[k] > least), stop)
        yield start, stop
        start = max(stop - overlap, start + 1)


def chunk_texts(text: str | None) -> list[dict]:
    """Offsets and stripped texts of the pieces that are not blank; null or blank texts have none."""
    text = _BLANK_LINES.sub("\n\n", text or "").strip()
    spans = ((start, text[start:stop].strip()) for start, stop in chunk_spans(text))
    return [{"offset": start, "text": piece} for start, piece in spans if piece]


_PIECES = ty.ArrayType(ty.StructType([ty.StructField("offset", ty.IntegerType()), ty.StructField("text", ty.StringType())]))


@F.pandas_udf(_PIECES)
def chunk_pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(chunk_texts)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: Letters whose upper case is several letters (ß: SS), and the one that stands for each.
_ONE_UPPER = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1}


def upper(text: Column) -> Column:
    """Upper case, one letter for each letter."""
    one = F.create_map(*[F.lit(x) for kv in _ONE_UPPER.items() for x in kv])
    each = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(one, c), F.upper(c))), "")
    return F.when(text.rlike("[" + "".join(_ONE_UPPER) + "]"), each).otherwise(F.upper(text))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def merged_captions(caption: Column, figure: Column, asset: Column, vision: Column) -> Column:
    """E2. Distinct captions in order: the chunk's, then figure, asset and vision captions (arrays); '' if there is none."""
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x, F.lit(WS))), lambda x: x.isNotNull() & (x != ""))
    parts = F.concat(clean(F.array(caption)), clean(figure), clean(asset), clean(vision))
    return F.array_join(F.array_distinct(parts), "\n")


def captions_in_text(text: Column, captions: Column) -> Column:
    """E3. Whether there are captions and the text holds each that is not blank."""
    return (F.size(captions) > 0) & F.forall(captions, lambda c: F.coalesce(F.contains(text, F.trim(c, F.lit(WS))), F.lit(True)))


def embedding_text(text: Column, section: Column, visual: Column) -> Column:
    """E4."""
    joined = F.concat_ws("\n", F.nullif(section, F.lit("")), blank_to_null(text), F.when(visual != "", F.concat(F.lit("[visual] "), visual)))
    return F.when(joined == "", text).otherwise(joined)


def rerank_text(text: Column, visual: Column) -> Column:
    """E5."""
    return F.when(visual == "", text).when(strip(text) == "", visual).otherwise(F.concat(strip(text), F.lit("\n\n[visual] "), visual))


def display_snippet(text: Column, visual: Column, limit: int = 300) -> Column:
    """E6."""
    both = F.when(visual == "", text).when(strip(text) == "", visual).otherwise(F.concat(strip(text), F.lit("\n[visual] "), visual))
    return F.substring(both, 1, limit)


def context_body(text: Column, visual: Column) -> Column:
    """E7."""
    joined = F.concat_ws("\n", blank_to_null(text), F.when(visual != "", F.concat(F.lit("[图像描述] "), visual)))
    return F.when(joined == "", text).otherwise(joined)


def score_label(score: Column) -> Column:
    """E9. Three decimals; null for no number and for scores from 0.999 to 1."""
    value = score.try_cast("double")
    return F.when(value.isNotNull() & ~((value >= 0.999) & (value <= 1.0)), F.concat(F.lit("score="), F.format_string("%.3f", value)))


def token_estimate(text: Column) -> Column:
    """E14. CJK characters, and a quarter of the rest rounded up (at least one); 0 for an empty text."""
    cjk = F.length(F.regexp_replace(text, "[^㐀-鿿]", ""))
    return F.when(F.length(text) == 0, 0).otherwise(cjk + F.greatest(F.lit(1), F.floor((F.length(text) - cjk + 3) / 4).cast("int")))


def chunk_header(name: Column, page: Column, section: Column, types: Column, has_assets: Column) -> Column:
    """E10, short form."""
    return F.concat(
        name,
        F.coalesce(F.concat(F.lit(" p."), page.cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit(" §"), F.nullif(section, F.lit(""))), F.lit("")),
        F.when(F.size(types) > 0, F.concat(F.lit(" assets="), F.array_join(types, ","))).otherwise(""),
        F.when(has_assets, " (visual)").otherwise(""),
    )


def asset_number(raw: Column) -> Column:
    """E15. '图 4-07', 'table 4 - 7' or '4-7' as kind (null without label) and number without leading zeros."""
    p = r"^(?i)\s*(图|表|figure|fig\.?|table)?\s*(\d+)\s*[-–—]\s*(\d+)\s*$"
    label, a, b = (F.regexp_extract(raw, p, k) for k in (1, 2, 3))
    return F.when(a != "", F.struct(F.when(F.lower(label).rlike("^(图|fig)"), "figure").when(label != "", "table").alias("kind"), F.concat(a.cast("bigint").cast("string"), F.lit("-"), b.cast("bigint").cast("string")).alias("number")))


def normal_phone(raw: Column) -> Column:
    """E17. '+86' and the eleven digits of a mobile number, whatever separators and prefix it was written with; else null."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when(digits.rlike(r"^86\d{11}$"), F.concat(F.lit("+"), digits)).when(digits.rlike(r"^1\d{10}$"), F.concat(F.lit("+86"), digits))


def normal_email(raw: Column) -> Column:
    return F.lower(strip(raw))


def masked(secret: Column) -> Column:
    """E18. All but the last four characters hidden; short secrets wholly."""
    return F.when(F.coalesce(F.length(secret), F.lit(0)) == 0, "").when(F.length(secret) <= 4, "****").otherwise(F.concat(F.lit("*" * 8), F.right(secret, F.lit(4))))

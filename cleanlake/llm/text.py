"""Column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import match_ranges

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and no other letter changed."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two words that stand for a row: rows with the same id and text share them, also where either is null."""
    return [F.xxhash64(doc_id, text).alias("_k1"), F.xxhash64(text, F.lit(1), doc_id).alias("_k2")]


def span_list(text: Column, pattern: str, group: int = 0, least: int = 0, must: tuple[str, ...] = ()) -> Column:
    """array<struct<start,end>>: code-point ranges of the leftmost non-overlapping matches of pattern in text; none for null.

    Matches whose `group` has fewer than `least` code points, or holds no match of one of `must`, are left out. The
    pattern must match the text of its own matches in the same way, that is, look at nothing around them.
    """
    part = lambda m: F.regexp_extract(m, pattern, group) if group else m
    found = match_ranges(text, pattern, lambda m, begin, end: F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), m.alias("match")))

    def good(x: Column) -> Column:
        out = F.length(part(x["match"])) >= least
        for m in must:
            out = out & part(x["match"]).rlike(m)
        return out

    if least or must:
        found = F.filter(found, good)
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>"))

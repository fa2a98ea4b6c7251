"""HTML documents as tables: a row for each start tag, a row for each attribute."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import LOWER, START, Scan, lists, ranges

ATTRIBUTES = "array<struct<name:string,raw_name:string,raw_value:string,value:string,name_at:bigint,name_end:bigint>>"
#: A start tag: its number, name as standardised and as written, the bytes where it begins and ends, where its raw text ends, that text if it
#: is a script or style, whether it ends in `/>`, its attributes, and how many base elements stand before it.
TAG = f"struct<pos:bigint,tag:string,raw_tag:string,at:bigint,open_end:bigint,body_end:bigint,body:string,closing:boolean,attrs:{ATTRIBUTES},bases:bigint,doc:binary>"
#: Bytes of documents that are read at once (one document may be longer).
TOGETHER = 1 << 20


def as_bytes(text: Column) -> Column:
    """text with a character for each of its UTF-8 bytes, so that positions are byte offsets."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _tags(data: bytes, ends: np.ndarray, matter: frozenset[str] | None) -> pa.Array:
    """A list of TAG for each document. With matter, only tags of such a name with attributes, those with an attribute
    named on.. or a colon in a value, base elements, and scripts and styles with text."""
    scan, names = Scan(data, ends), ("script", "style")
    tokens = scan.real[scan.kind[scan.real] == START]
    owner, node = scan.attributes_of(tokens)
    sizes = np.bincount(owner, minlength=len(tokens))
    is_base = np.isin(tokens, scan.named("base", START))
    document = np.searchsorted(ends, scan.at[tokens], side="right")
    before = np.cumsum(is_base) - is_base
    first = np.searchsorted(document, np.arange(len(ends)))  # of each document
    bases = before - np.append(before, 0)[first][document] if len(tokens) else before
    inner = np.zeros(len(tokens), bool)
    for name in names:
        inner |= np.isin(tokens, scan.named(name, START))
    inner &= scan.body_end[tokens] > scan.end[tokens]
    if matter is not None:
        n, begin, end = scan.node[node], *scan.node_value[:, node]
        colons = np.flatnonzero(scan.buf == 58)
        odd = (LOWER[scan.buf[n]] == 111) & (LOWER[scan.buf[n + 1]] == 110) & (scan.node_name_end[node] - n > 1)
        odd |= np.searchsorted(colons, begin) < np.searchsorted(colons, end)
        known = np.zeros(len(tokens), bool)
        for name in matter:
            known |= np.isin(tokens, scan.named(name, START))
        keep = inner | is_base | (known & (sizes > 0))
        keep[owner[odd]] = True
        node = node[keep[owner]]
        tokens, sizes, document, bases, inner = (x[keep] for x in (tokens, sizes, document, bases, inner))
    begin, end = scan.node_value[:, node]
    name_begin, name_end = scan.node[node], scan.node_name_end[node]
    none = begin < 0
    quote = np.where(none, 0, scan.buf[begin - 1])
    quoted = ~none & ((quote == 34) | (quote == 39)) & (scan.buf[end.clip(min=0)] == quote) & (begin - 1 > name_end)
    raw = ranges(scan.buf, np.where(none, 0, begin - quoted), np.where(none, 0, end + quoted))
    value = ranges(scan.buf, np.where(none, 0, begin), np.where(none, 0, end))
    doc_at = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    base_of = lambda i: doc_at[document[i]]
    of_attribute = np.repeat(np.arange(len(tokens)), sizes)
    columns = [ranges(scan.buf, name_begin, name_end, lower=True), ranges(scan.buf, name_begin, name_end), raw, value, pa.array(name_begin - base_of(of_attribute)), pa.array(name_end - base_of(of_attribute))]
    attrs = lists(pa.StructArray.from_arrays(columns, ["name", "raw_name", "raw_value", "value", "name_at", "name_end"]), sizes)
    per = np.bincount(document, minlength=len(ends))
    shift, count = base_of(slice(None)), np.cumsum(per) - per
    fields = {
        "pos": pa.array(np.arange(len(tokens)) - count[document]), "tag": ranges(scan.buf, *scan.name[:, tokens], lower=True), "raw_tag": ranges(scan.buf, *scan.name[:, tokens]),
        "at": pa.array(scan.at[tokens] - shift), "open_end": pa.array(scan.end[tokens] - shift), "body_end": pa.array(scan.body_end[tokens] - shift),
        "body": ranges(scan.buf, scan.end[tokens], scan.body_end[tokens], missing=~inner), "closing": pa.array(scan.closing[tokens]), "attrs": attrs, "bases": pa.array(bases.astype(np.int64)), "doc": pa.nulls(len(tokens), pa.binary()),
    }
    return lists(pa.StructArray.from_arrays(list(fields.values()), list(fields)), per)


def list_tags(html: pa.Array, matter: frozenset[str] | None = None) -> pa.Array:
    """The start tags of documents (strings) in order, a list of TAG for each; null for null. With matter, those alone that it says."""
    sizes, out, at = np.asarray(pc.fill_null(pc.binary_length(html), 0), np.int64), [], 0
    part = np.maximum(np.cumsum(sizes) - sizes, 0) // TOGETHER
    for end in (*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(html)):
        if end > at:
            texts = html.slice(at, end - at)
            data = b"".join(pc.fill_null(texts.cast(pa.binary()), b"").to_pylist())
            out.append(_tags(data, np.cumsum(sizes[at:end]), matter))
        at = end
    got = pa.concat_arrays(out) if out else _tags(b"", np.zeros(0, np.int64), matter)
    if html.null_count:
        got = pc.if_else(pc.is_valid(html), got, pa.scalar(None, got.type))
    return got


@cache
def tag_list():  # noqa: ANN201
    """list_tags() as a function of a column."""

    @F.arrow_udf(f"array<{TAG}>")
    def run(html: pa.Array) -> pa.Array:
        return list_tags(html)

    return run


def segments(documents: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, at, tag, head, body, attrs: the start tags of each document in order, `at` the byte where each begins.

    head is the tag as it stands; body is the text of a script or style, else empty. Names are lower-cased. Null
    documents have no tags.
    """
    each = documents.select(F.col(key), F.col(html).alias("_html"), F.explode(tag_list()(F.col(html))).alias("t"))
    head = F.substring(F.col("_html").cast("binary"), F.col("t.at").cast("int") + 1, (F.col("t.open_end") - F.col("t.at")).cast("int")).cast("string")
    return each.select(key, "t.pos", "t.at", "t.tag", head.alias("head"), F.coalesce("t.body", F.lit("")).alias("body"), "t.attrs")


def attributes(tags: DataFrame, key: str) -> DataFrame:
    """key, pos, at, tag, n, name, raw_name, raw_value, value, name_at, name_end of each attribute of the segments, numbered from 0."""
    return tags.select(key, "pos", "at", "tag", F.posexplode("attrs").alias("n", "a")).select(key, "pos", "at", "tag", "n", "a.*")

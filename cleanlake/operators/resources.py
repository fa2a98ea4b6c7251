"""Scripts, style sheets, PDFs, entity declarations, MIME types and images."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import match_ranges
from ..functions.hosts import url_name
from ..functions.urls import parse_url
from .policy import Policy, ReplaceRule

#: Fixed patterns.
ENTITY = r"(?is)<!ENTITY((?:[^>\\]|\\.)*+)>"
JS = r"(?s)(?:eval|alert|document[ \t\r\n]*\.[ \t\r\n]*write)[ \t\r\n]*\("
PDF_STREAM = r"(?s)(?<=^|[ \t\n\f\r>])stream.*?(?:endstream|\z)"
PDF_ACTIVE = r"/(?:JS|JavaScript|AA|OpenAction)(?=[\x00 \t\n\f\r\[\]<>(){}/%]|\z)"
_ARGUMENT = r"""(?>"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|(?:[^\\;)]++|\\.)*+)"""
CSS = rf"(?s)(?:@import[ \t\r\n]++({_ARGUMENT})[ \t\r\n]*+;|url[ \t\r\n]*+\([ \t\r\n]*+({_ARGUMENT})[ \t\r\n]*+\))"
#: Fixed tables of the known resource types.
MIME_NAMES = {
    "image/png": "image/png", "image/jpeg": "image/jpeg", "image/gif": "image/gif", "image/webp": "image/webp", "text/css": "text/css",
    "application/pdf": "application/pdf", "application/javascript": "application/javascript", "text/javascript": "application/javascript",
}
EXTENSIONS = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "css": "text/css", "pdf": "application/pdf", "js": "application/javascript",
}
PNG_SIGNATURE = bytes.fromhex("89504e470d0a1a0a")
PNG_METADATA = (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"iCCP", b"gAMA", b"sRGB", b"tIME")


def quoted(text: str) -> str:
    """text as the replacement of a regular expression."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def without_entities(text: Column, rule: ReplaceRule, written: Callable[[str], str] = str) -> Column:
    """text with the rule's replacement, as `written` has it, for each entity declaration."""
    return text if rule.replace is None else F.when(has_entity(text), F.regexp_replace(text, ENTITY, quoted(written(rule.replace)))).otherwise(text)


def has_entity(text: Column) -> Column:
    return F.contains(F.upper(text), F.lit("<!ENTITY"))


def is_dangerous_js(script: Column) -> Column:
    return script.rlike(JS)


def sanitize_js(script: Column, rule: ReplaceRule) -> Column:
    """The script; the rule's text in place of all of it if it is dangerous; null if that is an error."""
    if rule.level == "error":
        return F.when(~is_dangerous_js(script), script)
    return script if rule.replace is None else F.when(is_dangerous_js(script), F.lit(rule.replace)).otherwise(script)


def has_active_pdf(data: Column) -> Column:
    """Whether PDF bytes hold an active entry outside their streams."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), PDF_STREAM, "").rlike(PDF_ACTIVE)


#: What a hit in a PDF is told as.
PDF_NAMES = {"/JS": "JavaScript (/JS)", "/JavaScript": "JavaScript", "/AA": "Additional Action (/AA)", "/OpenAction": "OpenAction"}
HITS = "array<struct<text:string,start:bigint,end:bigint>>"


def pdf_hits(data: Column) -> Column:
    """HITS: the active entries of PDF bytes outside their streams, in order, with their ranges in the whole file.

    Streams and entries are matches of one pattern, so that the bytes of the streams count in the places of what follows them.
    """
    text = F.decode(data, "ISO-8859-1")
    found = match_ranges(text, f"{PDF_STREAM}|{PDF_ACTIVE}", lambda m, begin, end: F.struct(m.alias("text"), begin.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
    hits = F.filter(found, lambda x: F.startswith(x["text"], F.lit("/")))
    told = F.transform(hits, lambda x: F.struct(F.coalesce(_lookup(PDF_NAMES, x["text"]), x["text"]).alias("text"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when(has_active_pdf(data), told).otherwise(F.array().cast(HITS))


@cache
def byte_spans(pattern: str):  # noqa: ANN201
    """A function of texts to HITS: the leftmost matches of pattern that do not overlap, and their ranges of bytes; null for null."""
    found, kind = re.compile(pattern.encode()), pa.list_(pa.struct([("text", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(HITS)
    def run(text: pa.Array) -> pa.Array:
        rows: list[list | None] = [None] * len(text)
        for i in np.flatnonzero(np.asarray(pc.is_valid(text))):
            rows[i] = [{"text": m.group().decode("utf-8", "replace"), "start": m.start(), "end": m.end()} for m in found.finditer(text[int(i)].as_py().encode())]
        return pa.array(rows, kind)

    return run


def js_hits(script: Column, rule: ReplaceRule) -> Column:
    """HITS: the dangerous calls of a script with their ranges of bytes; but for a rule that keeps scripts, the first alone."""
    found = byte_spans(JS)(F.when(is_dangerous_js(script), script))
    every = rule.replace is None and rule.level != "error"
    told = F.transform(found if every else F.slice(found, 1, 1), lambda x: F.struct(F.concat(x["text"], F.lit("..)")).alias("text"), x["start"].alias("start"), x["end"].alias("end")))
    return F.coalesce(told, F.array().cast(HITS))


def mime_clean(content_type: Column) -> Column:
    bare = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.when(bare == "image/jpg", "image/jpeg").otherwise(bare)


def mime_sniff(data: Column) -> Column:
    h = F.hex(F.substring(data, 1, 12))
    return (
        F.when(F.startswith(h, F.lit("89504E470D0A1A0A")), "image/png")
        .when(F.startswith(h, F.lit("FFD8")), "image/jpeg")
        .when(h.rlike("^47494638(37|39)61"), "image/gif")
        .when(h.rlike("^52494646.{8}57454250"), "image/webp")
        .when(F.startswith(h, F.lit("25504446")), "application/pdf")
    )


def _lookup(table: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def mime_declared(content_type: Column) -> Column:
    return _lookup(MIME_NAMES, mime_clean(content_type))


def mime_by_extension(url: Column) -> Column:
    """The type that the extension of a URL's path stands for; its case counts."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    return _lookup(EXTENSIONS, F.regexp_extract(path, r"\.([^./]*)$", 1))


def resource_type(data: Column, url: Column, content_type: Column) -> Column:
    return F.coalesce(mime_sniff(data), mime_by_extension(url), mime_declared(content_type))


def mime_mismatch(content_type: Column, actual: Column) -> Column:
    """Whether a known type was declared and another one, or none, was found."""
    declared = mime_declared(content_type)
    return declared.isNotNull() & ~declared.eqNullSafe(actual)


def is_markup(content_type: Column, url: Column) -> Column:
    path = F.regexp_replace(url, r"[?#].*$", "")
    return F.coalesce(mime_clean(content_type).rlike("html|xml|svg"), F.lit(False)) | F.coalesce(F.lower(path).rlike(r"\.(html|htm|xml|svg|xhtml)$"), F.lit(False))


def _strip_jpeg(data: bytes) -> bytes:
    """Segment by segment up to the end marker; what stands between segments stays, what follows the end goes."""
    if data[:2] != b"\xff\xd8":
        return data
    kept, i = [data[:2]], 2
    while i < len(data):
        mark = data.find(b"\xff", i)
        if mark < 0 or mark + 1 == len(data):
            kept.append(data[i:])
            break
        kept.append(data[i:mark])
        kind, i = data[mark + 1], mark
        if kind == 0xD9:
            kept.append(data[i : i + 2])
            break
        bare = kind == 0 or 0xD0 <= kind <= 0xD7  # an escaped byte of image data, or a restart marker
        size = 2 if bare else 2 + int.from_bytes(data[i + 2 : i + 4], "big")
        if not bare and i + 4 > len(data) or i + size > len(data):
            kept.append(data[i:])
            break
        if kind != 0xE1:
            kept.append(data[i : i + size])
        i += size
    return b"".join(kept)


def _strip_png(data: bytes) -> bytes:
    if not data.startswith(PNG_SIGNATURE):
        return data
    out, i = [PNG_SIGNATURE], len(PNG_SIGNATURE)
    while i + 8 <= len(data):
        size = 12 + int.from_bytes(data[i : i + 4], "big")
        if i + size > len(data):
            out.append(data[i:])
            break
        if data[i + 4 : i + 8] not in PNG_METADATA:
            out.append(data[i : i + size])
        i += size
    return b"".join(out)


@F.pandas_udf(T.BinaryType())
def strip_jpeg(data: pd.Series) -> pd.Series:
    """A JPEG without its APP1 segments; other data unchanged."""
    return data.map(lambda x: None if x is None else _strip_jpeg(bytes(x)))


@F.pandas_udf(T.BinaryType())
def strip_png(data: pd.Series) -> pd.Series:
    """A PNG without its textual, time and colour metadata; other data unchanged."""
    return data.map(lambda x: None if x is None else _strip_png(bytes(x)))


CSS_RESULT = "struct<output:string,actions:array<struct<level:string,type:string,original:string,replacement:string,loc_start:bigint,loc_end:bigint>>,subresources:array<struct<url:string,local_name:string>>>"
_CSS = regex.compile(CSS.replace(r"\z", r"\Z"))


def _unquote(argument: str) -> str:
    if len(argument) > 1 and argument[0] in "\"'" and argument[-1] == argument[0]:
        argument = argument[1:-1]
    return regex.sub(r"(?s)\\(.)", r"\1", argument)


def _css(text: str, base: str, policy: Policy) -> tuple:
    """output, actions, subresources of one style sheet; no output if an error ended it."""
    actions, found, out, last = [], [], [], 0
    for m in _CSS.finditer(text):
        group = 1 if m.group(1) is not None else 2
        a, b = m.span(group)
        value = _unquote(m.group(group))
        clean, new, rule = value.strip(), None, None
        if clean.startswith(("data:", "javascript:")):
            rule, new = ("dangerous_uris", policy.dangerous_uris), value
        elif (url := parse_url(clean, base)) is None:
            new = ""
        else:
            if url[4] == "domain" and url[2] != url[3]:
                rule = ("idn", policy.idn)
            if rule is None or policy.idn.replace is None:
                ext = "".join(c for c in url[0].partition("?")[0].partition("#")[0].rpartition("/")[2].rpartition(".")[2] if c.isalnum())
                last_part = url[0].partition("?")[0].partition("#")[0].rpartition("/")[2]
                ext = ext if "." in last_part and ext else "".join(c for c in clean.rpartition(".")[2].partition("?")[0] if c.isalnum()) or "bin"
                new = f"sub_{url_name(url[0])}.{ext}"
                found.append((url[0], new))
        if rule is not None:
            kind, r = rule
            start, end = len(text[:a].encode()), len(text[:b].encode())
            actions.append((r.level, kind, value, None if r.level == "error" else r.replace, start, end))
            if r.level == "error":
                return None, actions, []
            new = r.replace if r.replace is not None else new
        out += [text[last:a], f'"{new}"']
        last = b
    return "".join([*out, text[last:]]), actions, found


def sanitize_css_udf(policy: Policy):  # noqa: ANN201
    """A function of style sheet and base URL to CSS_RESULT, null for null: arguments of url() and @import made local or replaced."""

    names = ("level", "type", "original", "replacement", "loc_start", "loc_end")
    action = pa.struct([(n, pa.int64() if n.startswith("loc") else pa.string()) for n in names])
    kind = pa.struct([("output", pa.string()), ("actions", pa.list_(action)), ("subresources", pa.list_(pa.struct([("url", pa.string()), ("local_name", pa.string())])))])

    @F.arrow_udf(CSS_RESULT)
    def run(text: pa.Array, base: pa.Array) -> pa.Array:
        rows: list[dict | None] = [None] * len(text)
        for i in np.flatnonzero(np.asarray(pc.is_valid(text))):
            t, b = text[int(i)].as_py(), base[int(i)].as_py()
            output, actions, found = _css(t, b, policy) if "url" in t or "@import" in t else (t, [], [])
            rows[i] = {"output": output, "actions": [dict(zip(names, x, strict=True)) for x in actions], "subresources": [{"url": u, "local_name": n} for u, n in found]}
        return pa.array(rows, kind)

    return run

"""Secrets in texts, and the parts of credentials that count only together.

Three kinds of spans are reported wherever they stand: assignments, access identifiers and long hexadecimal runs. Three
weaker kinds (endpoints, account identifiers, mixed tokens) are reported only when a part of a complementary role
stands within the same scope: an identifier or an endpoint needs a secret, a token needs an identifier or an endpoint.
Parts meet in an interval join: they are dealt into buckets of `scope` code points and joined on document and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import cut
from .text import row_key, span_list

#: Fixed patterns of the three base kinds; letters of the first one's words in either case.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The weaker kinds.
ENDPOINT = r"""(?:[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?)"""
ACCOUNT = r"""(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy](?:_?[Ii][Dd])?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: name, pattern, group and its least length, what the match must hold, role, weak; in the order in which spans of one start are listed.
KINDS = (
    ("assign", ASSIGN, 2, 6, (), "secret", False),
    ("access", ACCESS, 0, 0, (), "identifier", False),
    ("hex", HEX, 0, 0, (), "secret", False),
    ("endpoint", ENDPOINT, 0, 0, (), "endpoint", True),
    ("account", ACCOUNT, 0, 0, (), "identifier", True),
    ("token", TOKEN, 0, 0, ("[0-9]", "[A-Za-z]"), "secret", True),
)
SCOPE = 256
#: Kinds that count beside a secret only, and are looked for only in texts that hold one.
LATE = ("endpoint", "account")
#: What a text holds if it holds a match of a kind.
MAY_HOLD = {"access": "AKIA", "endpoint": r"://|[0-9]\.[0-9]"}


def _complementary(a: Column, b: Column) -> Column:
    return (a != b) & ((a == "secret") | (b == "secret"))


def scan_parts(documents: DataFrame) -> DataFrame:
    """doc_id, _k1, _k2, parts: the parts in each whole text, in the order of start and kind: of LATE kinds, where there is a secret part."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def of(i: int) -> Column:
        name, pattern, group, least, must, _, _ = KINDS[i]
        spans = span_list(text, pattern, group, least, must)
        spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))
        return F.when(text.rlike(MAY_HOLD[name]), spans).otherwise(none) if name in MAY_HOLD else spans

    def with_late(first: Column) -> Column:
        secret = F.exists(first, lambda p: p["kind"].isin(*(i for i, k in enumerate(KINDS) if k[5] == "secret")))
        return F.when(secret, F.array_sort(F.concat(first, *(of(i) for i, k in enumerate(KINDS) if k[0] in LATE)))).otherwise(F.array_sort(first))

    first = F.concat(*(of(i) for i, k in enumerate(KINDS) if k[0] not in LATE))
    return documents.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), let(first, with_late).alias("parts"))


def link_parts(parts: DataFrame, scope: int) -> DataFrame:
    """The weak rows of parts (_k1, _k2, start, kind, end) with a complementary part at most `scope` code points away."""
    role = F.element_at(F.array(*(F.lit(k[5]) for k in KINDS)), F.col("kind") + 1)
    weak = F.element_at(F.array(*(F.lit(k[6]) for k in KINDS)), F.col("kind") + 1)
    rows = parts.withColumn("role", role)
    bucket = lambda at: F.floor(at / scope).cast("long")
    ours = rows.where(weak).withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    theirs = rows.select("_k1", "_k2", F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("r")).distinct()
    theirs = theirs.withColumn("bucket", F.explode(F.sequence(bucket(F.col("s") - scope), bucket(F.col("e") + scope))))
    near = (F.col("s") - F.col("end") <= scope) & (F.col("start") - F.col("e") <= scope)
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("_k1", "_k2", "bucket")]
    on = same[0] & same[1] & same[2] & near & _complementary(F.col("role"), F.col("r"))
    return ours.alias("a").join(theirs.alias("b"), on, "left_semi").select("_k1", "_k2", "start", "kind", "end").distinct()


def find_secrets(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, spans array<struct<start,kind,end>>: a row for each row of documents.

    Ranges are code points, the end exclusive. `kind` is an index into KINDS. A null text is an empty one; null ids,
    repeated rows and other columns are no matter. A text of any length is scanned whole; parts of one text meet only
    within a scope, so that a text with many parts makes no more than a few pairs of each.
    """
    scanned = cut(scan_parts(documents))
    each = scanned.select("_k1", "_k2", F.explode("parts").alias("p")).select("_k1", "_k2", "p.start", "p.kind", "p.end")
    linked = link_parts(each, scope).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    weak = [i for i, k in enumerate(KINDS) if k[6]]
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    base = F.filter("parts", lambda p: ~p["kind"].isin(*weak))
    return scanned.join(linked, ["_k1", "_k2"], "left").select("doc_id", F.array_sort(F.concat(base, F.coalesce("linked", none))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

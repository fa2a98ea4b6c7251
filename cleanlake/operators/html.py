"""The policy over HTML: what is done to each document, the rewritten documents, and the resources that they name.

Documents become rows of those start tags that a rule may concern, with their attributes and places; rules are predicates
and host-list tests over these rows; the order in which a reader of the document would meet the violations decides which
one ends it. What is changed meets its document again by its key alone, under the shuffle that dealt it, and is spliced
into the document's bytes; what lies between never leaves them. Reading tags, resolving URLs and rewriting style sheets
leave the JVM, in Arrow batches.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let
from ..functions.hosts import URL, is_idn, local_files, matches_any
from ..functions.urls import parse_url
from . import resources
from .policy import ATTRIBUTE_BREAKERS, LEVELS, Policy, ReplaceRule
from .tokens import TAG, list_tags

#: Fixed table: the attribute of each element that holds a URL, and the default extension if it is a resource.
URL_ATTRIBUTES = (
    ("a", "href", None), ("area", "href", None), ("form", "action", None), ("link", "href", "css"), ("img", "src", "png"), ("image", "href", "png"),
    ("source", "src", "js"), ("audio", "src", "mp3"), ("video", "src", "mp4"), ("embed", "src", "bin"), ("track", "src", "vtt"), ("input", "src", "png"),
    ("script", "src", "js"), ("iframe", "src", None), ("object", "data", None),
)
LOCAL_BASE = "https://localhost/"
_BREAKERS = f"[{ATTRIBUTE_BREAKERS}]"
#: Tags that a rule may concern by their name.
MATTER = frozenset((*(t for t, _, _ in URL_ATTRIBUTES), "base", "meta"))
#: What may stand before a scheme: white space of any kind, and the control characters that URLs are trimmed of.
_BEFORE = r"[\x00-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: data: and javascript:, also with the tabs and line ends that URLs lose.
DANGEROUS_URI = rf"(?i)^{_BEFORE}*+(?:" + "|".join(r"[\t\n\r]*+".join(w) for w in ("data:", "javascript:")) + ")"


@dataclass(frozen=True)
class Sanitized:
    """output: key, output (null if blocked); actions; subresources: key, seq, url, local_name."""

    output: DataFrame
    actions: DataFrame
    subresources: DataFrame


def is_handler(name: Column) -> Column:
    return F.startswith(name, F.lit("on"))


def is_dangerous_uri(value: Column) -> Column:
    return value.rlike(DANGEROUS_URI)


def replaced(rule: ReplaceRule, keep: Column) -> Column:
    """What a violation leaves: the rule's text, or what was there; "" stands for removal."""
    return keep if rule.replace is None else F.lit(rule.replace)


def _action(when: Column, rule: ReplaceRule | str, kind: str, original: Column, start: Column, end: Column, step: int, sub: Column) -> Column:
    level, new = (rule.level, rule.replace) if isinstance(rule, ReplaceRule) else (rule, None)
    made = F.struct(
        F.lit(step).alias("step"), sub.cast("int").alias("sub"), F.lit(level).alias("level"), F.lit(kind).alias("type"), original.alias("original"),
        F.lit(None if level == "error" else new).cast("string").alias("replacement"), start.cast("long").alias("loc_start"), end.cast("long").alias("loc_end"),
    )
    return F.when(when, made)


RESOLVED = T.StructType([*URL.fields, T.StructField("local", T.StringType())])


@F.arrow_udf(RESOLVED)
def _resolve(value: pa.Array, base: pa.Array, ext: pa.Array) -> pa.Array:
    """value joined to base, and its local name if ext is given; null fields where there is no value, or none that can be joined."""
    each = [None if v is None else parse_url(v, b) for v, b in zip(value.to_pylist(), base.to_pylist(), strict=True)]
    columns = list(zip(*(g or (None,) * 5 for g in each), strict=True)) or [()] * 5
    local, exts = [None] * len(each), ext.to_pylist()
    some = [i for i, (g, e) in enumerate(zip(each, exts, strict=True)) if g is not None and e is not None]
    for i, name in zip(some, local_files([each[i][0] for i in some], [exts[i] for i in some]), strict=True):
        local[i] = name
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (*columns, local)], RESOLVED.names)


def _first_values(attrs: pa.Array, name: str) -> list[str | None]:
    """The value of the first attribute of that name in each list of attributes."""
    each, out = pc.list_flatten(attrs), [None] * len(attrs)
    own = pc.equal(each.field("name"), name)
    for i, v in zip(reversed(pc.list_parent_indices(attrs).filter(own).to_pylist()), reversed(each.field("value").filter(own).to_pylist()), strict=True):
        out[i] = v
    return out


@functools.cache
def tags_and_bases(rule: ReplaceRule):  # noqa: ANN201
    """A function of documents and the bases they begin with to their tags that MATTER, and the base that each base element
    makes of the one before it, by what the rule for dangerous URIs leaves of its address; null for documents without any.

    Both in one function, as a further one would have a Python worker of its own in every task.
    """
    dangerous = re.compile(DANGEROUS_URI, re.ASCII)  # as Java's (?i), which folds ASCII alone

    @F.arrow_udf(f"struct<tags:array<{TAG}>,bases:array<string>>")
    def run(html: pa.Array, start: pa.Array) -> pa.Array:
        tags = list_tags(html, MATTER)
        each, bases = pc.list_flatten(tags), [None] * len(html)
        is_base = pc.equal(each.field("tag"), "base")
        hrefs = _first_values(each.field("attrs").filter(is_base), "href")
        for i, href in zip(pc.list_parent_indices(tags).filter(is_base).to_pylist(), hrefs, strict=True):
            folded = bases[i] = bases[i] or []
            now = folded[-1] if folded else start[i].as_py()
            if href is not None and rule.replace is not None and dangerous.search(href):
                href = rule.replace
            got = None if href is None else parse_url(href, now)
            folded.append(got[0] if got else now)
        return pa.StructArray.from_arrays([tags, pa.array(bases, pa.list_(pa.string()))], ["tags", "bases"])

    return run


def _first(attrs: Column, name: Column | str) -> Column:
    """The first attribute of that name."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))


EDITS = "array<struct<start:bigint,end:bigint,text:string>>"
ACTIONS = "array<struct<pos:bigint,step:int,sub:int,level:string,type:string,original:string,replacement:string,loc_start:bigint,loc_end:bigint>>"


def as_byte_text(text: str) -> str:
    """text with a character for each of its UTF-8 bytes, as as_bytes() makes of a column."""
    return text.encode().decode("latin-1")


def declared_entities(text: Column, policy: Policy) -> Column:
    """The actions of a document's entity declarations, which come before all others."""
    rule = policy.xml_entities
    new = F.lit(None if rule.level == "error" else rule.replace).cast("string")
    one = lambda x, i: F.struct(F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("step"), i.cast("int").alias("sub"), F.lit(rule.level).alias("level"), F.lit("xml_entities").alias("type"), x["text"].alias("original"), new.alias("replacement"), x["start"].alias("loc_start"), x["end"].alias("loc_end"))
    return F.transform(resources.byte_spans(resources.ENTITY)(F.when(resources.has_entity(text), text)), one)


def failed(actions: Column) -> Column:
    """Whether an action in the array is of level error."""
    return F.exists(actions, lambda a: a["level"] == LEVELS[-1])


def until_error(actions: Column) -> Column:
    """The actions, in order, up to and with the first of level error."""
    stop = F.array_position(F.transform(actions, lambda a: a["level"]), LEVELS[-1])
    return F.when(stop > 0, F.slice(actions, 1, stop.cast("int"))).otherwise(actions)


def spliced(doc: Column, edits: Column) -> Column:
    """doc (binary) as text, with the text of each of edits (start, end, text: in order, apart) in place of its bytes."""

    def one(d: Column) -> Column:
        part = lambda begin, end: F.substring(d, (begin + 1).cast("int"), (end - begin).cast("int")).cast("string")
        before = lambda i: F.coalesce(F.get(edits, i - 1)["end"], F.lit(0))
        pieces = F.transform(edits, lambda e, i: F.concat(part(before(i), e["start"]), e["text"]))
        return F.concat(F.array_join(pieces, ""), part(before(F.size(edits)), F.octet_length(d).cast("long")))

    return F.when(F.size(edits) == 0, doc.cast("string")).otherwise(let(doc, one))


def sanitize_rows(documents: DataFrame, policy: Policy, key: str = "page_id", html: str = "html", base: str | Column = LOCAL_BASE, deal: bool = True) -> DataFrame:
    """key, output, actions array, subresources array: one row for each document; see sanitize_html. base may be a column of documents.

    Documents are dealt first, as a table of pages may have few partitions, and a document costs far more time than its bytes
    suggest; a table in many even partitions needs no dealing, which spares a shuffle of its documents. What an element asks for
    is worked out on its tag's row, with the base that holds there; a row before the first holds the document's bytes. A
    document's rows are in one task, and are gathered there before they are shuffled by the key.
    """
    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    start = F.lit(base) if isinstance(base, str) else base
    docs = documents.select(F.col(key), F.col(html).alias("_text"), start.alias("_start"))
    docs = docs.repartition(parts, key) if deal else docs
    docs = docs.select(key, "_start", "_text", F.col("_text").isNotNull().alias("_some"), resources.without_entities(F.col("_text"), policy.xml_entities).alias("_clean"))
    docs = docs.select(key, "_start", "_some", "_clean", declared_entities(F.col("_text"), policy).alias("_declared"), tags_and_bases(policy.dangerous_uris)(F.col("_clean"), F.col("_start")).alias("_t"))
    docs = docs.select(key, "_start", "_some", "_clean", "_declared", F.col("_t.tags").alias("_tags"), F.col("_t.bases").alias("_bases"))
    tag, body, at = (F.col(c) for c in ("tag", "body", "at"))

    # attributes, one by one
    drop_handlers, edit_uris = policy.event_handlers.replace is not None, policy.dangerous_uris.replace is not None

    def judged(a: Column) -> Column:
        handler = is_handler(a["name"])
        uri = is_dangerous_uri(a["value"]) & ~(handler & F.lit(drop_handlers))
        changed = (handler & F.lit(drop_handlers)) | (uri & F.lit(edit_uris))
        now = F.when(handler & F.lit(drop_handlers), replaced(policy.event_handlers, a["value"])).when(uri, replaced(policy.dangerous_uris, a["value"])).otherwise(a["value"])
        return F.struct(*(a[c].alias(c) for c in ("name", "raw_name", "raw_value", "value", "name_at", "name_end")), handler.alias("handler"), uri.alias("uri"), changed.alias("changed"), now.alias("now"))

    kind = T._parse_datatype_string(TAG)
    whole = F.struct(*(F.lit(-1 if f.name == "pos" else None).cast(f.dataType).alias(f.name) for f in kind if f.name != "doc"), F.col("_clean").cast("binary").alias("doc"))
    elements = F.concat(F.array(whole), F.coalesce("_tags", F.array().cast(f"array<{TAG}>")))
    rows = docs.select(key, "_start", "_some", "_declared", "_bases", F.explode(elements).alias("t"))
    rows = rows.select(
        key, F.when(F.col("t.pos") < 0, F.col("_some")).alias("_some"), F.when(F.col("t.pos") < 0, F.col("_declared")).alias("_declared"), "t.*",
        F.coalesce(F.get("_bases", (F.col("t.bases") - 1).cast("int")), "_start").alias("_base"),
    )
    rows = rows.withColumn("attrs", F.transform("attrs", judged))
    attrs = F.col("attrs")

    def by_attribute(a: Column, i: Column) -> Column:
        return F.array(
            _action(a["handler"], policy.event_handlers, "event_handlers", a["value"], a["name_at"], a["name_end"], 1, i * 2),
            _action(a["uri"], policy.dangerous_uris, "dangerous_uris", F.lower(a["value"]), a["name_at"], a["name_end"], 1, i * 2 + 1),
        )

    # the element's URL
    url_name, ext = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t, name, default in URL_ATTRIBUTES:
        url_name = F.when(tag == t, name).otherwise(url_name)
        ext = F.when(tag == t, F.lit(default).cast("string")).otherwise(ext)
    sheet = F.exists(attrs, lambda a: (a["name"] == "rel") & F.lower(a["value"]).contains("stylesheet"))
    ext = F.when((tag != "link") | sheet, ext)
    found = _first(attrs, url_name)
    rows = rows.withColumn("_u", F.when(~(found["changed"] & (found["now"] == "")), found))
    u = F.col("_u")
    sheet_text = F.when(tag == "style", body)
    rows = rows.select("*", _resolve(u["now"], F.col("_base"), ext).alias("_url"), resources.sanitize_css_udf(policy)(sheet_text, F.col("_base")).alias("_css"), resources.js_hits(F.when(tag == "script", body), policy.dangerous_js).alias("_hits"))
    url = F.col("_url")
    joined, idn, denied = url["href"].isNotNull(), is_idn(url), matches_any(url["host"], policy.denied)
    if policy.compat:  # allowing a.b also allows b, and not the subdomains of a.b
        script_ok = F.lit(False)
        for h in policy.allow_scripts:
            script_ok = script_ok | (url["host"] == h) | F.lit(h).endswith(F.concat(F.lit("."), url["host"]))
    else:
        script_ok = matches_any(url["host"], policy.allow_scripts)
    bad_script = F.coalesce((tag == "script") & u.isNotNull() & F.when(joined, url["host"].isNotNull() & ~script_ok).otherwise(F.lit(True)), F.lit(False))
    bad_frame = F.coalesce(tag.isin("iframe", "object") & joined & ~matches_any(url["host"], policy.allow_origins), F.lit(False))
    swap = F.lit(policy.dangerous_domains.replace).cast("string")
    if policy.dangerous_domains.replace and "." in policy.dangerous_domains.replace:
        swap = F.regexp_replace(url["href"], r"^([a-z]+://(?:[^/@]*@)?)[^/:?#]+", f"$1{policy.dangerous_domains.replace}")
        swap = F.regexp_replace(swap, _BREAKERS, "") if policy.compat else swap
    new = F.when(joined & idn, F.lit(policy.idn.replace).cast("string"))
    new = F.when(joined & denied & swap.isNotNull(), swap).otherwise(new)
    new = F.when(bad_script & F.lit(policy.dangerous_scripts.replace is not None), F.lit(policy.dangerous_scripts.replace)).otherwise(new)
    new = F.when(bad_frame & F.lit(policy.dangerous_origins.replace is not None), F.lit(policy.dangerous_origins.replace)).otherwise(new)
    rows = rows.withColumn("_new", new)
    local = F.when(F.lit(policy.fetch_sub_resources) & (F.lit(policy.compat) | F.col("_new").isNull()), url["local"])
    rows = rows.withColumn("_local", local).withColumn("_set", F.coalesce("_local", "_new"))

    # refreshes, inline scripts and styles
    refresh = F.coalesce((tag == "meta") & F.exists(attrs, lambda a: (a["name"] == "http-equiv") & (F.lower(a["value"]) == "refresh")), F.lit(False))
    js = F.size("_hits") > 0
    css, shift = F.col("_css"), F.col("open_end")
    start, end = u["name_at"], u["name_end"]
    by_element = F.array(
        _action(joined & idn, policy.idn, "idn", u["now"], start, end, 2, F.lit(0)),
        _action(joined & denied, policy.dangerous_domains, "dangerous_domains", u["now"], start, end, 2, F.lit(1)),
        _action(bad_script, policy.dangerous_scripts, "dangerous_scripts", F.coalesce(url["host"], u["now"]), start, end, 2, F.lit(2)),
        _action(bad_frame, policy.dangerous_origins, "dangerous_origins", url["href"], start, end, 2, F.lit(2)),
        _action(refresh, policy.meta_refresh, "meta_refresh", F.lit("refresh"), at, at, 2, F.lit(3)),
    )
    by_js = F.transform(
        "_hits",
        lambda h, i: _action(F.lit(True), policy.dangerous_js, "dangerous_js", h["text"], F.col("open_end") + h["start"], F.col("open_end") + h["end"], 3, i),
    )
    by_css = F.transform(
        F.coalesce(css["actions"], F.array().cast("array<struct<level:string,type:string,original:string,replacement:string,loc_start:bigint,loc_end:bigint>>")),
        lambda c, i: F.struct(F.lit(3).alias("step"), i.cast("int").alias("sub"), *(c[n].alias(n) for n in ("level", "type", "original", "replacement")), (shift + c["loc_start"]).alias("loc_start"), (shift + c["loc_end"]).alias("loc_end")),
    )
    odd = F.exists(attrs, lambda a: a["handler"] | a["uri"])
    of_attributes = F.when(odd, F.flatten(F.transform(attrs, by_attribute))).otherwise(F.slice(by_element, 1, 0))
    acts = F.filter(F.concat(of_attributes, by_element, by_js, by_css), lambda x: x.isNotNull())
    acts = F.transform(acts, lambda x: F.struct(F.col("pos").alias("pos"), *(x[n].alias(n) for n in ("step", "sub", "level", "type", "original", "replacement", "loc_start", "loc_end"))))
    any_ = lambda *tests: functools.reduce(lambda x, y: x | y, (F.coalesce(t, F.lit(False)) for t in tests))
    some = any_(odd, joined & (idn | denied), bad_script, bad_frame, refresh, js, F.size(css["actions"]) > 0)
    acts = F.when(some, acts).otherwise(F.array().cast(ACTIONS))

    # what takes the place of the tag and of its text
    touched = F.exists(attrs, lambda a: a["changed"]) | F.col("_set").isNotNull()
    is_url = lambda a: F.coalesce(F.col("_set").isNotNull() & (a["name_at"] == u["name_at"]), F.lit(False))
    final = lambda a: F.when(is_url(a), F.col("_set")).otherwise(a["now"])
    edited = lambda a: a["changed"] | is_url(a)
    raw = lambda a: F.when(a["raw_value"] == "", a["raw_name"]).otherwise(F.concat(a["raw_name"], F.lit("="), a["raw_value"]))
    kept = F.filter(attrs, lambda a: ~(edited(a) & (final(a) == "")))
    quoted = lambda x: F.concat(F.lit('="'), F.replace(x, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    inner = F.array_join(F.transform(kept, lambda a: F.when(edited(a), F.concat(a["raw_name"], quoted(final(a)))).otherwise(raw(a))), " ")
    closing = F.when(F.col("closing"), " />").otherwise(">")
    open_tag = F.concat(F.lit("<"), F.col("raw_tag"), F.when(inner != "", F.concat(F.lit(" "), inner)).otherwise(""), closing)
    text = F.when(css["output"] != body, css["output"])
    if policy.dangerous_js.replace is not None:
        text = F.when(js, F.lit(policy.dangerous_js.replace)).otherwise(text)
    gone = refresh & F.lit(policy.meta_refresh.replace == "")
    edits = F.array(
        F.when(gone, F.struct(at.alias("start"), F.col("open_end").alias("end"), F.lit("").alias("text"))).when(touched, F.struct(at.alias("start"), F.col("open_end").alias("end"), open_tag.alias("text"))),
        F.when(text.isNotNull(), F.struct(F.col("open_end").alias("start"), F.col("body_end").alias("end"), text.alias("text"))),
    )
    edits = F.when(gone | touched | text.isNotNull(), F.filter(edits, lambda e: e.isNotNull())).otherwise(F.array().cast(EDITS))
    named = F.when(F.col("_local").isNotNull(), F.array(F.struct(url["href"].alias("url"), F.col("_local").alias("local_name"))))
    named = F.coalesce(named, css["subresources"], F.array().cast("array<struct<url:string,local_name:string>>"))
    made = rows.select(key, "pos", "_some", "_declared", "doc", edits.alias("edits"), acts.alias("acts"), named.alias("named"))
    all_of = lambda c: F.array_sort(F.flatten(F.collect_list(F.when(F.size(c) > 0, F.col(c)))))
    one = F.when(F.size("named") > 0, F.struct("pos", "named"))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    whole = made.groupBy(key).agg(first("_some"), first("_declared"), first("doc"), all_of("edits").alias("_edits"), all_of("acts").alias("_acts"), F.array_sort(F.collect_list(one)).alias("_names"))
    whole = whole.select(
        key,
        "_some",
        "doc",
        "_edits",
        F.concat(F.coalesce("_declared", F.array().cast(ACTIONS)), "_acts").alias("_all"),
        F.flatten(F.transform("_names", lambda x: x["named"])).alias("_named"),
    )
    good = F.col("_some") & ~failed(F.col("_all"))
    out = F.when(good, spliced(F.col("doc"), F.col("_edits")))
    return whole.select(key, out.alias("output"), until_error(F.col("_all")).alias("actions"), F.when(good, F.col("_named")).otherwise(F.array().cast("array<struct<url:string,local_name:string>>")).alias("subresources"))


def listed_actions(rows: DataFrame, key: str) -> DataFrame:
    """key, seq, level, type, original, replacement, loc_start, loc_end: a row for each action of rows (key, actions), numbered from 1."""
    each = rows.select(key, F.posexplode("actions").alias("n", "a"))
    return each.select(key, (F.col("n") + 1).alias("seq"), *(F.col(f"a.{c}") for c in ("level", "type", "original", "replacement", "loc_start", "loc_end")))


def sanitize_html(documents: DataFrame, policy: Policy, key: str = "page_id", html: str = "html", base: str = LOCAL_BASE) -> Sanitized:
    """The policy applied to whole documents.

    Entity declarations are dealt with first, in the whole document; offsets are bytes of what they leave. Then, in
    order of tags: each attribute (handlers, then dangerous URIs), then what the element asks for. The first
    action of level error ends its document: later ones are dropped, the output is null and no resource is named. Null
    documents have a null output and no action; a document's rows are found by key, which must be unique and not null.
    """
    rows = sanitize_rows(documents, policy, key, html, base)
    found = rows.select(key, F.posexplode("subresources").alias("n", "s"))
    return Sanitized(
        rows.select(key, "output"),
        listed_actions(rows, key),
        found.select(key, (F.col("n") + 1).alias("seq"), "s.url", "s.local_name"),
    )


def first_error_cutoff(actions: DataFrame, key: str) -> DataFrame:
    """The actions of each document up to its first error, numbered in order as `seq`: what sanitize_rows() does to its own."""
    fields = ["pos", "step", "sub", "level", "type", "original", "replacement", "loc_start", "loc_end"]
    packed = actions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all"))
    kept = packed.select(key, F.posexplode(until_error(F.col("all"))).alias("n", "a"))
    return kept.select(key, (F.col("n") + 1).alias("seq"), *(F.col(f"a.{c}") for c in fields[3:]))

"""Files of all kinds under the policy: each by what its name says it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import resources
from .html import LOCAL_BASE, sanitize_rows, until_error
from .policy import LEVELS, Policy

ACTIONS = "array<struct<pos:bigint,step:int,sub:int,level:string,type:string,original:string,replacement:string,loc_start:bigint,loc_end:bigint>>"
RESOURCES = "array<struct<url:string,local_name:string>>"


@dataclass(frozen=True)
class SanitizedFiles:
    """output: key, kind, output binary (null if blocked); actions and subresources as of a document."""

    output: DataFrame
    actions: DataFrame
    subresources: DataFrame


def lossy_text(data: Column) -> Column:
    """Bytes as text, what is no UTF-8 replaced."""
    return F.make_valid_utf8(data.cast("string"))


def _told(hits: Column, level: str, kind: str, replacement: str | None) -> Column:
    """An action for each of the hits (resources.HITS)."""
    none = F.lit(None if level == "error" else replacement).cast("string")
    one = lambda h, i: F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).alias("step"), i.cast("int").alias("sub"), F.lit(level).alias("level"), F.lit(kind).alias("type"), h["text"].alias("original"), none.alias("replacement"), h["start"].alias("loc_start"), h["end"].alias("loc_end"))
    return F.coalesce(F.transform(hits, one).cast(ACTIONS), F.array().cast(ACTIONS))


def sanitize_files(files: DataFrame, policy: Policy, key: str = "source_idx") -> SanitizedFiles:
    """files (key, kind, data) sanitized: html is rewritten, css and js too, pdf passes or is blocked.

    Other kinds are read as html. Null data has a null output. key must be unique and not null.
    """
    page = ~F.col("kind").isin("pdf", "css", "js") | F.col("kind").isNull()
    pages = sanitize_rows(files.where(page).select(key, lossy_text(F.col("data")).alias("html")), policy, key, "html")
    pages = pages.select(key, F.encode("output", "UTF-8").alias("output"), F.col("actions").cast(ACTIONS).alias("actions"), F.col("subresources").cast(RESOURCES).alias("subresources"))
    rest = files.where(~page).select(key, "kind", "data", lossy_text(F.col("data")).alias("text"))
    rest = rest.withColumn("_css", resources.sanitize_css_udf(policy)(F.when(F.col("kind") == "css", F.col("text")), F.lit(LOCAL_BASE)))
    css = F.transform(
        F.coalesce("_css.actions", F.array().cast("array<struct<level:string,type:string,original:string,replacement:string,loc_start:bigint,loc_end:bigint>>")),
        lambda a, i: F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).alias("step"), i.cast("int").alias("sub"), *(a[c].alias(c) for c in ("level", "type", "original", "replacement", "loc_start", "loc_end"))),
    ).cast(ACTIONS)
    script = _told(F.when(F.col("kind") == "js", resources.js_hits(F.col("text"), policy.dangerous_js)), policy.dangerous_js.level, "dangerous_js", policy.dangerous_js.replace)
    active = _told(F.when(F.col("kind") == "pdf", resources.pdf_hits(F.col("data"))), policy.pdf_active_content, "pdf_active_content", None)
    rest = rest.withColumn("actions", until_error(F.concat(css, script, active)))
    blocked = F.exists("actions", lambda a: a["level"] == LEVELS[-1])
    out = F.when(F.col("kind") == "css", F.encode("_css.output", "UTF-8")).when(F.col("kind") == "js", F.encode(resources.sanitize_js(F.col("text"), policy.dangerous_js), "UTF-8")).otherwise(F.col("data"))
    named = F.when(~blocked, F.col("_css.subresources")).cast(RESOURCES)
    rest = rest.select(key, F.when(~blocked, out).alias("output"), "actions", F.coalesce(named, F.array().cast(RESOURCES)).alias("subresources"))
    rows = pages.unionByName(rest)
    actions = rows.select(key, F.posexplode("actions").alias("n", "a")).select(key, (F.col("n") + 1).alias("seq"), *(F.col(f"a.{c}") for c in ("level", "type", "original", "replacement", "loc_start", "loc_end")))
    found = rows.select(key, F.posexplode("subresources").alias("n", "s")).select(key, (F.col("n") + 1).alias("seq"), "s.url", "s.local_name")
    return SanitizedFiles(rows.select(key, "output").join(files.select(key, "kind"), key), actions, found)

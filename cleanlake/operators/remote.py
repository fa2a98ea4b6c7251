"""Remote pages from captured responses, and all that a set of inputs leads to: pages, files and the resources they name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hosts import resolve_url
from .crawl import VIOLATIONS, answers, crawl, violation
from .html import ACTIONS, LOCAL_BASE, sanitize_rows, until_error
from .local import lossy_text
from .policy import LEVELS, Policy


@dataclass(frozen=True)
class RemotePages:
    """output: source_idx, url, status, output binary (null if refused or blocked); actions and subresources as of a document."""

    output: DataFrame
    actions: DataFrame
    subresources: DataFrame


def sanitize_pages(urls: DataFrame, responses: DataFrame, policy: Policy, hops: DataFrame | None = None, dns: DataFrame | None = None) -> RemotePages:
    """urls (source_idx, url) as sanitized pages, with what came back for them; see crawl.answers() for the other tables.

    A page must come by https, with a status of 2xx, within the budget of bytes, and as text/html if it says what it is. Its
    own address is the base of its links. status is `sanitized`, `blocked`, or what the request was refused for. source_idx
    must be unique and not null.
    """
    asked = answers(urls.select("source_idx", "url"), responses, policy, hops, dns)
    large = policy.max_bytes.exceeded("size")
    other = F.col("content_type").isNotNull() & ~F.contains(F.col("content_type"), F.lit("text/html"))
    told = F.filter(F.array(violation(large, "max_bytes", policy.max_bytes.level), violation(other, "mismatched_mime", "error")), lambda v: v.isNotNull()).cast(VIOLATIONS)
    asked = asked.withColumn("broken", F.when(F.col("refused").isNull(), until_error(F.concat("broken", told))).otherwise(F.col("broken")))
    ended = F.get(F.filter("broken", lambda v: v["level"] == LEVELS[-1]), F.lit(0))["type"]
    asked = asked.withColumn("refused", F.coalesce("refused", ended))
    pages = asked.where("refused is null").select("source_idx", "url", lossy_text(F.col("data")).alias("html"))
    done = sanitize_rows(pages, policy, "source_idx", "html", F.col("url"))
    none = F.lit(None).cast("string")
    before = F.transform("broken", lambda v: F.struct(F.lit(-2).cast("long").alias("pos"), F.lit(0).alias("step"), F.lit(0).alias("sub"), v["level"].alias("level"), v["type"].alias("type"), F.col("url").alias("original"), none.alias("replacement"), F.lit(None).cast("long").alias("loc_start"), F.lit(None).cast("long").alias("loc_end"))).cast(ACTIONS)
    rows = asked.select("source_idx", "url", "refused", before.alias("before")).join(done, "source_idx", "left")
    rows = rows.withColumn("actions", F.concat("before", F.coalesce("actions", F.array().cast(ACTIONS))))
    status = F.coalesce("refused", F.when(F.col("output").isNull(), "blocked").otherwise("sanitized"))
    actions = rows.select("source_idx", F.posexplode("actions").alias("n", "a"))
    found = rows.where(F.col("output").isNotNull()).select("source_idx", F.posexplode("subresources").alias("n", "s"))
    return RemotePages(
        rows.select("source_idx", "url", status.alias("status"), F.encode("output", "UTF-8").alias("output")),
        actions.select("source_idx", (F.col("n") + 1).alias("seq"), *(F.col(f"a.{c}") for c in ("level", "type", "original", "replacement", "loc_start", "loc_end"))),
        found.select("source_idx", (F.col("n") + 1).alias("seq"), "s.url", "s.local_name"),
    )


def fetch_subresources(named: DataFrame, responses: DataFrame, policy: Policy, hops: DataFrame | None = None, dns: DataFrame | None = None, inputs: DataFrame | None = None) -> DataFrame:
    """The resources that sanitized inputs name (source_idx, seq, url, local_name), crawled; nothing if the policy fetches none.

    inputs (url) are the pages that were asked for themselves, which no page's resources ask for again.
    """
    asked = named if policy.fetch_sub_resources else named.limit(0)
    if inputs is not None:
        inputs = inputs.select(resolve_url(F.col("url"), F.lit(LOCAL_BASE))["href"].alias("url")).where("url is not null")
    return crawl(asked.withColumn("seq", F.col("seq").cast("long")), responses, policy, hops, dns, inputs)


def numbered_resources(crawled: DataFrame) -> DataFrame:
    """crawled with sub, the number of each resource in its source, from 1."""
    return crawled.withColumn("sub", F.row_number().over(W.partitionBy("source_idx").orderBy("depth", "seq")))


def resource_actions(crawled: DataFrame) -> DataFrame:
    """source_idx, sub (the resource's number in its source), url, n, level, type of what each crawled resource broke, with its refusal."""
    odd = F.when(F.col("status").isin("failed", "too_deep", "over_budget"), F.array(F.struct(F.col("status").alias("type"), F.lit(LEVELS[-1]).alias("level"))).cast(VIOLATIONS))
    told = F.concat("violations", F.coalesce(odd, F.array().cast(VIOLATIONS)))
    return numbered_resources(crawled).select("source_idx", "sub", "url", F.posexplode(told).alias("n", "v")).select("source_idx", "sub", "url", "n", "v.level", "v.type")

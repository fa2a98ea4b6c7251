"""Crawl control over captured responses: redirects, visited URLs, budgets, and the bounded frontier loop.

Sources, URLs and responses are tables; nothing here opens a connection. Where the outcome would depend on which task
came first, the lowest (source, order) comes first.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hosts import ip_number, is_idn, is_safe_ip, is_safe_v4, local_name, matches_any, resolve_url
from . import resources
from .html import as_byte_text, failed, until_error
from .policy import LEVELS, Policy


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the folder of spark.checkpoint.dir; only a local session may do without that setting."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


VIOLATIONS = "array<struct<type:string,level:string>>"


def violation(when: Column, kind: str, level: str) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(level).alias("level")))


def up_to_error(found: list[Column]) -> Column:
    """The violations that hold, in order, up to and with the first of level error."""
    held = F.filter(F.array(*found), lambda v: v.isNotNull()).cast(VIOLATIONS)
    return until_error(held)


def connection_violations(url: Column, policy: Policy) -> Column:
    """The rules that a parsed URL to be fetched breaks: non_https, idn_connection, dangerous_connection, unsafe_address, each with its level."""
    number = ip_number(url["host"])
    none = F.lit(False)
    return up_to_error([
        violation(url["href"].isNull() | F.coalesce(url["scheme"] != "https", F.lit(True)), "non_https", "error"),
        violation(is_idn(url), "idn_connection", policy.idn_connection),
        violation(matches_any(url["host"], policy.denied), "dangerous_connection", policy.dangerous_connection),
        violation(F.coalesce(number.isNotNull() & ~is_safe_v4(number), none), "unsafe_address", "error"),
    ])


def refusal(violations: Column) -> Column:
    """The type of the violation of level error; null if there is none."""
    return F.get(F.filter(violations, lambda v: v["level"] == LEVELS[-1]), F.lit(0))["type"]


def safe_addresses(dns: DataFrame) -> DataFrame:
    """The rows of dns (host, ip) whose address may be connected to; a host without any is not to be fetched."""
    return dns.where(F.coalesce(is_safe_ip(F.col("ip")), F.lit(False)))


def redirect_actions(hops: DataFrame, policy: Policy) -> DataFrame:
    """chain, hop_no, type, level: what each redirect of each chain (chain, hop_no, url) breaks, in order: IDN, number, domain."""
    nth = F.row_number().over(W.partitionBy("chain").orderBy("hop_no")) - 1
    marked = hops.withColumn("_u", resolve_url(F.col("url"), F.lit("https://localhost/"))).withColumn("_n", nth).where("_n > 0")
    found = up_to_error([
        violation(is_idn(F.col("_u")), "idn_connection", policy.idn_connection),
        violation(F.col("_n") > policy.max_redirects.value, "max_redirects", policy.max_redirects.level),
        violation(matches_any(F.col("_u.host"), policy.denied), "dangerous_connection", policy.dangerous_connection),
    ])
    return marked.select("chain", "hop_no", F.inline(found))


def redirect_failures(hops: DataFrame, policy: Policy) -> DataFrame:
    """chain, hop_no, type: the first hop of each chain that breaks a rule of level error, which ends it."""
    bad = redirect_actions(hops, policy).where(F.col("level") == LEVELS[-1])
    return bad.groupBy("chain").agg(F.min(F.struct("hop_no", "type")).alias("f")).select("chain", "f.hop_no", "f.type")


def redirect_owners(hops: DataFrame, visited: DataFrame) -> DataFrame:
    """chain, url, source_idx: whose redirects a chain's are: the source that asked for its first URL; chains of no source are left out."""
    first = hops.groupBy("chain").agg(F.min_by("url", "hop_no").alias("url"))
    return first.join(visited.groupBy("url").agg(F.min("source_idx").alias("source_idx")), "url").select("chain", "url", "source_idx")


def first_claims(found: DataFrame) -> DataFrame:
    """The rows of found (source_idx, seq, url, ...) that claim their URL: the lowest (source_idx, seq) of each."""
    claim = found.groupBy("url").agg(F.min(F.struct("source_idx", "seq")).alias("_c")).select("url", F.col("_c.source_idx").alias("_s"), F.col("_c.seq").alias("_q"))
    on = (found["url"] == claim["url"]) & (found["source_idx"] == claim["_s"]) & (found["seq"] == claim["_q"])
    return found.join(claim, on, "left_semi").dropDuplicates(["url"])


def _queue_status(policy: Policy, depth: int) -> Column:
    deep = F.lit(depth > policy.max_resource_depth.value and policy.max_resource_depth.level == "error")
    return F.when(F.col("nth") > policy.max_subresources.value, "over_budget").when(deep, "too_deep").otherwise("fetch")


def claimed_queue(found: DataFrame, visited: DataFrame, policy: Policy, depth: int = 1) -> DataFrame:
    """found not visited yet, with nth and status as enqueue() has them, by the rule of budget_topk's SQL.

    The first source that names a URL keeps it, even beyond its budget, so that no other source may fetch it.
    """
    fresh = first_claims(found.join(visited.select("url"), "url", "left_anti"))
    nth = F.row_number().over(W.partitionBy("source_idx").orderBy("seq"))
    return fresh.withColumn("nth", nth).withColumn("status", _queue_status(policy, depth))


#: Named URLs of sources that may go beyond their budget that one task settles at once.
SETTLED = 1 << 20


def _settled(block: DataFrame, budget: int) -> DataFrame:
    """source_idx, url: what each source of block, one after the other, asks for or would ask for; what an earlier one took is left out.

    block (source_idx, seq, url, before) holds all that its sources name, and few enough rows for one task.
    """
    import pyarrow as pa

    def run(batches):
        taken: set[str] = set()
        now, left = None, 0
        for batch in batches:
            keep = []
            for i, (s, u, before) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source_idx", "url", "before")), strict=True)):
                if s != now:
                    now, left = s, budget - before
                if u in taken:
                    continue
                keep.append(i)
                if left > 0:
                    taken.add(u)
                left -= 1
            yield batch.take(pa.array(keep, pa.int64())).select(["source_idx", "url"])

    ordered = block.select("source_idx", "seq", "url", "before").repartition(1).sortWithinPartitions("source_idx", "seq", "url")
    kinds = dict(block.dtypes)
    return ordered.select("source_idx", "url", "before").mapInArrow(run, f"source_idx {kinds['source_idx']}, url string")


def enqueue(found: DataFrame, visited: DataFrame, policy: Policy, depth: int = 1, carried: DataFrame | None = None, settled: int = SETTLED) -> DataFrame:
    """found not visited yet, with nth (its number in its source) and status: fetch, over_budget, too_deep.

    As if the sources came one after the other: a URL goes to the first source that names it and is in budget; each
    source before that one has it over_budget. carried (source_idx, requests) has what earlier rounds counted.

    A source that names no more than its budget takes all that is left to it, so that nothing a later source does with
    these URLs matters: they are settled by a minimum. Only URLs of sources that may go beyond their budget depend on the order;
    if they share none, a number within each source settles them. Those that do share some are settled in
    their order, `settled` rows at a time in one task each, whatever chains they form.
    """
    rest = [c for c in found.columns if c not in ("source_idx", "url", "seq")]
    fresh = found.join(visited.select("url").distinct(), "url", "left_anti").groupBy("source_idx", "url").agg(F.min(F.struct("seq", *rest)).alias("_r"))
    before = found.select("source_idx").limit(0).withColumn("requests", F.lit(0)) if carried is None else carried
    fresh = fresh.select("source_idx", "url", "_r.*").join(before, "source_idx", "left").withColumn("before", F.coalesce("requests", F.lit(0))).drop("requests")
    budget, whole = policy.max_subresources.value, cut(fresh)
    alive, many = cut(whole.select("source_idx", "seq", "url", "before")), None
    for _ in range(3):  # what light sources take makes more sources light
        marked = alive.withColumn("_heavy", F.count("*").over(W.partitionBy("source_idx")) > budget - F.col("before"))
        least = marked.groupBy("url").agg(F.min(F.when(~F.col("_heavy"), F.col("source_idx"))).alias("_light"))
        alive = cut(marked.join(least, "url").where(F.col("_light").isNull() | (F.col("source_idx") <= F.col("_light"))).drop("_light"))
        count = alive.count()
        if many == count:
            break
        many, alive = count, alive.drop("_heavy")
    alive = alive if "_heavy" in alive.columns else alive.withColumn("_heavy", F.count("*").over(W.partitionBy("source_idx")) > budget - F.col("before"))
    heavy = alive.where("_heavy").drop("_heavy")
    shared = heavy.groupBy("url").agg(F.count("*").alias("_k")).where("_k > 1").select("url")
    knotted = cut(heavy.join(shared, "url", "left_semi").select("source_idx").distinct())
    asked = heavy.join(knotted, "source_idx", "left_anti").select("source_idx", "url")
    tied = cut(heavy.join(knotted, "source_idx", "left_semi"))
    while not tied.isEmpty():
        sizes = tied.groupBy("source_idx").count()
        ranged = sizes.withColumn("_to", F.sum("count").over(W.orderBy("source_idx").rowsBetween(W.unboundedPreceding, 0))) if sizes.count() <= settled else None
        if ranged is None:  # more sources than a task should number: the first by quantile, which are fewer rows than `settled`
            edge = sizes.approxQuantile("source_idx", [min(1.0, settled / (4.0 * tied.count()))], 0.0)[0]
            names = sizes.where(F.col("source_idx") <= edge).select("source_idx")
        else:
            names = ranged.where((F.col("_to") <= settled) | (F.col("_to") == F.col("count"))).select("source_idx")
        block = tied.join(names, "source_idx", "left_semi")
        done = cut(_settled(block, budget))
        asked = asked.unionByName(done)
        nth = F.row_number().over(W.partitionBy("source_idx").orderBy("seq", "url"))
        taken = done.join(tied, ["source_idx", "url"]).withColumn("_n", F.col("before") + nth).where(F.col("_n") <= budget).select("url")
        tied = cut(tied.join(names, "source_idx", "left_anti").join(taken, "url", "left_anti"))
    nth = F.col("before") + F.row_number().over(W.partitionBy("source_idx").orderBy("seq", "url"))
    asked = cut(asked.join(whole, ["source_idx", "url"]).withColumn("nth", nth.cast("int")))
    taken = asked.where(F.col("nth") <= budget).select("url").distinct()
    claim = alive.where("not _heavy").join(taken, "url", "left_anti").groupBy("url").agg(F.min("source_idx").alias("source_idx"))
    light = whole.join(claim, ["source_idx", "url"], "left_semi").withColumn("nth", nth.cast("int"))
    return cut(asked.select(*found.columns, "nth").unionByName(light.select(*found.columns, "nth"))).withColumn("status", _queue_status(policy, depth))


def budget_actions(queued: DataFrame, policy: Policy, depth: int = 1) -> DataFrame:
    """source_idx, type, max: one max_subresources for each source that goes beyond it, and max_resource_depth for each URL too deep."""
    over = queued.where(F.col("nth") == policy.max_subresources.value + 1).select("source_idx", F.lit("max_subresources").alias("type"), F.lit(policy.max_subresources.value).alias("max"))
    if depth <= policy.max_resource_depth.value:
        return over
    deep = queued.where(F.col("nth") <= policy.max_subresources.value)
    return over.unionByName(deep.select("source_idx", F.lit("max_resource_depth").alias("type"), F.lit(policy.max_resource_depth.value).alias("max")))


def running_bytes(fetched: DataFrame, policy: Policy, carried: DataFrame | None = None) -> DataFrame:
    """fetched (source_idx, seq, size, ...) with spent, the bytes of its source so far, and within, whether they are in budget.

    carried (source_idx, bytes) has what earlier rounds spent.
    """
    spent = F.sum("size").over(W.partitionBy("source_idx").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    if carried is not None:
        fetched, spent = fetched.join(carried, "source_idx", "left"), spent + F.coalesce("bytes", F.lit(0))
        return fetched.withColumn("spent", spent).drop("bytes").withColumn("within", F.col("spent") <= policy.max_bytes.value)
    return fetched.withColumn("spent", spent).withColumn("within", F.col("spent") <= policy.max_bytes.value)


def sanitize_responses(fetched: DataFrame, policy: Policy) -> DataFrame:
    """fetched (url, content_type, data, ...) with type, violations, violation (the first), output and found: what each resource becomes.

    Markup loses its entity declarations as it comes in. type is sniffed, else by extension, else as declared. Images lose
    their metadata, style sheets and scripts are rewritten, PDFs pass or are blocked; a violation of level error leaves no
    output. found holds the resources that a style sheet names.
    """
    markup = resources.is_markup(F.col("content_type"), F.col("url"))
    bytes_of = F.decode("data", "ISO-8859-1")
    declared = F.coalesce(markup & resources.has_entity(bytes_of) & bytes_of.rlike(resources.ENTITY), F.lit(False))
    clean = F.encode(resources.without_entities(bytes_of, policy.xml_entities, as_byte_text), "ISO-8859-1")
    rows = fetched.withColumn("_entity", declared).withColumn("data", F.when(F.col("_entity"), clean).otherwise(F.col("data")))
    rows = rows.withColumn("type", resources.resource_type(F.col("data"), F.col("url"), F.col("content_type")))
    text = F.decode("data", "UTF-8")
    rows = rows.withColumn("_css", resources.sanitize_css_udf(policy)(F.when(F.col("type") == "text/css", text), F.col("url")))
    actual = F.coalesce(resources.mime_sniff(F.col("data")), resources.mime_by_extension(F.col("url")))
    fixed = F.filter(
        F.array(
            violation(F.col("_entity"), "xml_entities", policy.xml_entities.level),
            violation(resources.mime_mismatch(F.col("content_type"), actual), "mismatched_mime", policy.mismatched_mime),
            violation(F.col("type").isNull(), "unknown_resource", policy.unknown_resource),
            violation((F.col("type") == "application/pdf") & resources.has_active_pdf(F.col("data")), "pdf_active_content", policy.pdf_active_content),
            violation((F.col("type") == "application/javascript") & resources.is_dangerous_js(text), "dangerous_js", policy.dangerous_js.level),
        ),
        lambda v: v.isNotNull(),
    ).cast(VIOLATIONS)
    of_css = F.transform(F.coalesce("_css.actions", F.array().cast("array<struct<level:string,type:string,original:string,replacement:string,loc_start:bigint,loc_end:bigint>>")), lambda a: F.struct(a["type"].alias("type"), a["level"].alias("level")))
    held = F.when(F.col("data").isNotNull(), until_error(F.concat(fixed, of_css.cast(VIOLATIONS)))).otherwise(F.array().cast(VIOLATIONS))
    out = (
        F.when(F.col("type") == "image/png", resources.strip_png(F.when(F.col("type") == "image/png", F.col("data"))))
        .when(F.col("type") == "image/jpeg", resources.strip_jpeg(F.when(F.col("type") == "image/jpeg", F.col("data"))))
        .when(F.col("type") == "text/css", F.encode("_css.output", "UTF-8"))
        .when(F.col("type") == "application/javascript", F.encode(resources.sanitize_js(text, policy.dangerous_js), "UTF-8"))
        .otherwise(F.col("data"))
    )
    rows = rows.withColumn("violations", held).withColumn("_out", out)
    good = ~failed(F.col("violations"))
    rows = rows.withColumn("violation", F.get("violations", F.lit(0))).withColumn("output", F.when(good, F.col("_out"))).withColumn("found", F.when(good, F.col("_css.subresources")))
    return rows.drop("_css", "_out", "_entity")


def answers(asked: DataFrame, responses: DataFrame, policy: Policy, hops: DataFrame | None = None, dns: DataFrame | None = None) -> DataFrame:
    """asked (url, ...) with what came back (status_code, content_type, data, size), broken (the violations of its connection) and refused.

    refused is the type of what ended the request before its body: a violation of level error, of the URL, of one of its
    redirects (hops: chain, hop_no, url) or of its host, which has no safe address in dns (host, ip); `failed` without a
    response or with a status other than 2xx. size is the declared content_length, if known, or that of the body. Of several
    responses of a URL the least counts: one of status 2xx first, then by status and by the other columns in order.
    """
    rows = asked.withColumn("_url", resolve_url(F.col("url"), F.lit("https://localhost/"))).withColumn("broken", connection_violations(F.col("_url"), policy))
    if dns is not None:
        safe = safe_addresses(dns).select(F.col("host").alias("_host")).distinct().withColumn("_safe", F.lit(True))
        rows = rows.join(safe, F.col("_url.host") == F.col("_host"), "left").drop("_host")
        lost = (F.col("_url.host_kind") == "domain") & F.col("_safe").isNull()
        rows = rows.withColumn("broken", F.when(lost & refusal(F.col("broken")).isNull(), F.concat("broken", F.array(violation(F.lit(True), "unsafe_address", "error")).cast(VIOLATIONS))).otherwise(F.col("broken"))).drop("_safe")
    if hops is not None:
        first = hops.groupBy("chain").agg(F.min_by("url", "hop_no").alias("url"))
        one = F.struct("hop_no", "_n", "type", "level")
        told = redirect_actions(hops, policy).withColumn("_n", F.lit(0)).join(first, "chain").groupBy("url").agg(F.array_sort(F.collect_list(one)).alias("_told"))
        told = told.select("url", F.transform("_told", lambda x: F.struct(x["type"].alias("type"), x["level"].alias("level"))).cast(VIOLATIONS).alias("_told"))
        rows = rows.join(told, "url", "left").withColumn("broken", until_error(F.concat("broken", F.coalesce("_told", F.array().cast(VIOLATIONS))))).drop("_told")
    least = F.struct(~F.coalesce(F.col("status_code").between(200, 299), F.lit(False)), "status_code", *(c for c in responses.columns if c not in ("url", "status_code")))
    one = responses.groupBy("url").agg(F.min(least).alias("_r"))
    rows = rows.drop("_url").join(one.select("url", *(F.col(f"_r.{c}").alias(c) for c in responses.columns if c != "url")), "url", "left")
    lost = F.col("data").isNull() | ~F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    rows = rows.withColumn("refused", F.coalesce(refusal(F.col("broken")), F.when(lost, "failed")))
    size = F.greatest(F.length("data"), F.col("content_length")) if "content_length" in responses.columns else F.length("data")
    return rows.withColumn("size", F.when(F.col("refused").isNull(), size).otherwise(0).cast("long"))


def crawl(seeds: DataFrame, responses: DataFrame, policy: Policy, hops: DataFrame | None = None, dns: DataFrame | None = None, visited: DataFrame | None = None) -> DataFrame:
    """source_idx, depth, seq array<bigint>, url, local_name, status, type, violations, violation, output of all resources that the seeds lead to.

    seeds: source_idx, seq, url, local_name. responses: url, status_code, content_type, data and, if known, the declared
    content_length, which counts before the body does; URLs without a response fail. hops and dns are those of answers().
    Style sheets lead to further resources one level deeper, for max_resource_depth rounds at most; seq is the path from
    the seed. Requests and bytes of a source are counted over all levels; a URL over budget is not visited, so that a
    later level may ask for it. visited (url) is not asked for at all: the inputs themselves. Every round is kept (cut) before the
    next one, so that plans do not grow with the depth.
    """
    kind = dict(seeds.dtypes)["seq"]
    found = seeds if kind.startswith("array") else seeds.withColumn("seq", F.array(F.col("seq").cast("long")))
    visited, out, requests, spent = None if visited is None else visited.select("url"), None, None, None
    for depth in range(1, policy.max_resource_depth.value + 1):
        seen = visited if visited is not None else found.select("url").limit(0)
        queued = cut(enqueue(found, seen, policy, depth, requests))
        asked = answers(queued, responses, policy, hops, dns)
        status = F.when(F.col("status") != "fetch", F.col("status")).when(F.col("refused").isNotNull(), F.col("refused")).otherwise("fetched")
        asked = asked.withColumn("status", status).withColumn("size", F.when(F.col("status") == "fetched", F.col("size")).otherwise(0))
        asked = cut(running_bytes(asked, policy, spent))
        over = (F.col("status") == "fetched") & ~F.col("within")
        told = F.when(over, F.concat("broken", F.array(violation(F.lit(True), "max_bytes", policy.max_bytes.level)).cast(VIOLATIONS))).otherwise(F.col("broken"))
        asked = asked.withColumn("broken", told).withColumn("status", F.when(over & F.lit(policy.max_bytes.level == "error"), "max_bytes").otherwise(F.col("status")))
        done = sanitize_responses(asked.withColumn("data", F.when(F.col("status") == "fetched", F.col("data"))), policy).withColumn("depth", F.lit(depth))
        done = done.withColumn("violations", F.concat("broken", "violations"))
        rows = cut(done.select("source_idx", "depth", "seq", "url", "local_name", "status", "type", "violations", "violation", "output", "found"))
        out = rows if out is None else out.unionByName(rows)
        now = queued.where("status <> 'over_budget'").select("url")
        visited = now if visited is None else visited.union(now)
        counted = queued.groupBy("source_idx").agg(F.max("nth").alias("requests"))
        requests = cut((counted if requests is None else requests.unionByName(counted)).groupBy("source_idx").agg(F.max("requests").alias("requests")))
        used = asked.groupBy("source_idx").agg(F.sum("size").alias("bytes"))
        spent = cut((used if spent is None else spent.unionByName(used)).groupBy("source_idx").agg(F.sum("bytes").alias("bytes")))
        found = rows.where("status = 'fetched'").select("source_idx", F.posexplode("found").alias("k", "f"), "seq")
        found = found.select("source_idx", F.concat("seq", F.array(F.col("k").cast("long"))).alias("seq"), "f.url", "f.local_name")
    return out.drop("found")


def name_seeds(urls: DataFrame, default: str = "bin") -> DataFrame:
    """urls (source_idx, seq, url) with the local name of each."""
    return urls.withColumn("local_name", local_name(F.col("url"), F.lit(default)))

"""The queries over the given tables, and the SQL that gives the same rows.

The given pages hold nothing harmful: each gets one of sixteen payloads by its id, in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hosts
from ..operators import crawl, html, report, resources, tokens
from ..operators.policy import Policy, ReplaceRule

#: What a page gets by its id modulo 16; the last gets nothing.
PAYLOADS = (
    '<button onclick="x()">b</button>', '<a href="javascript:alert(1)">x</a>', '<a href="https://www.evil.com/p">x</a>', '<script src="https://cdn.trusted.com/a.js"></script>',
    '<iframe src="https://untrusted.org/f"></iframe>', '<meta http-equiv="refresh" content="0;url=https://a.b">', '<!ENTITY lol "lol">', "<script>eval (1)</script>",
    '<style>a{background:url("img.png")}</style>', '<img src="http://10.0.0.1/x.png">', '<base href="/sub/"><a href="q.html">q</a>', '<object data="https://trusted.com/d"></object>',
    '<link rel="stylesheet" href="/s.css">', '<form action="https://evil.com/submit"></form>', '<audio src="/a.mp3"></audio><video src="/v.mp4"></video>',
)
#: Every rule goes on after a violation, for rows of all of them.
LENIENT = Policy(
    xml_entities=ReplaceRule("warn", ""), dangerous_scripts=ReplaceRule("warn", "#"), dangerous_origins=ReplaceRule("warn", "#"),
    dangerous_domains=ReplaceRule("warn", "#"), dangerous_js=ReplaceRule("warn", "/* blocked */"), allow_scripts=("cdn.trusted.com",),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _payload_sql() -> str:
    return "CASE page_id % 16 " + " ".join(f"WHEN {i} THEN '{p.replace(chr(39), chr(39) * 2)}'" for i, p in enumerate(PAYLOADS)) + " ELSE '' END"


#: SQL: pages with payload; tags as text, scripts and styles emptied; attributes of tags.
P = f"p AS (SELECT page_id, url, html || {_payload_sql()} AS html FROM pages)"
BARE = "bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(<script[^>]*>).*?(</script)', '\\1\\2', 'gis'), '(<style[^>]*>).*?(</style)', '\\1\\2', 'gis') AS html FROM p)"
TAGS = "tags AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<[a-z](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>')) AS head FROM bare)"
ATTRS = (
    "attrs AS (SELECT page_id, tag, lower(regexp_extract(a, '^([^ =]+)', 1)) AS name, trim(regexp_extract(a, '=(.*)$', 1), '\"''') AS value FROM "
    "(SELECT page_id, lower(regexp_extract(head, '^<([A-Za-z][^ />]*)', 1)) AS tag, unnest(regexp_extract_all(regexp_replace(head, '^<[A-Za-z][^ />]*', ''), '[^ \"''>/=]+(?:=(?:\"[^\"]*\"|''[^'']*''|[^ \"''>]+))?')) AS a FROM tags))"
)


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.lit("")
    for i, p in enumerate(PAYLOADS):
        extra = F.when(F.col("page_id") % 16 == i, F.lit(p)).otherwise(extra)
    return read(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", extra).alias("html"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.segments(pages(spark, sf_dir), "page_id", "html")


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.attributes(_segments(spark, sf_dir), "page_id")


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, scheme, host of the pages' own addresses, which are ASCII: no helper is needed."""
    parts = read(spark, sf_dir, "pages").select("page_id", "url")
    return parts.select("page_id", "url", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.lower(F.parse_url("url", F.lit("HOST"))).alias("host"))


U = "u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)"


@query(f"WITH {P}, {BARE}, {TAGS} SELECT lower(regexp_extract(head, '^<([A-Za-z][^ />]*)', 1)) AS tag, count(*) AS n FROM tags GROUP BY ALL")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))


@query(f"WITH {P}, {BARE}, {TAGS}, {ATTRS} SELECT tag, name, count(*) AS n FROM attrs GROUP BY ALL")
def attr_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributes(spark, sf_dir).groupBy("tag", "name").agg(F.count("*").alias("n"))


@query(f"WITH {P}, {BARE}, {TAGS}, {ATTRS} SELECT page_id, tag, name, value FROM attrs WHERE starts_with(name, 'on')")
def event_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributes(spark, sf_dir).where(html.is_handler(F.col("name"))).select("page_id", "tag", "name", "value")


@query(f"WITH {P}, {BARE}, {TAGS}, {ATTRS} SELECT page_id, tag, name, value FROM attrs WHERE regexp_matches(lower(trim(value)), '^(data|javascript):')")
def dangerous_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributes(spark, sf_dir).where(html.is_dangerous_uri(F.col("value"))).select("page_id", "tag", "name", "value")


@query(f"WITH {U} SELECT page_id, host FROM u WHERE host = 'example.com' OR host = 'example.net' OR ends_with(host, '.example.com') OR ends_with(host, '.example.net')")
def dangerous_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    denied = spark.createDataFrame([("example.com",), ("example.net",)], "target string")
    return hosts.listed_hosts(page_urls(spark, sf_dir), "host", denied, "target").select("page_id", "host")


@query(f"WITH {U} SELECT page_id, host FROM u WHERE NOT (host = 'example.org' OR ends_with(host, '.example.org'))")
def domains_not_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("example.org",)], "target string")
    return hosts.listed_hosts(page_urls(spark, sf_dir), "host", allowed, "target", "left_anti").select("page_id", "host")


@query(f"WITH {P}, {BARE}, {TAGS}, {ATTRS} SELECT page_id, regexp_extract(value, '^https?://([^/]+)', 1) AS host FROM attrs WHERE tag = 'script' AND name = 'src' AND regexp_extract(value, '^https?://([^/]+)', 1) <> 'trusted.com'")
def script_not_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _attributes(spark, sf_dir).where("tag = 'script' and name = 'src'").withColumn("host", F.parse_url("value", F.lit("HOST")))
    return src.where(F.col("host") != "trusted.com").select("page_id", "host")


@query(f"WITH {P}, {BARE}, {TAGS}, {ATTRS} SELECT page_id, tag, value FROM attrs WHERE ((tag = 'iframe' AND name = 'src') OR (tag = 'object' AND name = 'data')) AND NOT regexp_matches(value, '^https?://([^/]+\\.)?trusted\\.com/')")
def frame_not_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _attributes(spark, sf_dir).where("(tag = 'iframe' and name = 'src') or (tag = 'object' and name = 'data')")
    host = F.parse_url("value", F.lit("HOST"))
    return frames.where(~hosts.matches_any(host, ("trusted.com",))).select("page_id", "tag", "value")


@query(f"WITH {P}, {BARE}, {TAGS}, {ATTRS} SELECT DISTINCT page_id FROM attrs WHERE tag = 'meta' AND name = 'http-equiv' AND lower(value) = 'refresh'")
def meta_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributes(spark, sf_dir).where("tag = 'meta' and name = 'http-equiv' and lower(value) = 'refresh'").select("page_id").distinct()


@query(f"WITH {P} SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script', 1)) AS body FROM p) WHERE regexp_matches(body, '(?s)(?:eval|alert|document[ \\t\\r\\n]*\\.[ \\t\\r\\n]*write)[ \\t\\r\\n]*\\(') GROUP BY page_id")
def inline_js_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = _segments(spark, sf_dir).where("tag = 'script'")
    return scripts.where(resources.is_dangerous_js(F.col("body"))).groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT page_id, unnest(regexp_extract_all(html, 'url\\(\"([^\"]*)\"\\)', 1)) AS url FROM p")
def css_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = _segments(spark, sf_dir).where("tag = 'style'")
    found = styles.select("page_id", F.explode(F.regexp_extract_all("body", F.lit(resources.CSS), F.lit(2))).alias("url"))
    return found.where("url <> ''").select("page_id", F.regexp_replace("url", "^[\"']|[\"']$", "").alias("url"))


@query(f"WITH {P} SELECT page_id, strlen(regexp_replace(html, '<!ENTITY[^>]*>', '', 'gi')) AS n_bytes FROM p")
def entity_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = resources.without_entities(F.col("html"), ReplaceRule("warn", ""))
    return pages(spark, sf_dir).select("page_id", F.octet_length(left).cast("long").alias("n_bytes"))


@query(f"WITH {P} SELECT page_id, strlen(html[1:strpos(html, '<!ENTITY') - 1]) AS at FROM p WHERE contains(html, '<!ENTITY')")
def entity_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).where(resources.has_entity(F.col("html")))
    return rows.select("page_id", (F.regexp_instr(tokens.as_bytes(F.col("html")), F.lit(resources.ENTITY)) - 1).cast("long").alias("at"))


PDF = "CASE page_id % 4 WHEN 0 THEN '%PDF-1.4 << /OpenAction 1 >>' WHEN 1 THEN '%PDF-1.4 /JSdata' WHEN 2 THEN '%PDF-1.4 /JS(' ELSE '%PDF-1.4' END"


@query(f"SELECT page_id, regexp_matches({PDF}, '/(JS|JavaScript|AA|OpenAction)([ \\t\\n\\f\\r\\[\\]<>(){{}}/%]|$)') AS active FROM pages")
def pdf_active_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", resources.has_active_pdf(F.expr(f"encode({PDF}, 'ISO-8859-1')")).alias("active"))


_DISCOVERED = "tag IN ('img','input') AND name = 'src' OR tag IN ('audio','video','embed','track','source') AND name = 'src' OR tag = 'link' AND name = 'href' OR tag = 'script' AND name = 'src'"


@query(f"WITH {P}, {BARE}, {TAGS}, {ATTRS} SELECT tag, regexp_extract(value, '\\.([a-z0-9]+)$', 1) AS ext, count(*) AS n FROM attrs WHERE {_DISCOVERED} GROUP BY ALL")
def subresource_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributes(spark, sf_dir).where(_DISCOVERED).groupBy("tag", F.regexp_extract("value", r"\.([a-z0-9]+)$", 1).alias("ext")).agg(F.count("*").alias("n"))


@query(f"WITH {U} SELECT page_id, scheme, host, scheme <> 'https' AS refused FROM u")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = hosts.resolve_url(F.col("url"), F.lit(html.LOCAL_BASE))
    return read(spark, sf_dir, "pages").withColumn("u", url).select("page_id", "u.scheme", "u.host", (F.col("u.scheme") != "https").alias("refused"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/sub/' || page_id || '.html' AS href FROM pages")
def base_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = hosts.resolve_url(F.concat(F.lit("/sub/"), "page_id", F.lit(".html")), F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", url["href"].alias("href"))


_V4 = "(page_id * 2654435761) % 4294967296"


@query(
    f"SELECT page_id, {_V4} AS ip, NOT ({_V4} = 0 OR "
    + " OR ".join(f"{_V4} BETWEEN {hosts.v4_number(a)} AND {hosts.v4_number(b)}" for a, b in hosts.UNSAFE_V4)
    + ") AS safe FROM pages"
)
def safe_ip_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.expr(_V4)
    dotted = F.concat_ws(".", *(F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))
    return read(spark, sf_dir, "pages").select("page_id", number.alias("ip"), hosts.is_safe_v4(hosts.ip_number(dotted)).alias("safe"))


_SNIFFED = "CASE page_id % 5 WHEN 0 THEN '89504E470D0A1A0A00' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '474946383961' WHEN 3 THEN '255044462D312E34' ELSE '626F6479' END"
_DECLARED = "CASE page_id % 3 WHEN 0 THEN 'Image/PNG; q=1' WHEN 1 THEN ' image/jpg' ELSE 'text/plain' END"
_TYPE = "CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'application/pdf' END"
_CLEAN = "CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'text/plain' END"


@query(f"SELECT page_id, {_TYPE} AS sniffed, {_CLEAN} AS declared, page_id % 3 <> 2 AND {_TYPE} IS DISTINCT FROM {_CLEAN} AS mismatch FROM pages")
def mime_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.expr(f"unhex({_SNIFFED})").alias("data"), F.expr(_DECLARED).alias("ct"))
    sniffed = resources.mime_sniff(F.col("data"))
    return rows.select("page_id", sniffed.alias("sniffed"), resources.mime_clean(F.col("ct")).alias("declared"), resources.mime_mismatch(F.col("ct"), sniffed).alias("mismatch"))


#: Pages as sources of twenty, whose addresses without query and fragment repeat.
_FOUND = "SELECT page_id // 20 AS source_idx, page_id AS seq, regexp_extract(url, '^([^?#]*)', 1) AS url FROM pages"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 20).cast("long").alias("source_idx"), F.col("page_id").alias("seq"), F.regexp_extract("url", "^([^?#]*)", 1).alias("url"))


@query(f"SELECT source_idx, seq, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_idx, seq) AS r FROM ({_FOUND})) WHERE r = 1")
def url_dedup_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.first_claims(_found(spark, sf_dir)).select("source_idx", "seq", "url")


@query(f"SELECT source_idx, seq, nth, CASE WHEN nth > 5 THEN 'over_budget' ELSE 'fetch' END AS status FROM (SELECT source_idx, seq, CAST(row_number() OVER (PARTITION BY source_idx ORDER BY seq) AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_idx, seq) AS r FROM ({_FOUND})) WHERE r = 1)")
def budget_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _found(spark, sf_dir)
    return crawl.claimed_queue(rows, rows.select("url").limit(0), Policy()).select("source_idx", "seq", "nth", "status")


@query("SELECT page_id // 20 AS source_idx, page_id AS seq, CAST(sum(strlen(html)) OVER w AS BIGINT) AS spent, sum(strlen(html)) OVER w <= 20000 AS within FROM pages WINDOW w AS (PARTITION BY page_id // 20 ORDER BY page_id)")
def running_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.policy import LimitRule

    rows = read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 20).cast("long").alias("source_idx"), F.col("page_id").alias("seq"), F.octet_length("html").cast("long").alias("size"))
    return crawl.running_bytes(rows, Policy(max_bytes=LimitRule(20000))).select("source_idx", "seq", "spent", "within")


@query(f"WITH {U}, h AS (SELECT page_id // 5 AS chain, page_id % 5 AS hop_no, host FROM u), b AS (SELECT chain, hop_no, CASE WHEN hop_no > 2 THEN 'max_redirects' WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'dangerous_connection' END AS type FROM h WHERE hop_no > 0) SELECT chain, hop_no, type FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY hop_no) AS r FROM b WHERE type IS NOT NULL) WHERE r = 1")
def redirect_chain_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).cast("long").alias("chain"), (F.col("page_id") % 5).alias("hop_no"), "url")
    return crawl.redirect_failures(hops, Policy(denied=("example.net",)))


def _fake_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.col("event_type").alias("type"))
    level = F.when(F.col("pos") % 11 == 0, "error").when(F.col("pos") % 3 == 0, "warn").otherwise("info")
    return rows.select("doc", "pos", F.lit(0).alias("step"), F.lit(0).alias("sub"), level.alias("level"), "type", *(F.lit(None).cast("string").alias(c) for c in ("original", "replacement")), F.lit(0).alias("loc_start"), F.lit(0).alias("loc_end"))


_FAKE = "f AS (SELECT user_id AS doc, event_id AS pos, event_type AS type, CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'warn' ELSE 'info' END AS level FROM events), c AS (SELECT *, coalesce(sum(CASE WHEN level = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY doc ORDER BY pos) AS seq FROM f), k AS (SELECT doc, CAST(seq AS INTEGER) AS seq, level, type FROM c WHERE before = 0)"


@query(f"WITH {_FAKE} SELECT * FROM k")
def first_error_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.first_error_cutoff(_fake_actions(spark, sf_dir), "doc").select("doc", "seq", "level", "type")


@query(f"WITH {_FAKE} SELECT doc, count(*) AS n, string_agg(type, ',' ORDER BY seq) AS types, bool_or(level = 'error') AS failed FROM k GROUP BY doc")
def report_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = html.first_error_cutoff(_fake_actions(spark, sf_dir), "doc")
    packed = report.reports(actions, actions.select("doc").distinct(), "doc")
    return packed.select("doc", F.size("actions").cast("long").alias("n"), F.array_join(F.transform("actions", lambda a: a["type"]), ",").alias("types"), F.exists("actions", lambda a: a["level"] == "error").alias("failed"))


@query(f"WITH {_FAKE} SELECT bool_or(level = 'error') AS failed FROM k")
def any_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.any_error(html.first_error_cutoff(_fake_actions(spark, sf_dir), "doc"))


_EXPECTED = "e AS (SELECT doc, CASE doc % 3 WHEN 0 THEN ['click'] WHEN 1 THEN ['click', 'no_such'] ELSE [] END AS expected FROM (SELECT DISTINCT user_id AS doc FROM events)), r AS (SELECT doc, list(DISTINCT type) AS actual FROM k GROUP BY doc), v AS (SELECT e.doc, CASE WHEN len(expected) > 0 THEN CASE WHEN list_has_all(coalesce(actual, []), expected) THEN 'TP' ELSE 'FN' END WHEN len(coalesce(actual, [])) > 0 THEN 'FP' ELSE 'TN' END AS match_status FROM e LEFT JOIN r USING (doc))"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = html.first_error_cutoff(_fake_actions(spark, sf_dir), "doc")
    wanted = F.when(F.col("doc") % 3 == 0, F.array(F.lit("click"))).when(F.col("doc") % 3 == 1, F.array(F.lit("click"), F.lit("no_such"))).otherwise(F.array().cast("array<string>"))
    expected = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc")).distinct().withColumn("expected_rules", wanted)
    return report.verdicts(expected, report.rules_of(actions, "doc"), "doc")


@query(f"WITH {_FAKE}, {_EXPECTED} SELECT match_status, count(*) AS n FROM v GROUP BY ALL")
def verdict_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).groupBy("match_status").agg(F.count("*").alias("n"))


@query(
    f"WITH {_FAKE}, {_EXPECTED}, n AS (SELECT count(*) FILTER (WHERE match_status = 'TP') AS tp, count(*) FILTER (WHERE match_status = 'TN') AS tn, count(*) FILTER (WHERE match_status = 'FP') AS fp, count(*) FILTER (WHERE match_status = 'FN') AS fn FROM v) "
    "SELECT *, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS detection_rate, CASE WHEN fp + tn = 0 THEN 0.0 ELSE CAST(fp AS DOUBLE) / (fp + tn) END AS false_positive_rate FROM n"
)
def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rates(_verdicts(spark, sf_dir))


@query("SELECT event_type AS size_name, round(avg(abs(value)) * 1000, 6) AS avg_latency_ms, round(count(*) / sum(abs(value)), 6) AS throughput_ips FROM events GROUP BY event_type")
def latency_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "events").select(F.col("event_type").alias("size_name"), F.abs("value").alias("seconds"))
    return report.latency(runs).select("size_name", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), F.round("throughput_ips", 6).alias("throughput_ips"))


@query("SELECT count(*) AS n, CAST(sum(page_id) AS BIGINT) AS ids, count(DISTINCT copy) AS copies FROM pages, range(10) r(copy)")
def workload_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = report.replicate(read(spark, sf_dir, "pages"), 10, "page_id")
    return copies.agg(F.count("*").alias("n"), F.sum("page_id").alias("ids"), F.count_distinct("copy").alias("copies"))


@query("SELECT page_id, CASE WHEN strlen(url) > 40 THEN url[1:40] || '...' ELSE url END AS shown FROM pages")
def display_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.when(F.octet_length("url") > 40, F.concat(F.substring("url", 1, 40), F.lit("..."))).otherwise(F.col("url")).alias("shown"))


@query()
def sanitized_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.sanitize_html(pages(spark, sf_dir), LENIENT).output.select("page_id", F.sha2("output", 256).alias("output_sha256"), F.length("output").cast("long").alias("n_chars"))


_BY_MOD = {0: "event_handlers", 1: "dangerous_uris", 2: "dangerous_domains", 4: "dangerous_origins", 5: "meta_refresh", 6: "xml_entities", 7: "dangerous_js", 13: "dangerous_domains"}


@query("SELECT page_id, type, level FROM (SELECT page_id, CASE page_id % 16 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _BY_MOD.items()) + " END AS type, CASE WHEN page_id % 16 < 2 THEN 'info' ELSE 'warn' END AS level FROM pages) WHERE type IS NOT NULL")
def actions_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.sanitize_html(pages(spark, sf_dir), LENIENT).actions.select("page_id", "type", "level")


@query()
def subresources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.sanitize_html(pages(spark, sf_dir), LENIENT).subresources


@query()
def local_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", hosts.local_name(F.col("url"), F.lit("bin")).alias("local_name"))


@query("SELECT l.quality, l.toxic, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels l USING (doc_id) GROUP BY ALL")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))

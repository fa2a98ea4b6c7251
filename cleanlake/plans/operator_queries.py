"""Queries that drive whole operators over the given pages and events, each page with a case by its id; SQL states what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hosts
from ..operators import crawl, html, remote, report, resources
from ..operators.policy import LimitRule, Policy, ReplaceRule
from ..streaming import feed
from .queries import _FAKE, LENIENT, ORACLES, PAYLOADS, _fake_actions, pages, query, read

#: Fixed local names: sub_, the SipHash-1-3 of the URL in sixteen digits, and its extension.
NAMES = {
    "https://cdn.trusted.com/a.js": "sub_0d6fa1798d88a072.js", "https://localhost/img.png": "sub_b34bdce44b8a4242.png", "http://10.0.0.1/x.png": "sub_224fce65101a2456.png", "https://localhost/s.css": "sub_1e91541de8dd3e1b.css", "https://localhost/a.mp3": "sub_a1874cab65588db0.mp3",
    "https://localhost/v.mp4": "sub_4c321f8deeda3ee9.mp4", "https://example.com/dir/img.png": "sub_28105d6bd064ac2e.png", "https://example.com/dir/common.css": "sub_cdd1b9fcac9050ab.css", "https://example.com/dir/foo)bar.png": "sub_8cf3bc811a351708.png",
    "https://localhost/d/i.png": "sub_44ad672547c54888.png", "https://localhost/d/e/c.css": "sub_ca4d314def947ebe.css", "https://trusted.com/app.swf": "sub_217fd05b2d3da13b.swf", "https://trusted.com/sub.vtt": "sub_74849781ede8f42b.vtt",
    "https://trusted.com/btn.png": "sub_006621e470212fda.png", "https://localhost/noext": "sub_47502d34921eb98d.png", "https://localhost/x.JPEG?y=.z": "sub_a3b7656d5d092572.JPEG",
}


def lit(value: str | int | bool | None) -> str:
    """value as SQL."""
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def cases(values: list, kind: str = "VARCHAR", by: str = "page_id") -> str:
    """SQL for the value of each row by its id."""
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN CAST({lit(v)} AS {kind})" for i, v in enumerate(values)) + " END"


def pick(values: list, kind: str = "string", by: str = "page_id") -> Column:
    """The value of each row by its id."""
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), (F.col(by) % len(values) + 1).cast("int"))


#: What LENIENT makes of PAYLOADS, and the resources that they name.
LENIENT_OUTPUT = (
    "<button>b</button>", '<a href="#">x</a>', '<a href="#">x</a>', f'<script src="{NAMES["https://cdn.trusted.com/a.js"]}"></script>', '<iframe src="#"></iframe>', "", "", "<script>/* blocked */</script>",
    f'<style>a{{background:url("{NAMES["https://localhost/img.png"]}")}}</style>', f'<img src="{NAMES["http://10.0.0.1/x.png"]}">', '<base href="/sub/"><a href="q.html">q</a>',
    '<object data="https://trusted.com/d"></object>', f'<link rel="stylesheet" href="{NAMES["https://localhost/s.css"]}">', '<form action="#"></form>',
    f'<audio src="{NAMES["https://localhost/a.mp3"]}"></audio><video src="{NAMES["https://localhost/v.mp4"]}"></video>', "",
)
NAMED = [(3, 1, "https://cdn.trusted.com/a.js"), (8, 1, "https://localhost/img.png"), (9, 1, "http://10.0.0.1/x.png"), (12, 1, "https://localhost/s.css"), (14, 1, "https://localhost/a.mp3"), (14, 2, "https://localhost/v.mp4")]
_OUT = f"html || {cases(list(LENIENT_OUTPUT))}"
ORACLES["sanitized_html"] = f"SELECT page_id, sha256({_OUT}) AS output_sha256, CAST(length({_OUT}) AS BIGINT) AS n_chars FROM pages"
ORACLES["subresources"] = "SELECT page_id, CAST(v.seq AS INTEGER) AS seq, v.url, v.local_name FROM pages JOIN (VALUES " + ", ".join(f"({k}, {n}, {lit(u)}, {lit(NAMES[u])})" for k, n, u in NAMED) + ") v(k, seq, url, local_name) ON page_id % 16 = k"


@query("SELECT page_id, 'cdn.trusted.com' AS host, 'warn' AS level FROM pages WHERE page_id % 16 = 3")
def script_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html.sanitize_html(pages(spark, sf_dir), LENIENT.with_(allow_scripts=("other.org", "a.trusted.com"))).actions
    return got.where("type = 'dangerous_scripts'").select("page_id", F.col("original").alias("host"), "level")


@query("SELECT ext, count(*) AS n FROM pages JOIN (VALUES " + ", ".join(f"({k}, {lit(u.rpartition('.')[2])})" for k, _, u in NAMED) + ") v(k, ext) ON page_id % 16 = k GROUP BY ext")
def subresource_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.sanitize_html(pages(spark, sf_dir), LENIENT).subresources
    return found.groupBy(F.regexp_extract("local_name", r"\.([a-z0-9]+)$", 1).alias("ext")).agg(F.count("*").alias("n"))


#: What the default policy says of PAYLOADS: entities come before all else in a document.
STRICT = {0: ("event_handlers", "info"), 1: ("dangerous_uris", "info"), 2: ("dangerous_domains", "error"), 3: ("dangerous_scripts", "error"), 4: ("dangerous_origins", "error"), 5: ("meta_refresh", "warn"), 6: ("xml_entities", "error"), 7: ("dangerous_js", "error"), 13: ("dangerous_domains", "error")}
_SLOTS = (
    "v(k, type, level) AS (VALUES " + ", ".join(f"({k}, {lit(t)}, {lit(x)})" for k, (t, x) in STRICT.items()) + "), "
    "s AS (SELECT page_id, slot, CASE slot WHEN 1 THEN page_id % 16 ELSE page_id // 16 % 16 END AS k FROM pages, (VALUES (1), (2)) z(slot)), "
    "a AS (SELECT page_id, type, level, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN k = 6 THEN 0 ELSE slot END, slot) AS seq FROM s JOIN v USING (k)), "
    "c AS (SELECT *, count(*) FILTER (WHERE level = 'error') OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN level = 'error' THEN 1 ELSE 0 END AS earlier FROM a)"
)


def _two_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = [*PAYLOADS, ""]
    return read(spark, sf_dir, "pages").select("page_id", F.concat("html", pick(every), F.element_at(F.array(*map(F.lit, every)), (F.floor(F.col("page_id") / 16) % 16 + 1).cast("int"))).alias("html"))


@query(f"WITH {_SLOTS} SELECT page_id, CAST(seq AS INTEGER) AS seq, type, level FROM c WHERE earlier = 0")
def strict_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.sanitize_html(_two_payloads(spark, sf_dir), Policy()).actions.select("page_id", "seq", "type", "level")


@query(f"WITH {_SLOTS} SELECT page_id, page_id IN (SELECT page_id FROM a WHERE level = 'error') AS blocked FROM pages")
def blocked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.sanitize_html(_two_payloads(spark, sf_dir), Policy()).output.select("page_id", F.col("output").isNull().alias("blocked"))


@query(f"WITH {_SLOTS} SELECT page_id, CAST(count(type) AS BIGINT) AS n_actions, coalesce(string_agg(type, ',' ORDER BY seq), '') AS types FROM pages LEFT JOIN (SELECT * FROM c WHERE earlier = 0) USING (page_id) GROUP BY page_id")
def document_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _two_payloads(spark, sf_dir)
    packed = report.reports(html.sanitize_html(docs, Policy()).actions, docs.select("page_id"), "page_id")
    return packed.select("page_id", F.size("actions").cast("long").alias("n_actions"), F.array_join(F.transform("actions", lambda a: a["type"]), ",").alias("types"))


#: Documents, what they become under the default policy (None: blocked), and the types of their actions.
DOCUMENTS = (
    ('<a href="\n\t javascript:alert(1)">l</a>', '<a href="#">l</a>', "dangerous_uris"),
    ('<a href="DATA:text/html,x" ONCLICK=y class=z>l</a>', '<a href="#" class=z>l</a>', "dangerous_uris,event_handlers"),
    ('<a href="http://googlé.com">l</a>', '<a href="#">l</a>', "idn"),
    ('<area href="https://trusted.com/map"><embed src="https://trusted.com/app.swf">', f'<area href="https://trusted.com/map"><embed src="{NAMES["https://trusted.com/app.swf"]}">', ""),
    ('<track src="https://trusted.com/sub.vtt"><input src=https://trusted.com/btn.png>', f'<track src="{NAMES["https://trusted.com/sub.vtt"]}"><input src="{NAMES["https://trusted.com/btn.png"]}">', ""),
    ('<base href="/d/"><img src="i.png"><base href="e/"><style>@import "c.css";</style>', f'<base href="/d/"><img src="{NAMES["https://localhost/d/i.png"]}"><base href="e/"><style>@import "{NAMES["https://localhost/d/e/c.css"]}";</style>', ""),
    ('<iframe src="https://a.trusted.com/f"></iframe><object data="/own"></object>', None, "dangerous_origins"),
    ('<meta http-equiv="REFRESH" content="5"><p>x</p>', "<p>x</p>", "meta_refresh"),
    ("<script>let a = 1;</script><!-- <b onclick=1> -->", "<script>let a = 1;</script><!-- <b onclick=1> -->", ""),
    ('<script src="//">x</script>', None, "dangerous_scripts"),
    ('<img src="/noext"><img src="x.JPEG?y=.z" onload="a()">', f'<img src="{NAMES["https://localhost/noext"]}"><img src="{NAMES["https://localhost/x.JPEG?y=.z"]}">', "event_handlers"),
    ("<p title='<b onclick=1>'>a < b</p>", "<p title='<b onclick=1>'>a < b</p>", ""),
    ('<link rel="icon" href="https://trusted.com/btn.png"><a href="mailto:x@evil.com">m</a>', '<link rel="icon" href="https://trusted.com/btn.png"><a href="mailto:x@evil.com">m</a>', ""),
    ('<a href="https://sub.malicious-domain.com/x?y">l</a>', None, "dangerous_domains"),
    ("<!DOCTYPE x [<!entity a 'b'>]>", None, "xml_entities"),
)


@query(f"SELECT page_id, {cases([d[1] for d in DOCUMENTS])} AS output, {cases([d[2] for d in DOCUMENTS])} AS types FROM pages")
def rewritten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "pages").select("page_id", pick([d[0] for d in DOCUMENTS]).alias("html"))
    rows = html.sanitize_rows(docs, Policy())
    return rows.select("page_id", "output", F.array_join(F.transform("actions", lambda a: a["type"]), ",").alias("types"))


#: Documents under a policy that keeps or swaps what it finds.
KEEPING = Policy(
    fetch_sub_resources=False, event_handlers=ReplaceRule("trace", None), dangerous_uris=ReplaceRule("trace", None), dangerous_js=ReplaceRule("warn", None), idn=ReplaceRule("info", None),
    dangerous_domains=ReplaceRule("warn", "safe.com"), dangerous_origins=ReplaceRule("warn", ""), xml_entities=ReplaceRule("warn", "€"), meta_refresh=ReplaceRule("warn", None),
)
KEPT = (
    ('<b onclick="x">é</b><img src="/i.png">', '<b onclick="x">é</b><img src="/i.png">'), ('<a href="javascript:x">l</a>', '<a href="javascript:x">l</a>'), ("<script>alert(1)</script>", "<script>alert(1)</script>"),
    ('<a href="http://googlé.com/ü">l</a>', '<a href="http://googlé.com/ü">l</a>'), ('<a href="https://www.evil.com/p?q">l</a>', '<a href="https://safe.com/p?q">l</a>'), ('<iframe src="https://x.org/" id=i></iframe>', "<iframe id=i></iframe>"),
    ('é<!ENTITY a "ö">é', "é€é"), ('<meta http-equiv="refresh" content="1">', '<meta http-equiv="refresh" content="1">'),
)


@query(f"SELECT page_id, {cases([d[1] for d in KEPT])} AS output FROM pages")
def kept_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "pages").select("page_id", pick([d[0] for d in KEPT]).alias("html"))
    return html.sanitize_html(docs, KEEPING).output


#: Style sheets at https://example.com/dir/style.css, what they become, and how many resources they name.
SHEETS = (
    ("a{b:url('img.png')}", f'a{{b:url("{NAMES["https://example.com/dir/img.png"]}")}}', 1), ("@import 'common.css'; x{}", f'@import "{NAMES["https://example.com/dir/common.css"]}"; x{{}}', 1),
    ("b{c:url(data:text/plain,x)}", 'b{c:url("#")}', 0), ('d{e:url( "javascript:alert(1)" )}', 'd{e:url( "#" )}', 0), ("f{g:url(foo\\)bar.png)}", f'f{{g:url("{NAMES["https://example.com/dir/foo)bar.png"]}")}}', 1),
    ("@import 'x' screen;", "@import 'x' screen;", 0), ("h{i:url(http://)}", 'h{i:url("")}', 0), ("j{k:url(https://googlé.com/a.png)}", 'j{k:url("#")}', 0), ("plain{}", "plain{}", 0),
)


@query(f"SELECT page_id, {cases([d[1] for d in SHEETS])} AS output, {cases([d[2] for d in SHEETS], 'BIGINT')} AS named FROM pages")
def css_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resources.sanitize_css_udf(Policy())(pick([d[0] for d in SHEETS]), F.lit("https://example.com/dir/style.css"))
    return read(spark, sf_dir, "pages").select("page_id", got.alias("r")).select("page_id", "r.output", F.size("r.subresources").cast("long").alias("named"))


#: JPEGs and PNGs as hexadecimal digits, with and without their metadata.
JPEGS = (
    ("ffd8ffe1000600000000ffd9", "ffd8ffd9"), ("ffd8ffe00004aabbffe10004ccddffd9", "ffd8ffe00004aabbffd9"), ("ffd8aaffe1000411110000ffd9", "ffd8aa0000ffd9"), ("ffd8ffd9ffe100041111ffd9", "ffd8ffd9"),
    ("ffd8ff00ffd0ffe10004aaaaffd9", "ffd8ff00ffd0ffd9"), ("ffd8ffe1ffffaa", "ffd8ffe1ffffaa"), ("616263", "616263"), ("ffd8ffda0004000011ff0022ffd9", "ffd8ffda0004000011ff0022ffd9"), ("ffd8", "ffd8"), ("ffd8ff", "ffd8ff"),
)
_SIGN, _IDAT, _TEXT = "89504e470d0a1a0a", "0000000449444154aabbccdd00000000", "0000000174455874ff00000000"
PNGS = ((_SIGN + _TEXT + _IDAT, _SIGN + _IDAT), (_SIGN + _IDAT + _TEXT + _TEXT, _SIGN + _IDAT), (_SIGN, _SIGN), (_SIGN + _IDAT[:20], _SIGN + _IDAT[:20]), ("00", "00"))


@query(f"SELECT page_id, {cases([d[1] for d in JPEGS])} AS jpeg, {cases([d[1] for d in PNGS])} AS png FROM pages")
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.unhex(pick([d[0] for d in JPEGS])).alias("j"), F.unhex(pick([d[0] for d in PNGS])).alias("p"))
    return rows.select("page_id", F.lower(F.hex(resources.strip_jpeg("j"))).alias("jpeg"), F.lower(F.hex(resources.strip_png("p"))).alias("png"))


#: Scripts; whether they are dangerous; what is left of them with a replacement.
SCRIPTS = (("console.log(1)", False), ("eval(x)", True), ("document  .\n write (1)", True), ("myalert(1)", True), ("let evaluator = 1;", False), ("alert", False), ("", False))


@query(f"SELECT page_id, {cases([d[1] for d in SCRIPTS], 'BOOLEAN')} AS bad, {cases(['/* no */' if d[1] else d[0] for d in SCRIPTS])} AS replaced, {cases([None if d[1] else d[0] for d in SCRIPTS])} AS blocked FROM pages")
def script_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", pick([d[0] for d in SCRIPTS]).alias("js"))
    js = F.col("js")
    return rows.select("page_id", resources.is_dangerous_js(js).alias("bad"), resources.sanitize_js(js, ReplaceRule("warn", "/* no */")).alias("replaced"), resources.sanitize_js(js, ReplaceRule("error")).alias("blocked"))


#: Links on https://Host.Example/a/b/c?d, their addresses, hosts, and whether the host is an international one.
LINKS = (
    ("../x", "https://host.example/a/x", "host.example", False), ("?q#f", "https://host.example/a/b/c?q#f", "host.example", False), ("//Other.org/./y/../z", "https://other.org/z", "other.org", True),
    ("http://googlé.com", "http://xn--googl-fsa.com/", "xn--googl-fsa.com", True), (" \thttps:\\\\h.org\\p ", "https://h.org/p", "h.org", False), ("https://h.org:443/", "https://h.org/", "h.org", False),
    ("http://h.org:8080", "http://h.org:8080/", "h.org", False), ("mailto:a@b", "mailto:a@b", None, False), ("https://", None, None, False), ("https://[::1]/x", "https://[::1]/x", "[::1]", False), ("https://u:p@h.org/", "https://u:p@h.org/", "h.org", False),
)


@query(f"SELECT page_id, {cases([d[1] for d in LINKS])} AS href, {cases([d[2] for d in LINKS])} AS host, {cases([d[3] for d in LINKS], 'BOOLEAN')} AS idn FROM pages")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = hosts.resolve_url(pick([d[0] for d in LINKS]), F.lit("https://host.example/a/b/c?d"))
    rows = read(spark, sf_dir, "pages").select("page_id", url.alias("u"))
    return rows.select("page_id", "u.href", "u.host", hosts.is_idn(F.col("u")).alias("idn"))


@query(f"SELECT page_id, {cases(list(NAMES.values()))} AS local_name FROM pages")
def local_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = ["js", "png", "png", "css", "mp3", "mp4", "png", "css", "png", "png", "css", "bin", "vtt", "png", "png", "png"]
    return read(spark, sf_dir, "pages").select("page_id", hosts.local_name(pick(list(NAMES)), pick(defaults)).alias("local_name"))


ADDRESSES = (
    ("127.0.0.1", False), ("10.1.2.3", False), ("172.16.0.1", False), ("172.32.0.1", True), ("192.168.1.1", False), ("169.254.0.9", False), ("100.64.0.1", False), ("100.128.0.0", True), ("8.8.8.8", True), ("224.0.0.1", False),
    ("::1", False), ("fc00::1", False), ("fd12::1", False), ("fe80::1", False), ("febf::1", False), ("fec0::1", True), ("ff02::1", False), ("::", False), ("::ffff:10.0.0.1", False), ("::ffff:8.8.8.8", True), ("2001:4860:4860::8888", True), ("nothing", None),
)


@query(f"SELECT page_id, {cases(['none' if d[1] is None else str(d[1]).lower() for d in ADDRESSES])} AS safe FROM pages")
def safe_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.coalesce(hosts.is_safe_ip(pick([d[0] for d in ADDRESSES])).cast("string"), F.lit("none")).alias("safe"))


#: url, declared type, first bytes; the type by all of them, whether it is markup.
FETCHED = (
    ("https://h/a.png", None, "ffd8ffe0", "image/jpeg", False), ("https://h/a.JS", "text/javascript; x=y", "00", "application/javascript", False), ("https://h/a.css?x=.png", "image/png", "00", "text/css", False),
    ("https://h/a", " IMAGE/JPG ", "00", "image/jpeg", False), ("https://h/a.svg", None, "00", None, True), ("https://h/a", "application/xhtml+xml", "25504446", "application/pdf", True), ("https://h/a.webp", None, "524946460000000057454250", "image/webp", False),
    ("https://h/x.y/z", None, "474946383761", "image/gif", False), ("https://h/a.HTM#.css", "text/plain", "00", None, True),
)


@query(f"SELECT page_id, {cases([d[3] for d in FETCHED])} AS type, {cases([d[4] for d in FETCHED], 'BOOLEAN')} AS markup FROM pages")
def resource_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, declared, data = pick([d[0] for d in FETCHED]), pick([d[1] for d in FETCHED]), F.unhex(pick([d[2] for d in FETCHED]))
    return read(spark, sf_dir, "pages").select("page_id", resources.resource_type(data, url, declared).alias("type"), resources.is_markup(declared, url).alias("markup"))


#: url, status, declared type, text of the body; what becomes of it, and what it broke.
RESPONSES = (
    ("https://h/a.js", 200, None, "eval(1)", None, "dangerous_js"), ("https://h/b.js", 200, "text/javascript", "let b;", "let b;", ""), ("https://h/c.pdf", 200, None, "%PDF /JS ", None, "pdf_active_content"),
    ("https://h/d.png", 200, "image/png", "%PDF-", None, "mismatched_mime"), ("https://h/e", 200, None, "?", None, "unknown_resource"), ("https://h/f.gif", 200, "image/gif", "GIF89a", "GIF89a", ""),
    ("https://h/g.css", 200, None, 'a{b:url("data:x")}', 'a{b:url("#")}', "dangerous_uris"), ("https://h/h.svg", 200, "image/svg+xml", "<!ENTITY a 'b'>", None, "xml_entities"),
)


@query(f"SELECT page_id, {cases([d[4] for d in RESPONSES])} AS output, {cases([d[5] for d in RESPONSES])} AS violations FROM pages")
def sanitized_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", pick([d[0] for d in RESPONSES]).alias("url"), pick([d[2] for d in RESPONSES]).alias("content_type"), F.encode(pick([d[3] for d in RESPONSES]), "UTF-8").alias("data"))
    got = crawl.sanitize_responses(rows, Policy())
    return got.select("page_id", F.decode("output", "UTF-8").alias("output"), F.array_join(F.transform("violations", lambda v: v["type"]), ",").alias("violations"))


#: The pages' addresses as seeds, sources of twenty, with a body for two of three and a style sheet that leads on.
_SEEDS = "seeds AS (SELECT page_id // 20 AS source_idx, page_id AS seq, CASE WHEN page_id % 7 = 0 THEN 'http' WHEN page_id % 7 = 1 THEN 'https://www.evil.com/x' ELSE 'https' END AS kind, page_id FROM pages)"
_CRAWLED = (
    "asked AS (SELECT source_idx, page_id, kind, row_number() OVER (PARTITION BY source_idx ORDER BY page_id) AS nth FROM seeds), "
    "told AS (SELECT source_idx, page_id, CASE WHEN nth > {most} THEN 'over_budget' WHEN kind = 'http' THEN 'non_https' WHEN page_id % 7 = 1 THEN 'dangerous_connection' WHEN page_id % 3 = 2 THEN 'failed' ELSE 'fetched' END AS status FROM asked)"
)


def _seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Seeds by page, each at an address of its own, and the responses to them and to the resources that their style sheets name."""
    i = F.col("page_id")
    start = F.when(i % 7 == 0, "http://h.org/").when(i % 7 == 1, "https://www.evil.com/").otherwise("https://h.org/")
    url = F.concat(start, i.cast("string"), F.lit(".css"))
    rows = read(spark, sf_dir, "pages").select(F.floor(i / 20).cast("long").alias("source_idx"), i.alias("seq"), url.alias("url"), F.lit("l").alias("local_name"), i)
    css = lambda text: F.encode(text, "UTF-8")
    own = rows.where(i % 3 != 2).select("url", F.lit(200).alias("status_code"), F.lit("text/css").alias("content_type"), css(F.concat(F.lit('@import "deep'), i.cast("string"), F.lit('.css"; @import "all.css";'))).alias("data"))
    deep = rows.select(F.concat(F.lit("https://h.org/deep"), i.cast("string"), F.lit(".css")).alias("url"), F.lit(200), F.lit("text/css"), css(F.lit("a{}")))
    return rows.drop("page_id"), own.union(deep)


@query(f"WITH {_SEEDS}, {_CRAWLED.format(most=12)} SELECT source_idx, page_id AS seq, status FROM told")
def crawl_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, responses = _seeds(spark, sf_dir)
    got = crawl.crawl(seeds, responses, Policy(max_subresources=LimitRule(12)))
    return got.select("source_idx", F.col("seq")[0].alias("seq"), "status")


@query(
    f"WITH {_SEEDS}, {_CRAWLED.format(most=24)}, links AS (SELECT source_idx, page_id, 0 AS k, 'deep' || page_id AS name FROM told WHERE status = 'fetched' UNION ALL SELECT source_idx, page_id, 1, 'all' FROM told WHERE status = 'fetched'), "
    # requests of the first round count, those over budget too; a source's own links come in the order of their sheets; `all` goes to the first source in budget that names it
    "used AS (SELECT source_idx, count(*) AS n FROM told GROUP BY source_idx), "
    "first_names AS (SELECT source_idx, name, min(page_id * 2 + k) AS place FROM links GROUP BY ALL), "
    "ranked AS (SELECT f.*, coalesce(u.n, 0) AS n, row_number() OVER (PARTITION BY f.source_idx ORDER BY place) AS r FROM first_names f JOIN used u USING (source_idx)), "
    "holder AS (SELECT min(source_idx) AS s FROM ranked WHERE name = 'all' AND n + r <= 24), "
    "numbered AS (SELECT x.source_idx, name, n + row_number() OVER (PARTITION BY x.source_idx ORDER BY place) AS nth FROM ranked x, holder WHERE name <> 'all' OR s IS NULL OR x.source_idx <= s) "
    "SELECT source_idx, 2 AS depth, name || '.css' AS name, CASE WHEN nth > 24 THEN 'over_budget' WHEN name = 'all' THEN 'failed' ELSE 'fetched' END AS status FROM numbered"
)
def crawl_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, responses = _seeds(spark, sf_dir)
    got = crawl.crawl(seeds.where("source_idx >= 0"), responses, Policy(max_subresources=LimitRule(24), max_resource_depth=LimitRule(2)))
    return got.where("depth = 2").select("source_idx", "depth", F.regexp_extract("url", r"/([^/]*)$", 1).alias("name"), "status")


#: What a page asked for at its own address comes to, by its id.
_PAGE_STATUS = "CASE WHEN scheme <> 'https' THEN 'non_https' WHEN page_id % 5 = 0 THEN 'failed' WHEN page_id % 5 = 1 THEN 'mismatched_mime' WHEN page_id % 5 = 2 THEN 'failed' WHEN page_id % 5 = 3 THEN 'blocked' ELSE 'sanitized' END"


@query(f"SELECT page_id AS source_idx, {_PAGE_STATUS} AS status FROM (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages)")
def remote_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    rows = read(spark, sf_dir, "pages").select(i, F.concat(F.regexp_extract("url", "^([^?#]*)", 1), i.cast("string")).alias("url"), "html")
    body = F.encode(F.when(i % 5 == 3, F.concat("html", F.lit('<a href="https://evil.com/">x</a>'))).otherwise(F.col("html")), "UTF-8")
    answers = rows.where(i % 5 != 0).select("url", F.when(i % 5 == 2, 500).otherwise(200).alias("status_code"), F.when(i % 5 == 1, "text/plain").when(i % 5 == 3, "text/html; charset=utf-8").alias("content_type"), body.alias("data"))
    got = remote.sanitize_pages(rows.select(i.alias("source_idx"), "url"), answers, Policy(max_bytes=LimitRule(1 << 30)))
    return got.output.select("source_idx", "status")


@query("WITH h AS (SELECT page_id // 5 AS chain, page_id % 5 AS hop_no, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages) SELECT chain, hop_no, type, level FROM h, (VALUES ('max_redirects', 'info'), ('dangerous_connection', 'warn')) v(type, level) WHERE hop_no > 0 AND CASE type WHEN 'max_redirects' THEN hop_no > 2 ELSE host = 'example.net' OR ends_with(host, '.example.net') END")
def redirect_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).cast("long").alias("chain"), (F.col("page_id") % 5).alias("hop_no"), "url")
    return crawl.redirect_actions(hops, Policy(denied=("example.net",), max_redirects=LimitRule(2, "info"), dangerous_connection="warn"))


@query("SELECT page_id, CASE WHEN strlen(html) >= 128 THEN html[1:list_max([k for k in range(0, 129) if strlen(html[1:k]) < 128])] || '...' ELSE html END AS shown FROM pages")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", report.shortened(F.col("html")).alias("shown"))


@query(f"WITH {_FAKE} SELECT doc, seq, '[' || upper(level) || '] ' || type || ': ' AS line FROM k WHERE level <> 'info'")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.log_lines(html.first_error_cutoff(_fake_actions(spark, sf_dir), "doc"), "doc", "warn").select("doc", "seq", "line")


@query("WITH r AS (SELECT event_type AS workload, CAST(1 << CAST(user_id % 3 AS INTEGER) AS INTEGER) AS threads, round(sum(abs(value)), 4) AS seconds FROM events GROUP BY ALL) SELECT workload, threads, seconds, round(max(seconds) FILTER (WHERE threads = 1) OVER (PARTITION BY workload) / seconds, 6) AS speedup FROM r")
def speedup_by_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = F.expr("cast(shiftleft(1, cast(user_id % 3 as int)) as int)")
    runs = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("workload"), threads.alias("threads")).agg(F.round(F.sum(F.abs("value")), 4).alias("seconds"))
    return report.speedup(runs).withColumn("speedup", F.round("speedup", 6))


def _streamed(spark: SparkSession, sf_dir: str, made, mode: str) -> DataFrame:  # noqa: ANN001
    """The rows of a streaming query over the events as they lie, once all are read, kept in the shared folder."""
    where = feed.shared_folder(spark)
    events = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: the table may be a file or a folder
    return feed.run_once(made(stream), f"{where}/rows", f"{where}/state", mode)


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def stream_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lambda s: feed.rule_counts(s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type")), width="1 hour").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "type", "n")
    return _streamed(spark, sf_dir, counted, "complete")


@query("SELECT DISTINCT user_id // 2 AS url FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: feed.first_seen(s.select(F.floor(F.col("user_id") / 2).cast("long").alias("url"))), "append")


@query("SELECT user_id AS source_idx, least(count(*), 5) AS taken FROM events GROUP BY user_id")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = lambda s: feed.take_budget(s.select(F.col("user_id").alias("source_idx"), F.col("event_id").cast("string").alias("url")), 5)
    return _streamed(spark, sf_dir, taken, "append").groupBy("source_idx").agg(F.count("*").alias("taken"))

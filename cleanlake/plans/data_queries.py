"""Queries whose rows follow from the text and addresses of the pages themselves, each through a whole operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hosts
from ..operators import crawl, html, local, remote, resources, tokens
from ..operators.policy import LimitRule, Policy, ReplaceRule
from ..streaming import chunks
from .queries import ATTRS, BARE, LENIENT, TAGS, P, pages, query, read

_STRAY = " 1 < 2 <3 </> <p"
_ODD = "<!--><i title=it's on=1>--><!-- a --!><u a=b\"c d>"
_TITLES = "t AS (SELECT page_id, lower(regexp_extract(head, '^<([A-Za-z][^ />]*)', 1)) AS tag FROM tags)"


@query(f"WITH {P}, {BARE}, {TAGS}, {_TITLES} SELECT tag, count(*) AS n FROM (SELECT tag FROM t UNION ALL SELECT unnest(['i', 'u']) FROM pages) GROUP BY tag")
def token_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stray `<`, quotes within names and values, and comments that end early, put into every page, hide no tag and make none."""
    docs = pages(spark, sf_dir).select("page_id", F.concat(F.lit(_ODD), F.replace("html", F.lit("<p"), F.lit(_STRAY))).alias("html"))
    return tokens.segments(docs, "page_id", "html").groupBy("tag").agg(F.count("*").alias("n"))


@query(f"WITH {P}, {BARE}, {TAGS}, {ATTRS} SELECT page_id, 'on' AS name, '1' AS value FROM pages UNION ALL SELECT page_id, name, value FROM attrs WHERE starts_with(name, 'on')")
def handlers_at_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The handlers of the same pages, those behind odd markup too, as the actions tell them."""
    docs = pages(spark, sf_dir).select("page_id", F.concat(F.lit(_ODD), F.replace("html", F.lit("<p"), F.lit(_STRAY))).alias("html"))
    acts = html.sanitize_html(docs, LENIENT).actions.where("type = 'event_handlers'")
    read_by = docs.select("page_id", resources.without_entities(F.col("html"), LENIENT.xml_entities).cast("binary").alias("data"))
    name = F.substring("data", (F.col("loc_start") + 1).cast("int"), (F.col("loc_end") - F.col("loc_start")).cast("int")).cast("string")
    return acts.join(read_by, "page_id").select("page_id", F.lower(name).alias("name"), F.col("original").alias("value"))


_H = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
_S = "regexp_extract(url, '^([a-z]+):', 1)"
#: Links made of a page's own address: as Spark SQL and DuckDB both read it, and what it is joined to.
_LINKS = (
    (f"concat('//', upper({_H}), '/a b')", f"concat({_S}, '://', {_H}, '/a%20b')"),
    ("'?q=<'", "concat(regexp_replace(url, '[?#].*', ''), '?q=%3C')"),
    (f"concat('http://%', lower(hex(substr({_H}, 1, 1))), substr({_H}, 2), '/')", f"concat('http://', {_H}, '/')"),
    (f"concat('https:///', {_H}, '/p')", None),
    (f"concat('http:', {_H}, '/p')", None),
    ("concat('/./a/../b/%2E%2e/', page_id, ' ')", f"concat({_S}, '://', {_H}, '/', page_id)"),
    (f"concat('https://u:p@', {_H}, ':8443/x#y z')", f"concat('https://u:p@', {_H}, ':8443/x#y%20z')"),
    (f"concat('mailto:', {_H})", f"concat('mailto:', {_H})"),
    (f"concat('http://', {_H}, ':99999/')", "CAST(NULL AS VARCHAR)"),
    (f"concat('ftp://ﬀ.', {_H}, '/é')", f"concat('ftp://ff.', {_H}, '/%C3%A9')"),
    (f"concat('ws://faß.', {_H})", f"concat('ws://xn--fa-hia.', {_H}, '/')"),
    ("concat('ftp://0x7f.', page_id % 16777216, '/..')", "concat('ftp://127.', page_id // 65536 % 256, '.', page_id // 256 % 256, '.', page_id % 256, '/')"),
    (f"concat('wss://[::', lower(hex(page_id + 1)), ']:443/', {_H})", f"concat('wss://[::', lower(hex(page_id + 1)), ']/', {_H})"),
)


def _by_page(values: list[str]) -> str:
    return f"CASE page_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _joined_sql() -> str:
    same = f"concat(regexp_replace(url, '/[^/]*$', '/'), {_H}, '/p')"
    bare = "regexp_replace(url, '[?#].*', '')"
    want = [w for _, w in _LINKS]
    want[3] = f"concat('https://', {_H}, '/p')"
    want[4] = f"CASE WHEN {_S} = 'http' THEN {same.replace('url', bare, 1)} ELSE concat('http://', {_H}, '/p') END"
    return f"SELECT page_id, {_by_page(want)} AS href FROM pages"


@query(_joined_sql())
def joined_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr(_by_page([v for v, _ in _LINKS]))
    return read(spark, sf_dir, "pages").select("page_id", hosts.resolve_url(value, F.col("url"))["href"].alias("href"))


_SHARED = "l AS (SELECT page_id, url, min(n) AS seq FROM (SELECT page_id, generate_subscripts(us, 1) AS n, unnest(us) AS url FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS us FROM pages)) GROUP BY page_id, url)"


@query(
    f"WITH RECURSIVE {_SHARED}, s AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS r, list(url ORDER BY seq, url) AS us FROM l GROUP BY page_id), "
    "turn AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS page_id, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS free "
    "UNION ALL SELECT s.r, s.page_id, list_concat(list_concat(t.taken, t.free[:5]), []), list_filter(s.us, lambda x: NOT list_contains(list_concat(t.taken, t.free[:5]), x)) FROM turn t JOIN s ON s.r = t.r + 1) "
    "SELECT page_id AS source_idx, unnest(free) AS url, CAST(generate_subscripts(free, 1) AS INTEGER) AS nth, CASE WHEN generate_subscripts(free, 1) > 5 THEN 'over_budget' ELSE 'fetch' END AS status FROM turn WHERE page_id IS NOT NULL"
)
def crawl_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page may ask for, one after the other, of the links that many pages share, five each."""
    links = tokens.attributes(tokens.segments(read(spark, sf_dir, "pages"), "page_id", "html"), "page_id").where("tag = 'a' and name = 'href'")
    found = links.select(F.col("page_id").alias("source_idx"), (F.col("pos") * 1000 + F.col("n")).alias("seq"), F.col("value").alias("url"))
    return crawl.enqueue(found, found.select("url").limit(0), Policy(max_subresources=LimitRule(5))).select("source_idx", "url", "nth", "status")


@query(f"SELECT min(page_id) AS source_idx, 'https://' || {_H} || '/i.gif' AS url, 'fetched' AS status FROM pages GROUP BY ALL")
def crawl_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name each other, and a picture of their host: pages are inputs, and are not fetched again."""
    rows = read(spark, sf_dir, "pages").select("page_id", "url")
    picture = rows.select(F.col("page_id").alias("source_idx"), F.lit(2).cast("long").alias("seq"), F.expr(f"concat('https://', {_H}, '/i.gif')").alias("url"))
    following = rows.select((F.col("page_id") - 1).alias("source_idx"), F.lit(1).cast("long").alias("seq"), "url")
    named = crawl.name_seeds(picture.unionByName(following))
    responses = named.select("url", F.lit(200).alias("status_code"), F.lit("image/gif").alias("content_type"), F.lit(b"GIF89a").alias("data"))
    return remote.fetch_subresources(named, responses, Policy(), inputs=rows).select("source_idx", "url", "status")


#: Bytes of a chunk, and a limit of bytes.
CHUNK, LIMIT = 97, 2000


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = pages(spark, sf_dir).select("page_id", F.col("html").cast("binary").alias("data"))
    places = F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / CHUNK).cast("int"))
    each = data.select("page_id", "data", F.explode(places).alias("seq"))
    return each.select("page_id", "seq", F.substring("data", F.col("seq") * CHUNK + 1, F.lit(CHUNK)).alias("data"))


@query(
    f"WITH {P} SELECT page_id, CAST(strlen(regexp_replace(html, '<!ENTITY[^>]*>', '', 'gi')) AS BIGINT) AS n_bytes, CAST(len(regexp_extract_all(html, '(?i)<!ENTITY[^>]*>')) AS BIGINT) AS n_found, "
    "CASE WHEN contains(html, '<!ENTITY') THEN CAST(strlen(html[1:strpos(html, '<!ENTITY') - 1]) AS BIGINT) ELSE -1 END AS first_at FROM p"
)
def chunked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that come in chunks lose what whole ones lose."""
    got = chunks.filter_chunks(_chunked(spark, sf_dir), ReplaceRule("warn", ""), "page_id")
    total = lambda c: F.sum(c).cast("long")
    return got.groupBy("page_id").agg(total(F.octet_length("data")).alias("n_bytes"), total(F.size("found")).alias("n_found"), F.coalesce(F.min(F.get("found", F.lit(0))["start"]), F.lit(-1)).alias("first_at"))


@query(f"WITH {P}, n AS (SELECT page_id, strlen(html) AS n FROM p) SELECT page_id, CAST(CASE WHEN n <= {LIMIT} THEN ceil(n / {CHUNK}) ELSE {LIMIT // CHUNK} END AS BIGINT) AS n_chunks, n > {LIMIT} AS ended FROM n")
def body_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are passed on before a body goes beyond its budget of bytes, and whether it does."""
    filtered = chunks.filter_chunks(_chunked(spark, sf_dir), ReplaceRule("warn", ""), "page_id")
    kept, actions = chunks.within_budget(filtered, Policy(max_bytes=LimitRule(LIMIT)), "page_id")
    ends = actions.where("type = 'max_bytes'").select("page_id", F.lit(True).alias("e"))
    return kept.groupBy("page_id").agg(F.count("*").alias("n_chunks")).join(ends, "page_id", "left").select("page_id", "n_chunks", F.coalesce("e", F.lit(False)).alias("ended"))


def _bytes(parts: str) -> Column:
    return F.expr(f"encode({parts}, 'UTF-8')")


_PDF_HEAD, _PDF_TAIL = "concat('%PDF-1.4 ', url, ' stream /JS ( endstream ')", "concat('/AA ', page_id, ' ')"


@query(
    f"WITH h AS (SELECT page_id, CAST(strlen({_PDF_HEAD}) AS BIGINT) AS a, CAST(strlen({_PDF_TAIL}) AS BIGINT) AS b FROM pages) SELECT page_id, 1 AS seq, 'Additional Action (/AA)' AS original, a AS loc_start, a + 3 AS loc_end FROM h "
    "UNION ALL SELECT page_id, 2, 'JavaScript (/JS)', a + b, a + b + 3 FROM h"
)
def pdf_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the active entries of PDFs are, streams counted, which hold the pages' addresses."""
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("source_idx"), F.lit("pdf").alias("kind"), _bytes(f"concat({_PDF_HEAD}, {_PDF_TAIL}, '/JS(')").alias("data"))
    acts = local.sanitize_files(rows, Policy(pdf_active_content="warn")).actions
    return acts.select(F.col("source_idx").alias("page_id"), F.col("seq").cast("int").alias("seq"), "original", "loc_start", "loc_end")


_CODE = "concat('var é = \"', url, '\"; eval(', page_id, ');')"


@query(f"WITH h AS (SELECT page_id, CAST(strlen(concat('var é = \"', url, '\"; ')) AS BIGINT) AS a, CAST(strlen({_CODE}) AS BIGINT) AS b FROM pages) SELECT page_id, 'eval(..)' AS original, a AS loc_start, a + 5 AS loc_end FROM h UNION ALL SELECT page_id, 'alert (..)', b + 1, b + 8 FROM h")
def script_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dangerous call of scripts that are kept, and where it is."""
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("source_idx"), F.lit("js").alias("kind"), _bytes(f"concat({_CODE}, ' alert (1)')").alias("data"))
    acts = local.sanitize_files(rows, Policy(dangerous_js=ReplaceRule("warn", None))).actions
    return acts.select(F.col("source_idx").alias("page_id"), "original", "loc_start", "loc_end")


@query(
    "SELECT page_id, 1 AS seq, 'https://localhost/i/' || page_id || '.gif' AS url, 'gif' AS ext FROM pages UNION ALL "
    "SELECT page_id, 2, 'https://localhost/s?' || page_id, 'js' FROM pages UNION ALL SELECT page_id, 3, 'https://localhost/t.v1/x', 'mp4' FROM pages"
)
def pictures_and_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of drawings, sources and unquoted addresses in every page, by their default kinds."""
    more = F.concat(F.lit("<svg><image href=/i/"), "page_id", F.lit(".gif></svg><source src=/s?"), "page_id", F.lit("><video src=/t.v1/x>"))
    docs = read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("html", "<(?=img|link|input|source)", "&lt;"), more).alias("html"))
    found = html.sanitize_html(docs, LENIENT).subresources
    return found.select("page_id", F.col("seq").cast("int").alias("seq"), "url", F.substring_index("local_name", ".", -1).alias("ext"))

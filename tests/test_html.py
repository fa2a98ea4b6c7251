import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cleanlake.functions.urls import parse_url
from cleanlake.operators.html import is_dangerous_uri, replaced, sanitize_html, sanitize_rows, tags_and_bases
from cleanlake.operators.policy import Policy, ReplaceRule
from cleanlake.operators.tokens import list_tags

P = Policy()
WARN = lambda text: ReplaceRule("warn", text)
KEEP = ReplaceRule("trace", None)
REPLACING = P.with_(
    fetch_sub_resources=False, allow_scripts=("trusted.com",), event_handlers=ReplaceRule("info", "alert('blocked')"), dangerous_scripts=WARN("#"),
    dangerous_js=WARN("/* Blocked */"), dangerous_uris=ReplaceRule("info", ""), dangerous_origins=WARN("#"), dangerous_domains=WARN(""), xml_entities=WARN("!"),
)
KEEPING = P.with_(fetch_sub_resources=False, event_handlers=KEEP, dangerous_js=KEEP, dangerous_uris=KEEP, idn=KEEP, dangerous_domains=WARN("safe.com"))
#: input, policy, output
CASES = {
    "handlers": ('<button onclick="alert(1)" class="btn" ONLOAD="doSomething()">Click me</button>', P, '<button class="btn">Click me</button>'),
    "handler replaced": ('<button onclick="alert(1)"></button>', REPLACING, "<button onclick=\"alert('blocked')\"></button>"),
    "handler kept": ('<button onclick="alert(1)"></button>', KEEPING, '<button onclick="alert(1)"></button>'),
    "script blocked": ('<script src="https://untrusted.com/lib.js"></script>', REPLACING, '<script src="#"></script>'),
    "script kept": ("<script>alert(1)</script>", KEEPING, "<script>alert(1)</script>"),
    "script replaced": ("<script>alert(1)</script>", REPLACING, "<script>/* Blocked */</script>"),
    "uris": ('<a href="javascript:alert(1)" src="  data:text/html,malicious  " data-url="other">link</a>', P, '<a href="#" src="#" data-url="other">link</a>'),
    "uri removed": ('<a href="\n\t javascript:alert(1)">link</a>', REPLACING, "<a>link</a>"),
    "uri kept": ('<a href="javascript:alert(1)">link</a>', KEEPING, '<a href="javascript:alert(1)">link</a>'),
    "idn kept": ('<a href="http://googlé.com">Link</a>', KEEPING, '<a href="http://googlé.com">Link</a>'),
    "idn": ('<a href="http://googlé.com">Link</a>', P, '<a href="#">Link</a>'),
    "frames": (
        '<div><iframe src="https://trusted.com/page.html"></iframe><iframe src="https://untrusted.com/page.html"></iframe><object data="https://trusted.com/data.bin"></object><object data="https://untrusted.com/data.bin"></object></div>',
        REPLACING,
        '<div><iframe src="https://trusted.com/page.html"></iframe><iframe src="#"></iframe><object data="https://trusted.com/data.bin"></object><object data="#"></object></div>',
    ),
    "refresh": ('<html><head><meta charset="utf-8"><meta http-equiv="refresh" content="5;url=https://trusted.com"></head></html>', P, '<html><head><meta charset="utf-8"></head></html>'),
    "resources": (
        '<div><form action="https://trusted.com/submit"></form><area href="https://trusted.com/map"></area><audio src="https://trusted.com/song.mp3"></audio><video src="https://trusted.com/movie.mp4"></video><embed src="https://trusted.com/app.swf"></embed><track src="https://trusted.com/sub.vtt"></track><input src="https://trusted.com/btn.png"></input></div>',
        P,
        '<div><form action="https://trusted.com/submit"></form><area href="https://trusted.com/map"></area><audio src="sub_bae1797ac4ee235d.mp3"></audio><video src="sub_e9926d606072a395.mp4"></video><embed src="sub_217fd05b2d3da13b.swf"></embed><track src="sub_74849781ede8f42b.vtt"></track><input src="sub_006621e470212fda.png"></input></div>',
    ),
    "domains removed": ('<div><a href="https://evil.com/malicious">Link</a><form action="https://evil.com/submit"></form></div>', REPLACING, "<div><a>Link</a><form></form></div>"),
    "domain swapped": ('<a href="https://www.evil.com/p?q">x</a>', KEEPING, '<a href="https://safe.com/p?q">x</a>'),
    "comment and text": ("a < b <!-- <b onclick=1> --> & <p>é</p>", P, "a < b <!-- <b onclick=1> --> & <p>é</p>"),
    "empty": ("", P, ""),
    "null": (None, P, None),
    "error ends": ('<a href="https://evil.com">x</a><button onclick="1">', P, None),
    "entity": ('<!ENTITY a "b>c"><p>', REPLACING, '!c"><p>'),
    "style": ("<style>a{background:url('https://trusted.com/btn.png')}</style>", P, '<style>a{background:url("sub_006621e470212fda.png")}</style>'),
}


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    by_policy = {}
    for name, (html, policy, _) in CASES.items():
        by_policy.setdefault(policy, []).append((name, html))
    for policy, rows in by_policy.items():
        got = sanitize_html(spark.createDataFrame(rows, "page_id string, html string"), policy)
        out |= {r["page_id"]: r["output"] for r in got.output.collect()}
    return out


@pytest.mark.parametrize("name", CASES)
def test_rewrite(results, name):
    assert results[name] == CASES[name][2]


def test_actions_in_order_up_to_the_first_error(spark):
    rows = [(1, '<p onclick="a"><a href="javascript:x">é</a><script src="https://x.org/a.js"></script><b onload=1>'), (2, "<p>"), (3, '<base href="https://evil.com/d/"><a href="x">y</a>')]
    got = sanitize_html(spark.createDataFrame(rows, "page_id long, html string"), P)
    assert [(r.page_id, r.seq, r.level, r.type, r.original, r.loc_start) for r in got.actions.orderBy("page_id", "seq").collect()] == [
        (1, 1, "info", "event_handlers", "a", 3),
        (1, 2, "info", "dangerous_uris", "javascript:x", 18),
        (1, 3, "error", "dangerous_scripts", "x.org", 52),
        (3, 1, "error", "dangerous_domains", "x", 36),
    ]


def test_subresources(spark):
    rows = [(1, '<base href="/s/"><img src="a.png"><style>@import "c.css";</style><link rel=stylesheet href=t.css><link rel=icon href=i.ico>')]
    got = sanitize_html(spark.createDataFrame(rows, "page_id long, html string"), P)
    assert [(r.seq, r.url) for r in got.subresources.orderBy("seq").collect()] == [(1, "https://localhost/s/a.png"), (2, "https://localhost/s/c.css"), (3, "https://localhost/s/t.css")]


def test_bases_follow_each_other_and_begin_after_their_element(spark):
    rows = [(1, '<img src="0.png"><base href="/a/"><!-- <base href="/no/"> --><base><base href="b/"><img src="1.png"><base href="javascript:x"><p title="<base href=/no/>"><img src="2.png">')]
    got = sanitize_html(spark.createDataFrame(rows, "page_id long, html string"), P)
    assert [r.url for r in got.subresources.orderBy("seq").collect()] == ["https://localhost/0.png", "https://localhost/a/b/1.png", "https://localhost/a/b/2.png"]


def test_odd_markup_stays_as_it_is(spark):
    texts = ["<", "a <b", '<p "x>y</p><q>', "<!-- never ends <p onclick=1>", "<a<b onclick=1>", "<p><!doctype x><br/><p/>", "x</p onclick=1>", "<title><p onclick=1></title>", "<p x='>'>a</p>" * 3, "<script>var a = '<p onclick=1>'</script><STYLE>p{}</STYLE >", "é<p>€</p>"]
    got = sanitize_html(spark.createDataFrame(list(enumerate(texts)), "page_id long, html string"), P).output.collect()
    assert {r.page_id: r.output for r in got} == {**dict(enumerate(texts)), 4: "<a<b>"}


def test_sanitizer_keeps_two_python_workers_a_task(spark):
    docs = spark.createDataFrame([(1, '<base href="/s/"><img src="a.png"><script>eval(1)</script><style>p{}</style>')], "page_id long, html string")
    plan = sanitize_rows(docs, KEEPING)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\w*EvalPython \[", plan)) == 2


@pytest.mark.parametrize("rule", [P.dangerous_uris, KEEP, ReplaceRule("info", "")])
def test_bases_are_judged_as_other_addresses(spark, rule):
    hrefs = ["javascript:x", "JAVA\tSCRIPT:x", "javaſcript:x", " data:x", "\x1f\ndata:x", "xdata:x", "data", "/d/", ""]
    docs = spark.createDataFrame([(i, f'<base class=x href="{h}" href="/no/">', h) for i, h in enumerate(hrefs)] + [(99, None, None), (100, "<p>", None)], "page_id long, html string, href string")
    now = F.when(is_dangerous_uri(F.col("href")), replaced(rule, F.col("href"))).otherwise(F.col("href"))
    got = docs.select("*", tags_and_bases(rule)(F.col("html"), F.lit("https://h/a/")).alias("t"), now.alias("now")).collect()
    assert {r.page_id: r.t.bases for r in got if r.page_id > 98} == {99: None, 100: None}
    want = {r.page_id: (parse_url(r.now, "https://h/a/") or ["https://h/a/"])[0] for r in got if r.page_id < 99}
    assert {r.page_id: r.t.bases for r in got if r.page_id < 99} == {i: [u] for i, u in want.items()}


def test_memory_of_reading_tags_stays_as_documents_add_up():
    docs = pa.array(["<p>a b</p><a href='/x'>l</a>" * 2000] * 160)
    tracemalloc.start()
    list_tags(docs, frozenset(["base"]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 << 20

import pytest
from pyspark.sql import functions as F

from cleanlake.functions import hosts, urls
from cleanlake.operators import resources as R
from cleanlake.operators.policy import Policy, ReplaceRule


def one(spark, value, kind, *exprs):
    return spark.createDataFrame([(value,)], f"x {kind}").select(*exprs).first()[0]


@pytest.mark.parametrize("script, bad", [("console.log(1)", False), ("eval(x)", True), ("document.write(1)", True), ("eval    (1)", True), ("document   . write ()", True), ("let evaluator = 1;", False), ("myalert(1)", True)])
def test_scripts(spark, script, bad):
    assert one(spark, script, "string", R.is_dangerous_js(F.col("x"))) is bad


@pytest.mark.parametrize("data, bad", [(b"%PDF /Type /Page", False), (b"/JS (x)", True), (b"/OpenAction", True), (b"x\nstream /JS endstream", False), (b"/JSdata", False), (b"randomstream/JS", True), (b"a stream /JS ", False), (b"\xff/AA\x00", True)])
def test_pdfs(spark, data, bad):
    assert one(spark, data, "binary", R.has_active_pdf(F.col("x"))) is bad


@pytest.mark.parametrize(
    "text, left",
    [("a<!ENTITY x 'y'>b", "ab"), ("<!entity lol 'l'>", ""), ("<!DOCTYPE html>", "<!DOCTYPE html>"), ("<!<!ENTITY>x", "<!x"), (r"<!ENTITY \> y>z", "z"), ("<!ENTITY never ends", "<!ENTITY never ends"), (None, None)],
)
def test_entities(spark, text, left):
    assert one(spark, text, "string", R.without_entities(F.col("x"), ReplaceRule("warn", ""))) == left


@pytest.mark.parametrize("data, kind", [("89504E470D0A1A0A", "image/png"), ("FFD8FFE0", "image/jpeg"), ("474946383961", "image/gif"), ("255044462D312E34", "application/pdf"), ("524946460000000057454250", "image/webp"), ("626F6479", None)])
def test_sniffing(spark, data, kind):
    assert one(spark, bytes.fromhex(data), "binary", R.mime_sniff(F.col("x"))) == kind


def test_mime_rules(spark):
    rows = [("image/png", "image/png", False), ("image/JPG; q=1", "image/jpeg", False), ("image/png", "image/jpeg", True), ("image/png", None, True), ("text/plain", "image/png", False), (None, "image/png", False)]
    got = spark.createDataFrame(rows, "d string, a string, bad boolean").select(R.mime_mismatch(F.col("d"), F.col("a")), "bad").collect()
    assert all(bool(a) == b for a, b in got)
    assert one(spark, "https://h/a.b/c.jpg?x=.png", "string", R.mime_by_extension(F.col("x"))) == "image/jpeg"
    assert one(spark, "https://h/a.svg#x", "string", R.is_markup(F.lit(None).cast("string"), F.col("x"))) is True


def test_images(spark):
    jpeg, png = bytes.fromhex("ffd8ffe1000600000000ffd9"), bytes.fromhex("89504e470d0a1a0a")
    text = (4).to_bytes(4, "big") + b"tEXtdata" + bytes(4)
    data = (4).to_bytes(4, "big") + b"IDATdata" + bytes(4)
    cases = [(R.strip_jpeg, jpeg, bytes.fromhex("ffd8ffd9")), (R.strip_jpeg, b"no", b"no"), (R.strip_png, png + text, png), (R.strip_png, png + text + data + text, png + data), (R.strip_png, png + data[:10], png + data[:10]), (R.strip_png, b"", b"")]
    for f, given, want in cases:
        assert bytes(one(spark, given, "binary", f(F.col("x")))) == want


def test_style_sheets(spark):
    policy = Policy()
    run = lambda css, base: spark.createDataFrame([(css, base)], "c string, b string").select(R.sanitize_css_udf(policy)("c", "b").alias("r")).first().r
    got = run("body { background: url('img.png'); } @import 'common.css';", "https://example.com/dir/style.css")
    assert [s.url for s in got.subresources] == ["https://example.com/dir/img.png", "https://example.com/dir/common.css"]
    assert got.output.startswith('body { background: url("sub_') and '@import "sub_' in got.output and got.output.endswith('.css";')
    got = run("a{b:url('data:image/png;base64,1')} c{d:url('javascript:alert(1)')}", "https://example.com/s.css")
    assert got.output == 'a{b:url("#")} c{d:url("#")}' and not got.subresources and [a.type for a in got.actions] == ["dangerous_uris"] * 2
    assert run("@import 'x' screen;", "https://e.com/").output == "@import 'x' screen;"


@pytest.mark.parametrize("ip, safe", [(x, False) for x in "127.0.0.1 10.0.0.1 172.16.0.1 192.168.1.1 169.254.1.1 224.0.0.1 255.255.255.255 0.0.0.0 100.64.0.1 192.0.2.1 198.51.100.1 240.0.0.1 ::1 fc00::1 fe80::1 ::ffff:10.0.0.1".split()] + [(x, True) for x in "8.8.8.8 1.1.1.1 100.63.255.255 100.128.0.0 172.32.0.1 2001:4860:4860::8888".split()])
def test_addresses(spark, ip, safe):
    assert one(spark, ip, "string", hosts.is_safe_ip(F.col("x"))) is safe
    if ":" not in ip:
        assert one(spark, ip, "string", hosts.is_safe_v4(hosts.ip_number(F.col("x")))) is safe


@pytest.mark.parametrize("host, target, match", [("www.wikipedia.org", "wikipedia.org", True), ("www.wikipedia.org", "org", True), ("www.wikipedia.org", ".org", False), ("google.com", "youtube.com", False), ("a.b", "a.b", True)])
def test_hosts(spark, host, target, match):
    df = spark.createDataFrame([(host, target)], "h string, t string")
    assert df.select(hosts.host_matches(F.col("h"), F.col("t"))).first()[0] is match
    assert (hosts.listed_hosts(df, "h", df.select("t"), "t").count() == 1) is match
    assert (hosts.listed_hosts(df, "h", df.select("t"), "t", "left_anti").count() == 0) is match


@pytest.mark.parametrize("url, name", [("https://trusted.com/song.mp3", "sub_bae1797ac4ee235d.mp3"), ("https://trusted.com/app.swf", "sub_217fd05b2d3da13b.swf"), ("https://trusted.com/btn.png", "sub_006621e470212fda.png")])
def test_local_names(spark, url, name):
    assert one(spark, url, "string", hosts.local_name(F.col("x"), F.lit("bin"))) == name


def test_urls():
    p = urls.parse_url
    assert p("http://googlé.com", "https://h/")[:4] == ("http://xn--googl-fsa.com/", "http", "xn--googl-fsa.com", "googlé.com")
    assert p("../c?d#e", "https://h/a/b/x")[0] == "https://h/a/c?d#e" and p("//o.org/x", "https://h/")[2] == "o.org"
    assert p("рф", "https://h/a")[0].startswith("https://h/") and p("https://", "https://h/") is None
    for text, want in (("https://0x7f.1/", "127.0.0.1"), ("https://2130706433/", "127.0.0.1"), ("https://0300.0250.1/", "192.168.0.1"), ("https://1.2.3.4./", "1.2.3.4"), ("https://1.2.3.256/", None), ("https://1.2.3.4.5/", None), ("https://0x/", "0.0.0.0")):
        got = p(text, "https://h/")
        assert got is None if want is None else got[2:5:2] == (want, "ipv4")
    assert p("https://h/a/%2E%2e/b/./c/..", "https://h/")[0] == "https://h/b/" and p("https://h/../..", "https://h/")[0] == "https://h/"
    assert p("https://10.0.0.1/x", "https://h/")[4] == "ipv4" and p("mailto:x@y", "https://h/")[2] is None

"""Pages and resources from captured responses, and a whole run of the command line's work."""

import json

from pyspark.sql import functions as F

from cleanlake import cli
from cleanlake.operators import crawl, remote, report
from cleanlake.operators.policy import LimitRule, Policy
from cleanlake.sources import files

RESPONSES = "url string, status_code int, content_type string, data binary"
PAGE = b'<p onclick="x"><link rel=stylesheet href="s.css"><img src="/i.png"><a href="q">q</a>'
ANSWERS = [
    ("https://h.org/d/p.html", 200, "text/html; charset=utf-8", PAGE),
    ("https://h.org/json", 200, "application/json", b"{}"),
    ("https://h.org/gone", 404, "text/html", b"x"),
    ("https://h.org/big", 200, None, b"x" * 500),
    ("https://h.org/bad", 200, None, b'<a href="https://evil.com/">x</a>'),
    ("https://h.org/d/s.css", 200, "text/css", b"a{background:url(/i.png)} @import 'deep.css';"),
    ("https://h.org/i.png", 200, "image/png", bytes.fromhex("89504e470d0a1a0a")),
    ("https://h.org/d/deep.css", 200, "text/css", b"b{}"),
]


def test_pages(spark):
    urls = ["https://h.org/d/p.html", "https://h.org/json", "https://h.org/gone", "https://h.org/big", "https://h.org/bad", "http://h.org/", "https://www.evil.com/", "https://none.org/", "https://bücher.example/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "source_idx long, url string")
    responses = spark.createDataFrame([*ANSWERS, ("https://bücher.example/", 200, None, b"<p>")], RESPONSES)
    got = remote.sanitize_pages(frame, responses, Policy(max_bytes=LimitRule(400)))
    status = {r.source_idx: r.status for r in got.output.collect()}
    assert [status[i] for i in range(9)] == ["sanitized", "mismatched_mime", "failed", "max_bytes", "blocked", "non_https", "dangerous_connection", "failed", "sanitized"]
    out = {r.source_idx: r.output for r in got.output.collect()}
    assert bytes(out[0]).startswith(b'<p><link rel=stylesheet href="sub_') and out[4] is None
    assert [(r.source_idx, r.url) for r in got.subresources.orderBy("source_idx", "seq").collect()] == [(0, "https://h.org/d/s.css"), (0, "https://h.org/i.png")]
    told = {(r.source_idx, r.seq, r.type, r.level) for r in got.actions.collect()}
    assert {(8, 1, "idn_connection", "warn"), (6, 1, "dangerous_connection", "error"), (4, 1, "dangerous_domains", "error"), (0, 1, "event_handlers", "info")} <= told
    strict = remote.sanitize_pages(frame, responses, Policy(idn_connection="error", dangerous_connection="warn"))
    assert {r.source_idx: r.status for r in strict.output.where("source_idx in (6, 8)").collect()} == {6: "failed", 8: "idn_connection"}


def test_levels_redirects_and_addresses_of_a_crawl(spark):
    seeds = spark.createDataFrame([(0, i, f"https://{h}/x.gif", "l") for i, h in enumerate(("a.org", "b.org", "c.org", "evil.com", "xn--bcher-kva.example", "bücher.example"))], "source_idx long, seq long, url string, local_name string")
    responses = spark.createDataFrame([(r.url, 200, "image/gif", b"GIF89a") for r in seeds.collect()], RESPONSES)
    hops = spark.createDataFrame([(1, 0, "https://b.org/x.gif"), (1, 1, "https://x.evil.com/"), (2, 0, "https://c.org/x.gif"), (2, 1, "https://d.org/")], "chain long, hop_no long, url string")
    dns = spark.createDataFrame([(h, "8.8.8.8") for h in ("b.org", "c.org", "evil.com", "xn--bcher-kva.example")] + [("a.org", "10.0.0.1")], "host string, ip string")
    policy = Policy(max_subresources=LimitRule(9))
    run = lambda p: {r.seq[0]: (r.status, [v.type for v in r.violations]) for r in crawl.crawl(seeds, responses, p, hops, dns).collect()}
    assert run(policy) == {0: ("unsafe_address", ["unsafe_address"]), 1: ("dangerous_connection", ["dangerous_connection"]), 2: ("fetched", []), 3: ("dangerous_connection", ["dangerous_connection"]), 4: ("fetched", []), 5: ("fetched", ["idn_connection"])}
    lax = run(policy.with_(dangerous_connection="warn", idn_connection="error"))
    assert lax[1] == ("fetched", ["dangerous_connection"]) and lax[3] == ("fetched", ["dangerous_connection"]) and lax[5] == ("idn_connection", ["idn_connection"])
    owners = crawl.redirect_owners(hops, seeds.select("url", "source_idx"))
    assert sorted((r.chain, r.source_idx) for r in owners.collect()) == [(1, 0), (2, 0)]


def test_markup_resources_lose_entities_before_they_are_judged(spark):
    rows = spark.createDataFrame([("https://h/a.svg", "image/svg+xml", '<svg><!ENTITY a "é">é</svg>'.encode()), ("https://h/b.png", None, bytes.fromhex("89504e470d0a1a0a") + b"<!ENTITY x>")], "url string, content_type string, data binary")
    from cleanlake.operators.policy import ReplaceRule

    got = {r.url: r for r in crawl.sanitize_responses(rows, Policy(xml_entities=ReplaceRule("warn", "€"), unknown_resource="warn")).collect()}
    svg = got["https://h/a.svg"]
    assert [v.type for v in svg.violations] == ["xml_entities", "unknown_resource"] and bytes(svg.output).decode() == "<svg>€é</svg>"
    assert got["https://h/b.png"].violations == []
    assert [(v.type, v.level) for v in crawl.sanitize_responses(rows.limit(1), Policy()).first().violations] == [("xml_entities", "error")]


def test_a_whole_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text('<base href="https://h.org/d/"><img src="/i.png"><script>eval(1)</script>')
    (tmp_path / "in" / "b.css").write_text('a{b:url("https://h.org/i.png")}')
    out = str(tmp_path / "out")
    responses = spark.createDataFrame(ANSWERS, RESPONSES)
    actions, names, missing = cli.run(spark, [str(tmp_path / "in"), "https://h.org/d/p.html", str(tmp_path / "no")], Policy(), out, responses)
    assert missing == [str(tmp_path / "no")] and report.any_error(actions).first().failed
    docs = {(r.source_idx, r.kind): bytes(r.output) for r in spark.read.parquet(f"{out}/documents").collect()}
    assert sorted(k for _, k in docs) == ["css", "html"] and min(i for i, _ in docs) == -1
    kept = {r.url: r.local_name for r in spark.read.parquet(f"{out}/resources").collect()}
    assert set(kept) == {"https://h.org/d/s.css", "https://h.org/i.png"} and all(kept["https://h.org/d/s.css"].encode() not in d or i == -1 for (i, _), d in docs.items())
    told = files.read_reports(spark, f"{out}/reports").collect()
    by_name = {r.input.rpartition("/")[2]: [a.type for a in r.actions] for r in told}
    assert {k: by_name[k] for k in ("a.html", "b.css", "p.html")} == {"a.html": ["dangerous_js"], "b.css": [], "p.html": ["event_handlers"]}
    assert {r.url for r in spark.read.parquet(f"{out}/resources").collect()} <= {r.input for r in told}  # resources that broke nothing too
    assert all(r.start is not None and r.end >= r.start for r in told)
    assert "[ERROR] dangerous_js" in "".join(r.value for r in spark.read.text(f"{out}/log").collect())
    files.write_files(spark.read.parquet(f"{out}/resources"), f"{tmp_path}/tree", "local_name", "output")
    assert {p.name for p in (tmp_path / "tree").iterdir()} == set(kept.values())


def test_evaluation_is_read_as_written(spark, tmp_path):
    expected = spark.createDataFrame([("a", ["x"]), ("b", [])], "file string, expected_rules array<string>")
    rules = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "file string, actual_rules array<string>")
    verdict = report.verdicts(expected, rules, "file")
    runs = spark.createDataFrame([("10KB", 10240, False, 0.5)] * 2, "size_name string, size_bytes long, fetch_subresources boolean, seconds double")
    speed = report.speedup(spark.createDataFrame([("small", 1, 2.0), ("small", 4, 1.0)], "workload string, threads int, seconds double"))
    files.write_evaluation(verdict, report.rates(verdict), report.latency(runs).withColumn("size_bytes", F.lit(10240)).withColumn("fetch_subresources", F.lit(False)), speed, f"{tmp_path}/evaluation")
    got = files.read_evaluation(spark, f"{tmp_path}/evaluation").first()
    assert [(c.file, c.match_status, c.actual_verdict) for c in got.correctness] == [("a", "TP", "unsafe"), ("b", "FP", "unsafe")]
    assert got.correctness_summary["tp"] == 1 and got.performance[0].avg_latency_ms == 500 and [s.speedup for s in got.scalability] == [1.0, 2.0]
    one = next(p for p in (tmp_path / "evaluation").iterdir() if p.suffix == ".json")
    assert json.loads(one.read_text())["correctness_summary"]["fp"] == 1

import random

import pytest

from cleanlake.operators import crawl, remote, report
from cleanlake.operators.policy import LimitRule, Policy


def test_crawl_follows_style_sheets_within_depth_and_budget(spark):
    seeds = spark.createDataFrame([(0, 1, "https://h.org/a.css", "a.css"), (0, 2, "http://h.org/p.png", "p"), (0, 3, "https://evil.com/x.js", "x"), (0, 4, "https://10.0.0.1/x.js", "y"), (1, 1, "https://h.org/a.css", "a.css"), (1, 2, "https://h.org/none", "n")], "source_idx long, seq long, url string, local_name string")
    responses = spark.createDataFrame([("https://h.org/a.css", 200, "text/css", b"@import 'b.css';"), ("https://h.org/b.css", 200, "text/css", b"a{}"), ("https://evil.com/x.js", 200, None, b"1")], "url string, status_code int, content_type string, data binary")
    got = {(r.source_idx, r.url): r for r in crawl.crawl(seeds, responses, Policy(max_resource_depth=LimitRule(2))).collect()}
    assert {k: v.status for k, v in got.items()} == {(0, "https://h.org/a.css"): "fetched", (0, "http://h.org/p.png"): "non_https", (0, "https://evil.com/x.js"): "dangerous_connection", (0, "https://10.0.0.1/x.js"): "unsafe_address", (1, "https://h.org/none"): "failed", (0, "https://h.org/b.css"): "fetched"}
    assert got[0, "https://h.org/b.css"].depth == 2 and bytes(got[0, "https://h.org/b.css"].output) == b"a{}"
    assert len(crawl.crawl(seeds, responses, Policy()).collect()) == 5


def test_budgets(spark):
    found = spark.createDataFrame([(0, i, f"https://h/{i}") for i in range(8)] + [(1, 0, "https://h/0"), (1, 1, "https://h/seen")], "source_idx long, seq long, url string")
    queued = crawl.enqueue(found, spark.createDataFrame([("https://h/seen",)], "url string"), Policy())
    assert sorted((r.seq, r.status) for r in queued.collect()) == [(i, "fetch" if i < 5 else "over_budget") for i in range(8)]
    assert [tuple(r) for r in crawl.budget_actions(queued, Policy()).collect()] == [(0, "max_subresources", 5)]
    assert {r.status for r in crawl.enqueue(found, found.select("url").limit(0), Policy(), 2).collect()} == {"too_deep", "over_budget"}


def test_urls_over_budget_go_to_the_next_source(spark):
    found = [(0, i, f"https://h/{i}") for i in range(12)] + [(s, i, f"https://h/{i}") for s in (1, 2) for i in range(12)]
    queued = crawl.enqueue(spark.createDataFrame(found, "source_idx long, seq long, url string"), spark.createDataFrame([], "url string"), Policy())
    got = {(r.source_idx, r.seq): (r.nth, r.status) for r in queued.collect()}
    want = {(0, i): (i + 1, "fetch" if i < 5 else "over_budget") for i in range(12)}
    want |= {(1, i): (i - 4, "fetch" if i < 10 else "over_budget") for i in range(5, 12)} | {(2, i): (i - 9, "fetch") for i in (10, 11)}
    assert got == want


def test_budgets_run_over_all_depths(spark):
    seeds = spark.createDataFrame([(0, i, f"https://h.org/{i}.css", "a") for i in range(4)] + [(1, 0, "https://h.org/z.css", "z")], "source_idx long, seq long, url string, local_name string")
    css = "@import 'b.css'; @import 'c.css';"
    rows = [("https://h.org/0.css", css), *((f"https://h.org/{i}.css", "a{}") for i in (1, 2, 3, "b", "c")), ("https://h.org/z.css", "@import 'c.css';")]
    responses = spark.createDataFrame([(u, 200, "text/css", d.encode()) for u, d in rows], "url string, status_code int, content_type string, data binary")
    got = {(r.source_idx, r.url[14:], r.depth): r.status for r in crawl.crawl(seeds, responses, Policy(max_resource_depth=LimitRule(2))).collect()}
    assert got == {**{(0, f"{i}.css", 1): "fetched" for i in range(4)}, (1, "z.css", 1): "fetched", (0, "b.css", 2): "fetched", (0, "c.css", 2): "over_budget", (1, "c.css", 2): "fetched"}
    size = len(css) + 9
    got = crawl.crawl(seeds, responses, Policy(max_resource_depth=LimitRule(2), max_bytes=LimitRule(size, "error"))).where("depth = 2").collect()
    assert {(r.source_idx, r.url[14:]): r.status for r in got} == {(0, "b.css"): "max_bytes", (0, "c.css"): "over_budget", (1, "c.css"): "fetched"}


def test_resources_by_type(spark):
    rows = [("https://h/a.js", None, b"eval(1)"), ("https://h/b.js", None, b"let a"), ("https://h/c.pdf", None, b"%PDF /JS "), ("https://h/d.png", "image/png", b"\xff\xd8\xff\xd9"), ("https://h/e", None, b"?"), ("https://h/f.gif", "image/gif", b"GIF89a")]
    got = crawl.sanitize_responses(spark.createDataFrame(rows, "url string, content_type string, data binary"), Policy()).collect()
    got = {r.url: (r.violation and r.violation.type, r.output and bytes(r.output)) for r in got}
    assert got == {"https://h/a.js": ("dangerous_js", None), "https://h/b.js": (None, b"let a"), "https://h/c.pdf": ("pdf_active_content", None), "https://h/d.png": ("mismatched_mime", None), "https://h/e": ("unknown_resource", None), "https://h/f.gif": (None, b"GIF89a")}


def test_redirects(spark):
    hops = [(1, 0, "https://a/"), (1, 1, "https://b/"), (1, 2, "https://c/"), (1, 3, "https://d/"), (2, 0, "https://a/"), (2, 1, "https://x.evil.com/"), (3, 0, "https://evil.com/"), (3, 1, "https://a/")]
    got = crawl.redirect_failures(spark.createDataFrame(hops, "chain long, hop_no long, url string"), Policy())
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, "max_redirects"), (2, 1, "dangerous_connection")]


def test_verdicts_rates_and_reports(spark):
    expected = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", []), ("d", None), ("e", ["z"])], "file string, expected_rules array<string>")
    actions = spark.createDataFrame([(f, i, level, t, "o" * n, None, 0, 1) for i, (f, level, t, n) in enumerate([("a", "info", "x", 1), ("a", "warn", "w", 200), ("b", "error", "x", 1), ("d", "info", "q", 1)])], "file string, seq int, level string, type string, original string, replacement string, loc_start long, loc_end long")
    v = report.verdicts(expected, report.rules_of(actions, "file"), "file")
    assert {r.file: r.match_status for r in v.collect()} == {"a": "TP", "b": "FN", "c": "TN", "d": "FP", "e": "FN"}
    assert tuple(report.rates(v).first()) == (1, 1, 1, 2, 1 / 3, 0.5)
    assert tuple(report.rates(v.limit(0)).first()) == (0, 0, 0, 0, 0.0, 0.0)
    assert report.any_error(actions).first().failed and not report.any_error(actions.limit(0)).first().failed
    packed = {r.file: len(r.actions) for r in report.reports(actions, expected.select("file"), "file").collect()}
    assert packed == {"a": 2, "b": 1, "c": 0, "d": 1, "e": 0}
    lines = [r.line for r in report.log_lines(actions, "file", "warn").orderBy("seq").collect()]
    assert lines[0].endswith("...") and lines[1] == "[ERROR] x: o" and len(lines) == 2


def in_turn(found, visited, budget, carried):
    """Sources one after the other: what each asks for in vain, and what it gets."""
    visited, out, counts = set(visited), [], dict(carried)
    for source in sorted({s for s, _, _ in found}):
        once = {}
        for _, seq, url in sorted(x for x in found if x[0] == source):
            once.setdefault(url, seq)
        for url, _ in sorted(once.items(), key=lambda x: (x[1], x[0])):
            if url not in visited:
                counts[source] = counts.get(source, 0) + 1
                ok = counts[source] <= budget
                out.append((source, url, counts[source], "fetch" if ok else "over_budget"))
                if ok:
                    visited.add(url)
    return out


@pytest.mark.parametrize("settled", [1, 7, 1 << 20])
def test_claims_are_those_of_sources_in_turn(spark, settled):
    rnd = random.Random(settled)
    for n, urls, budget in ((12, 9, 2), (15, 40, 3), (6, 6, 5)):
        found = [(rnd.randrange(n), k, f"u{rnd.randrange(urls)}") for k in range(5 * n)]
        carried = {s: rnd.randrange(budget + 2) for s in range(0, n, 3)}
        frame = spark.createDataFrame(found, "source_idx long, seq long, url string")
        seen = spark.createDataFrame([("u0",), ("u0",)], "url string")
        before = spark.createDataFrame(list(carried.items()), "source_idx long, requests int")
        got = crawl.enqueue(frame, seen, Policy(max_subresources=LimitRule(budget)), carried=before, settled=settled).collect()
        assert sorted((r.source_idx, r.url, r.nth, r.status) for r in got) == sorted(in_turn(found, ["u0"], budget, carried))


def test_chains_of_sources_need_no_round_each(spark):
    """Every source names one URL more than it may have, and the last of them is the first of the next source."""
    n = 2000
    found = [(s, k, f"u{5 * s + k}") for s in range(n) for k in range(6)]
    jobs = lambda: spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setJobGroup("chain", "chain")
    queued = crawl.enqueue(spark.createDataFrame(found, "source_idx long, seq long, url string"), spark.createDataFrame([], "url string"), Policy())
    assert len(jobs()) < 80  # also those of adaptive stages
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = queued.groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"fetch": 5 * n, "over_budget": n}


def test_one_response_of_a_url_counts_and_inputs_are_not_fetched_again(spark):
    url = "https://h.org/a.css"
    responses = spark.createDataFrame([(url, 200, "text/css", b"b{}"), (url, 200, "text/css", b"a{}"), (url, 500, "text/css", b"0"), ("https://h.org/p", 200, "text/css", b"c{}")], "url string, status_code int, content_type string, data binary")
    named = spark.createDataFrame([(0, 1, url, "a"), (0, 2, "https://h.org/p", "p")], "source_idx long, seq long, url string, local_name string")
    got = remote.fetch_subresources(named, responses, Policy(), inputs=spark.createDataFrame([("https://H.org/./p",)], "url string")).collect()
    assert [(r.url, r.status, bytes(r.output)) for r in got] == [(url, "fetched", b"a{}")]

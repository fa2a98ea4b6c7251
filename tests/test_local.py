"""Fourteen small files like those of the published evaluation, and the verdicts that follow from the rules."""

import pytest

from cleanlake import cli
from cleanlake.operators import crawl, report
from cleanlake.operators.local import sanitize_files
from cleanlake.operators.policy import Policy

#: name, kind, content, expected rules
FILES = [
    ("safe", "html", "<html><body><a href='https://trusted.com/'>ok</a></body></html>", []),
    ("external", "html", '<link rel="stylesheet" href="/s.css"><img src="i.png"><script src="app.js"></script>', []),
    ("clean", "pdf", "%PDF-1.4 << /Type /Catalog >>", []),
    ("xss", "html", '<button onclick="a()">x</button><script>alert(1)</script>', ["event_handlers", "dangerous_scripts"]),
    ("bomb", "html", '<!DOCTYPE x [<!ENTITY lol "lol">]><p>&lol;</p>', ["xml_entities"]),
    ("script", "js", 'let code = "alert(1)"; eval(code);', ["dangerous_js"]),
    ("styles", "css", "a { background: url(\"javascript:alert('x')\"); }", ["dangerous_css"]),
    ("origins", "html", '<iframe src="https://evil.com/a"></iframe><object data="https://attacker.org/b"></object>', ["dangerous_domains", "dangerous_origins"]),
    ("ssrf", "html", '<img src="http://127.0.0.1/a"><script src="http://192.168.1.1/b"></script>', ["dangerous_scripts"]),
    ("active", "pdf", "%PDF-1.4 << /OpenAction 5 0 R >> /JS (x)", ["pdf_active_content"]),
    ("idn", "html", '<a href="http://googlé.com">x</a>', ["idn"]),
    ("confusion", "html", '<a href="https://trusted​.com/x">x</a>', ["idn"]),
    ("broad", "html", '<form action="https://evil.com/a"></form><video src="https://evil.com/b"></video>', ["dangerous_domains"]),
    ("urls", "html", '<a href="https://malicious-domain.com">x</a><a href="http://googlé.com">y</a>', ["dangerous_domains", "idn"]),
]


@pytest.fixture(scope="module")
def done(spark):
    rows = [(name, kind, text.encode()) for name, kind, text, _ in FILES] + [("null", "html", None), ("broken", "css", b"a\xff{}")]
    got = sanitize_files(spark.createDataFrame(rows, "source_idx string, kind string, data binary"), Policy())
    return {r.source_idx: r.output and bytes(r.output) for r in got.output.collect()}, got.actions.cache()


def test_verdicts(spark, done):
    expected = spark.createDataFrame([(n, e) for n, _, _, e in FILES], "source_idx string, expected_rules array<string>")
    verdict = report.verdicts(expected, report.rules_of(done[1], "source_idx"), "source_idx")
    status = {r.source_idx: r.match_status for r in verdict.collect()}
    assert {k for k, v in status.items() if v == "FN"} == {"xss", "styles", "origins", "urls"}
    assert {k for k, v in status.items() if v == "FP"} == {"external"}
    rates = report.rates(verdict).first()
    assert (rates.tp, rates.fn, rates.fp, rates.tn) == (7, 4, 1, 2)
    assert "| detection_rate | 63.64 % |" in report.summary(rates)


def test_outputs(done):
    out = done[0]
    assert out["clean"] and out["safe"] and out["styles"] == b'a { background: url("#"); }' and out["broken"] == "a�{}".encode()
    assert [k for k in ("external", "bomb", "script", "origins", "active", "urls", "null") if out[k] is not None] == []


def test_safe_addresses(spark):
    dns = spark.createDataFrame([("a", "10.0.0.1"), ("a", "8.8.8.8"), ("b", "::1"), ("c", "no address")], "host string, ip string")
    assert [tuple(r) for r in crawl.safe_addresses(dns).collect()] == [("a", "8.8.8.8")]


def test_command_line(capsys):
    assert cli.main(["-g"]) == 0 and "[connections]" in capsys.readouterr().out
    args = cli.arguments(["a", "b", "-vv", "-w", "2"])
    assert (args.inputs, args.verbose, args.workers, args.output) == (["a", "b"], 2, 2, "output")

"""Chunked bodies: any cut gives the bytes of the whole."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cleanlake.operators import resources
from cleanlake.operators.html import sanitize_html
from cleanlake.operators.local import sanitize_files
from cleanlake.operators.policy import LimitRule, Policy, ReplaceRule
from cleanlake.streaming.chunks import EntityFilter, filter_chunks, filter_stream, within_budget
from cleanlake.streaming.feed import run_once

PARTS = [b"<!ENTITY", b"<!entity x ", b"<", b"<!", b"<!EN", b">", b"\\", b"\\>", b"\\\\", b'"y"', b"text", b"\xc3\xa9", b"<!ENTITY a>", b"\n"]


def whole(data, new):
    return re.sub(resources.ENTITY.encode(), lambda m: m.group() if new is None else new, data)


def cut(rnd, data):
    places = sorted(rnd.randrange(len(data) + 1) for _ in range(rnd.randrange(5)))
    return [data[a:b] for a, b in zip([0, *places], [*places, len(data)], strict=True)]


@pytest.mark.parametrize("new", ["", "<!-- x -->", None])
def test_any_cut_gives_the_whole(new):
    rnd = random.Random(3)
    for _ in range(3000):
        data = b"".join(rnd.choice(PARTS) for _ in range(rnd.randrange(14)))
        own, out, found = EntityFilter(ReplaceRule("warn", new)), b"", []
        chunks = cut(rnd, data)
        for i, c in enumerate(chunks):
            passed, more = own.feed(c, i == len(chunks) - 1)
            out, found = out + passed, found + more
        assert out == whole(data, None if new is None else new.encode()) and own.settled == len(data)
        assert [data[a:b].decode("utf-8", "replace") for _, a, b in found] == [t for t, _, _ in found]
        assert [(a, b) for _, a, b in found] == [m.span() for m in re.finditer(resources.ENTITY.encode(), data)]


def documents():
    rnd = random.Random(8)
    docs = {i: b"".join(rnd.choice(PARTS) for _ in range(rnd.randrange(1, 30))) for i in range(25)}
    return docs, [(i, k, c) for i, d in docs.items() for k, c in enumerate(cut(rnd, d))]


def test_tables_of_chunks(spark):
    docs, rows = documents()
    got = filter_chunks(spark.createDataFrame(rows, "doc_id long, seq long, data binary").repartition(5), ReplaceRule("warn", "!")).collect()
    assert len(got) == len(rows)
    for i, d in docs.items():
        assert b"".join(bytes(r.data) for r in sorted(got, key=lambda r: r.seq) if r.doc_id == i) == whole(d, b"!")
    odd = spark.createDataFrame([(None, 0, b"<!ENT"), (None, 1, None), (None, 2, b"ITY x>y")], "doc_id long, seq long, data binary")
    assert [bytes(r.data) for r in filter_chunks(odd, ReplaceRule("warn", "")).orderBy("seq").collect()] == [b"", b"", b"y"]
    assert filter_chunks(odd.limit(0), ReplaceRule("warn", "")).collect() == []


def test_streamed_chunks_wait_for_those_before(spark, tmp_path):
    docs, rows = documents()
    last = {i: max(k for j, k, _ in rows if j == i) for i in docs}
    random.Random(1).shuffle(rows)
    for b in range(3):
        part = [(i, k, c, k == last[i]) for i, k, c in rows[b::3]]
        spark.createDataFrame(part, "doc_id long, seq long, data binary, last boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, seq long, data binary, last boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run_once(filter_stream(stream, ReplaceRule("warn", "!")), f"{tmp_path}/out", f"{tmp_path}/state", "append").collect()
    assert len(got) == len(rows)
    for i, d in docs.items():
        assert b"".join(bytes(r.data) for r in sorted(got, key=lambda r: r.seq) if r.doc_id == i) == whole(d, b"!")


def test_a_budget_ends_a_body_within_it(spark):
    rows = [(1, 0, b"ab<!ENT"), (1, 1, b"ITY x>cd"), (1, 2, b"e"), (2, 0, b"0123456789abcdef"), (2, 1, b"g"), (3, 0, b"x")]
    filtered = filter_chunks(spark.createDataFrame(rows, "doc_id long, seq long, data binary"), ReplaceRule("warn", ""))
    kept, actions = within_budget(filtered, Policy(max_bytes=LimitRule(12), xml_entities=ReplaceRule("warn", "")))
    assert sorted((r.doc_id, r.seq, bytes(r.data)) for r in kept.collect()) == [(1, 0, b"ab"), (3, 0, b"x")]
    assert sorted((r.doc_id, r.seq, r.type, r.loc_start) for r in actions.collect() if r.type != "max_bytes") == [(1, 1, "xml_entities", 2)]
    assert sorted((r.doc_id, r.seq) for r in actions.collect() if r.type == "max_bytes") == [(1, 1), (2, 0)]
    kept, actions = within_budget(filtered, Policy(max_bytes=LimitRule(12, "warn")))
    assert kept.count() == 6 and actions.where("type = 'max_bytes'").count() == 4


def test_hits_have_places(spark):
    pdf = b"%PDF /AA 1 stream /JS ( endstream /OpenAction<< /JavaScript/JSx /JS("
    text = b"let a = '\xc3\xa9'; eval (1); alert(2)"
    files = spark.createDataFrame([(1, "pdf", pdf), (2, "js", text), (3, "html", b"<p>\xc3\xa9<script>" + text + b"</script>")], "source_idx long, kind string, data binary")
    keep = Policy(pdf_active_content="warn", dangerous_js=ReplaceRule("warn", None))
    got = [(r.source_idx, r.original, r.loc_start, r.loc_end) for r in sanitize_files(files, keep).actions.orderBy("source_idx", "seq").collect()]
    at = lambda word: (pdf.index(word), pdf.index(word) + len(word))
    first, second = text.index(b"eval"), text.index(b"alert")
    assert got == [
        (1, "Additional Action (/AA)", *at(b"/AA")), (1, "OpenAction", *at(b"/OpenAction")), (1, "JavaScript", *at(b"/JavaScript")), (1, "JavaScript (/JS)", len(pdf) - 4, len(pdf) - 1),
        (2, "eval (..)", first, first + 6), (2, "alert(..)", second, second + 6), (3, "eval (..)", first + 13, first + 19), (3, "alert(..)", second + 13, second + 19),
    ]
    strict = sanitize_files(files, Policy()).actions.groupBy("source_idx").count().collect()
    assert {r.source_idx: r["count"] for r in strict} == {1: 1, 2: 1, 3: 1}
    page = spark.createDataFrame([(1, "<script>eval(1);eval(2)</script>")], "page_id long, html string")
    assert sanitize_html(page, Policy(dangerous_js=ReplaceRule("warn", "x"))).actions.select(F.count("*")).first()[0] == 1

import datetime

from cleanlake.operators.policy import Policy
from cleanlake.sources import files
from cleanlake.streaming import feed


def test_documents_and_urls_that_arrive(spark, tmp_path):
    spark.createDataFrame([(1, '<b onclick="x">a</b>'), (2, '<a href="https://evil.com">')], "page_id long, html string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("page_id long, html string").parquet(f"{tmp_path}/in")
    feed.sanitize_stream(stream, Policy(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert {r.page_id: r.output for r in spark.read.parquet(f"{tmp_path}/out/output").collect()} == {1: "<b>a</b>", 2: None}
    assert spark.read.parquet(f"{tmp_path}/out/actions").count() == 2


def test_budgets_and_first_sights(spark, tmp_path):
    t = datetime.datetime(2026, 1, 1)
    spark.createDataFrame([(i % 2, f"u{i % 6}", t) for i in range(12)], "source_idx long, url string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("source_idx long, url string, ts timestamp").parquet(f"{tmp_path}/in")
    for name, df in (("budget", feed.take_budget(stream(), 2)), ("first", feed.first_seen(stream()))):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.source_idx, r.nth) for r in spark.table("budget").collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert sorted(r.url for r in spark.table("first").collect()) == [f"u{i}" for i in range(6)]


def test_files(spark, tmp_path):
    for name, data in (("a.html", b"<b>"), ("d/b.PDF", b"%PDF"), ("d/c.png", b"x")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    found, urls, missing = files.read_inputs(spark, [f"{tmp_path}/in", "https://h/", f"{tmp_path}/none", f"{tmp_path}/in/a.html"])
    assert sorted((r.input.rpartition("/")[2], r.kind) for r in found.collect()) == [("a.html", "html"), ("a.html", "html"), ("b.PDF", "pdf"), ("c.png", "html")]
    assert missing == [f"{tmp_path}/none"] and [r.input.rpartition("/")[2] for r in found.orderBy("source_idx").collect()] == ["a.html", "b.PDF", "c.png", "a.html"]
    assert [r.url for r in urls.collect()] == ["https://h/"]
    (tmp_path / "t.json").write_text('{"a": ["x"], "b": []}')
    assert {r.file: r.expected_rules for r in files.read_ground_truth(spark, f"{tmp_path}/t.json").collect()} == {"a": ["x"], "b": []}
    (tmp_path / "r.json").write_text('[{"input": "a", "actions": [{"type": "idn", "level": "warn"}]}]')
    assert [(r.input, r.actions[0].type) for r in files.read_reports(spark, f"{tmp_path}/r.json").collect()] == [("a", "idn")]

"""Files: their numbers, what is written of those that share a name, and the limits of a policy as conditions."""

from cleanlake.operators.policy import LimitRule
from cleanlake.sources import files


def test_files_are_numbered_without_moving_their_contents(spark, tmp_path):
    for folder, names in (("b", [f"{i:03}.html" for i in range(40)]), ("a", ["x.css", "y.js"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text(n)
    rows = files.read_files(spark, f"{tmp_path}/b", f"{tmp_path}/a", f"{tmp_path}/b")
    got = [(r.source_idx, bytes(r.data).decode(), r.kind) for r in rows.orderBy("source_idx").collect()]
    want = [(p * (1 << 40) + k + 1, n, kind) for p, (names, kind) in enumerate((([f"{i:03}.html" for i in range(40)], None), (["x.css", "y.js"], None), ([f"{i:03}.html" for i in range(40)], None))) for k, n in enumerate(names)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and {g[2] for g in got} == {"html", "css", "js"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "Window" not in plan


def test_one_row_of_a_name_is_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"1"), ("a", b"2"), ("a", b"1"), ("b", b"3"), ("c/d", b"4"), ("e", None)], "n string, d binary")
    for _ in range(2):
        files.write_files(rows, f"{tmp_path}/out", "n", "d")
    written = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    least = min((spark.sql(f"SELECT xxhash64(CAST('{x}' AS BINARY)) AS h").first().h, x) for x in "12")[1]
    assert written == {"a": least.encode(), "b": b"3"}


def test_limits_are_conditions(spark):
    rows = spark.createDataFrame([(4,), (5,), (6,), (None,)], "n long")
    assert [r[0] for r in rows.select(LimitRule(5).exceeded("n")).collect()] == [False, False, True, False]
    assert [r[0] for r in rows.select(LimitRule(5, "warn").ends("n")).collect()] == [False] * 4 and rows.where(LimitRule(5).ends("n")).count() == 1

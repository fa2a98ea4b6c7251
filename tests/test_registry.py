"""The helpers by their SQL names."""

from cleanlake.functions.registry import register


def test_functions_in_sql(spark):
    names = register(spark)
    assert {"is_dangerous_js", "html_tags", "resolve_url"} <= set(names)
    one = lambda sql: spark.sql(f"SELECT {sql} AS x").first().x
    assert one("is_dangerous_js('document . write (1)')") and not one("is_dangerous_js('let evaluator')")
    assert one("is_dangerous_uri(' DATA:x')") and not one("is_dangerous_uri('x')")
    assert one("without_entities('a<!ENTITY x \"y\">b', '')") == "ab"
    assert one("has_active_pdf(CAST('%PDF /JS (x)' AS BINARY))") and not one("has_active_pdf(CAST('%PDF stream /JS endstream' AS BINARY))")
    assert one("host_matches('a.b.c', 'b.c')") and not one("host_matches('ab.c', 'b.c')")
    assert one("resolve_url('../x', 'https://h/a/b/c')").href == "https://h/a/x" and one("is_safe_ip('10.0.0.1')") is False
    assert [(r.tag, r.head) for r in spark.sql("SELECT * FROM html_tags('<p x=1>a</p><!-- <b> --><BR>') ORDER BY pos").collect()] == [("p", "<p x=1>"), ("br", "<BR>")]

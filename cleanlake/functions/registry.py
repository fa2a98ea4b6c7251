"""The helpers under names that SQL can call, and tags of pages as a table function."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import html, resources
from . import hosts
from .markup import START, Scan


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def statements() -> list[str]:
    """CREATE statements of the functions that need no Python."""
    js, entity, active, stream = (_quoted(p) for p in (resources.JS, resources.ENTITY, resources.PDF_ACTIVE, resources.PDF_STREAM))
    uri = _quoted(html.DANGEROUS_URI)
    return [
        f"is_dangerous_js(script STRING) RETURNS BOOLEAN RETURN regexp_like(script, {js})",
        f"is_dangerous_uri(value STRING) RETURNS BOOLEAN RETURN regexp_like(value, {uri})",
        f"without_entities(text STRING, replacement STRING) RETURNS STRING RETURN regexp_replace(text, {entity}, replacement)",
        f"has_active_pdf(data BINARY) RETURNS BOOLEAN RETURN regexp_like(regexp_replace(decode(data, 'ISO-8859-1'), {stream}, ''), {active})",
        "host_matches(host STRING, target STRING) RETURNS BOOLEAN RETURN host = target OR endswith(host, '.' || target)",
    ]


@F.udtf(returnType="pos long, tag string, head string")
class HtmlTags:
    """The start tags of a document in order, names lower-cased, and as they stand."""

    def eval(self, html: str | None):  # noqa: ANN201
        data = (html or "").encode()
        scan = Scan(data, np.array([len(data)]))
        for n, i in enumerate(scan.real[scan.kind[scan.real] == START].tolist()):
            yield n, data[scan.name[0, i] : scan.name[1, i]].decode().lower(), data[scan.at[i] : scan.end[i]].decode()


def register(spark: SparkSession) -> list[str]:
    """Makes the helpers known to spark.sql() in this session; gives their names."""
    names = []
    for s in statements():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {s}")
        names.append(s.partition("(")[0])
    spark.udtf.register("html_tags", HtmlTags)
    names.append("html_tags")
    helpers = {"resolve_url": hosts.resolve_url, "is_safe_ip": hosts.is_safe_ip, "url_hash": hosts.url_hash, "strip_jpeg": resources.strip_jpeg, "strip_png": resources.strip_png}
    for name, f in helpers.items():
        spark.udf.register(name, f)
        names.append(name)
    return names

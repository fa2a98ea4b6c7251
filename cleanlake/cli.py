"""Command line: `python -m cleanlake.cli INPUT... [-p POLICY] [-o OUTPUT] [-r RESPONSES] [--hops HOPS] [--dns DNS] [-w WORKERS] [-v] [-g]`.

Exit status 1 if any action was of level error.
"""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import remote, report
from .operators.crawl import cut
from .operators.local import sanitize_files
from .operators.policy import LEVELS, Policy, dump_default, load_policy
from .sources import files

RESPONSES = "url string, status_code int, content_type string, data binary"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cleanlake")
    p.add_argument("inputs", nargs="*", help="files, directories and URLs")
    p.add_argument("-p", "--policy", help="a TOML file; the default policy without it")
    p.add_argument("-o", "--output", default="output")
    p.add_argument("-r", "--responses", help="Parquet of captured responses (url, status_code, content_type, data): pages and resources come from there")
    p.add_argument("--hops", help="Parquet of the redirects that came (chain, hop_no, url), which are tested as the policy says")
    p.add_argument("--dns", help="Parquet of addresses (host, ip): hosts without a safe one are refused")
    p.add_argument("-w", "--workers", type=int, default=4)
    p.add_argument("-v", "--verbose", action="count", default=0, help="log lines from warn on; again for info, trace, all")
    p.add_argument("-g", "--generate-policy", action="store_true", help="print the default policy")
    return p.parse_args(argv)


def run(spark: SparkSession, inputs: list[str], policy: Policy, output: str, responses: DataFrame | None = None, hops: DataFrame | None = None, dns: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sanitizes inputs into the folder output: documents, resources, log and reports.

    Files and pages, and the resources that they name, share one report: a row for each input and, after it, for each of
    its resources, also of those that broke nothing. hops and dns are those of crawl.answers(). Gives all actions (source_idx, sub, seq, ...), the inputs' names (source_idx, sub, input), and the
    paths that are not there.
    """
    began = datetime.datetime.now(datetime.timezone.utc)
    responses = spark.createDataFrame([], RESPONSES) if responses is None else responses
    found, urls, missing = files.read_inputs(spark, inputs)
    pages = remote.sanitize_pages(urls, responses, policy, hops, dns)
    outputs = pages.output.select("source_idx", F.lit("html").alias("kind"), "output")
    actions, named, names = pages.actions, pages.subresources, urls.select("source_idx", F.col("url").alias("input"))
    if found is not None:
        done = sanitize_files(found, policy)
        outputs = outputs.unionByName(done.output.select("source_idx", "kind", "output"))
        actions, named, names = actions.unionByName(done.actions), named.unionByName(done.subresources), names.unionByName(found.select("source_idx", "input"))
    crawled = cut(remote.fetch_subresources(named, responses, policy, hops, dns, inputs=urls))
    later = remote.resource_actions(crawled)
    none = F.lit(None).cast("string")
    more = later.select("source_idx", "sub", (F.col("n") + 1).alias("seq"), "level", "type", F.col("url").alias("original"), none.alias("replacement"), *(F.lit(None).cast("long").alias(c) for c in ("loc_start", "loc_end")))
    every = actions.withColumn("sub", F.lit(0)).unionByName(more)
    names = names.withColumn("sub", F.lit(0)).unionByName(remote.numbered_resources(crawled).select("source_idx", "sub", F.col("url").alias("input")))
    files.write_outputs(outputs, output)
    files.write_resources(crawled, output)
    keyed = lambda df: df.withColumn("_k", F.struct("source_idx", "sub"))
    files.write_log(report.log_lines(keyed(every), "_k"), output, "_k")
    ended = datetime.datetime.now(datetime.timezone.utc)
    told = report.reports(keyed(every).drop("source_idx", "sub"), keyed(names), "_k")
    files.write_reports(told.withColumn("start", F.lit(began)).withColumn("end", F.lit(ended)), output)
    return every, names, missing


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    if args.generate_policy:
        print(dump_default(), end="")
        return 0
    spark = SparkSession.builder.master(f"local[{args.workers}]").appName("cleanlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    policy = load_policy(open(args.policy, encoding="utf-8").read() if args.policy else None)
    responses = spark.read.parquet(args.responses) if args.responses else None
    hops, dns = (spark.read.parquet(p) if p else None for p in (args.hops, args.dns))
    actions, names, missing = run(spark, args.inputs, policy, args.output, responses, hops, dns)
    for path in missing:
        print(f"not there: {path}", file=sys.stderr)
    least = LEVELS[max(0, 4 - args.verbose)]
    lines = report.log_lines(actions.withColumn("_k", F.struct("source_idx", "sub")), "_k", least).join(names.withColumn("_k", F.struct("source_idx", "sub")), "_k")
    for r in lines.orderBy("source_idx", "sub", "seq").select("input", "line").toLocalIterator():
        print(f"{r['input']}: {r['line']}")
    return int(report.any_error(actions).first().failed)


if __name__ == "__main__":
    sys.exit(main())

"""Inputs and outputs: files, directories and URLs in, sanitized files, logs and reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.crawl import cut

#: Bytes of the numbers of files that are broadcast, at most.
NUMBERS = 64 << 20


def kind_of(path):  # noqa: ANN001, ANN201
    """What a local file is read as, by its extension: pdf, css, js, and html for all else."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("pdf", "css", "js"), ext).otherwise("html")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """source_idx, input, kind, data of every file below the paths; a file is named once for each path that leads to it.

    source_idx follows the order of the paths, then of the files' names. Files are listed and read by tasks. Names alone are
    put in order, by ranges; their numbers, 32 bytes a file, come to the contents by a broadcast up to NUMBERS bytes
    (beyond it, two million files, contents are shuffled to them).
    """
    rows = None
    for i, path in enumerate(paths):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        part = found.select(F.lit(i).alias("given"), F.col("path").alias("input"), kind_of(F.col("path")).alias("kind"), F.col("content").alias("data"))
        rows = part if rows is None else rows.unionByName(part)
    names = numbered_names(rows.select("given", "input"))
    names = F.broadcast(names) if names.count() * 32 <= NUMBERS else names
    return rows.withColumns(dict(zip(("_h", "_g"), name_hashes(), strict=True))).join(names, ["given", "_h", "_g"]).select("source_idx", "input", "kind", "data")


def name_hashes() -> tuple[Column, Column]:
    return F.xxhash64("input"), F.xxhash64(F.reverse("input"), F.lit(1))


def numbered_names(names: DataFrame) -> DataFrame:
    """given, _h, _g, source_idx of each name (given, input): its number in the order of given and input, from 1 in each.

    Names are dealt by ranges; a name's number is its place in its range and the sizes of the ranges before it.
    """
    key = ["given", "input"]
    ranged = cut(names.distinct().repartitionByRange(*key).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("given", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("given").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranged = ranged.join(F.broadcast(sizes.withColumn("_before", before)), ["given", "_part"])  # a row for each partition and path
    nth = F.col("_before") + F.row_number().over(W.partitionBy("given", "_part").orderBy("input"))
    numbered = ranged.withColumn("source_idx", F.col("given") * F.lit(1 << 40) + nth)
    h, g = name_hashes()
    return cut(numbered.select("given", h.alias("_h"), g.alias("_g"), "source_idx"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, or one that the pattern matches, in the file system that the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    got = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return got is not None and len(got) > 0


def read_inputs(spark: SparkSession, inputs: list[str]) -> tuple[DataFrame | None, DataFrame, list[str]]:
    """Files (None without any), URLs (source_idx, url) of mixed inputs, and the paths that are not there.

    What begins with http:// or https:// is a URL; its source_idx is below zero, so that it is no file's.
    """
    urls = [x for x in inputs if x.startswith(("http://", "https://"))]
    paths = [x for x in inputs if x not in urls]
    missing = [p for p in paths if not exists(spark, p)]
    there = [p for p in paths if p not in missing]
    return (read_files(spark, *there) if there else None), spark.createDataFrame([(i - len(urls), u) for i, u in enumerate(urls)], "source_idx long, url string"), missing


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """file, expected_rules of a JSON object from files to lists of rules."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("file", "expected_rules"))


REPORT = "input string, start timestamp, end timestamp, actions array<struct<type:string,level:string,original:string,replacement:string,loc_start:bigint,loc_end:bigint>>"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """input, start, end, actions of reports: of a file of one JSON array, or of a folder of JSON lines as write_reports() makes it."""
    if path.endswith(".json"):
        return spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in REPORT.split(', '))}>>")))
    return spark.read.schema(REPORT).json(path)


def write_outputs(output: DataFrame, path: str) -> None:
    """Sanitized documents as Parquet: many small files would burden the store, and blocked ones have none."""
    output.where("output is not null").write.mode("overwrite").parquet(f"{path}/documents")


def write_log(lines: DataFrame, path: str, key: str) -> None:
    """Log lines as text, grouped by document in order."""
    lines.repartitionByRange(key).sortWithinPartitions(key, "seq").select("line").write.mode("overwrite").text(f"{path}/log")


def write_reports(reports: DataFrame, path: str) -> None:
    """A JSON line for each report, in the order of source_idx and, if there, of sub, its resources after a source itself."""
    order = [c for c in ("source_idx", "sub") if c in reports.columns]
    named = reports.repartitionByRange(*order).sortWithinPartitions(*order) if order else reports
    fields = [c for c in ("input", "start", "end", "actions") if c in reports.columns]
    named.select(*fields).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/reports")


def write_resources(crawled: DataFrame, path: str) -> None:
    """The resources that a crawl kept, as Parquet: source_idx, url, local_name, output."""
    crawled.where(F.col("output").isNotNull()).select("source_idx", "url", "local_name", "output").write.mode("overwrite").parquet(f"{path}/resources")


def write_files(rows: DataFrame, path: str, name: str, data: str) -> None:
    """A file of its own for each row, as local readers want it: `data` under `name` in the folder path.

    The tasks that hold them write them, to any file system that pyarrow knows; a task done twice writes the same files again.
    Of rows that share a name the one with the least hash of its data is kept. Names with a folder in them, and rows without
    data, are left out.
    """
    import pyarrow.fs

    pyarrow.fs.FileSystem.from_uri(path)[0].create_dir(pyarrow.fs.FileSystem.from_uri(path)[1], recursive=True)

    def write(batches):  # noqa: ANN001, ANN202
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for n, d in zip(batch.column(0), batch.column(1), strict=True):
                with fs.open_output_stream(f"{root}/{n.as_py()}") as out:
                    out.write(d.as_py())
            yield batch.slice(0, 0)

    wanted = rows.select(F.col(name).alias("name"), F.col(data).alias("data")).where(F.col("data").isNotNull() & F.col("name").rlike(r"^[^/\\\\]+$") & ~F.col("name").isin(".", ".."))
    wanted = wanted.withColumn("_h", F.xxhash64("data"))
    twice = cut(wanted.select("name", "_h").distinct().groupBy("name").agg(F.count("*").alias("_k"), F.min("_h").alias("_least")).where("_k > 1").drop("_k"))
    if not twice.isEmpty():
        wanted = wanted.join(twice, "name", "left").where(F.col("_least").isNull() | (F.col("_h") == F.col("_least")))
    wanted.select("name", "data").mapInArrow(write, "name string, data binary").count()


EVALUATION = (
    "correctness array<struct<file:string,expected_verdict:string,actual_verdict:string,expected_rules:array<string>,actual_rules:array<string>,match_status:string>>, "
    "correctness_summary map<string,double>, performance array<struct<size_name:string,size_bytes:bigint,fetch_subresources:boolean,avg_latency_ms:double,throughput_ips:double>>, "
    "scalability array<struct<workload:string,threads:int,seconds:double,speedup:double>>"
)


def write_evaluation(verdicts: DataFrame, rates: DataFrame, performance: DataFrame, scalability: DataFrame, path: str) -> None:
    """One JSON object: the verdict of each file, their rates, latencies by size, and speed-ups by threads: a row for each file of an evaluation."""
    rules = lambda c: F.when(F.size(c) > 0, "unsafe").otherwise("safe")
    each = verdicts.select(F.col(verdicts.columns[0]).cast("string").alias("file"), rules("expected_rules").alias("expected_verdict"), rules("actual_rules").alias("actual_verdict"), "expected_rules", "actual_rules", "match_status")
    packed = lambda df: F.array_sort(F.collect_list(F.struct(*df.columns)))
    summary = rates.select(F.create_map(*(x for c in rates.columns for x in (F.lit(c), F.col(c).cast("double")))).alias("correctness_summary"))
    one = each.agg(packed(each).alias("correctness")).join(summary).join(performance.agg(packed(performance).alias("performance"))).join(scalability.agg(packed(scalability).alias("scalability")))
    one.coalesce(1).write.mode("overwrite").json(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """correctness, correctness_summary, performance, scalability of an evaluation's JSON object."""
    return spark.read.schema(EVALUATION).option("multiLine", True).json(path)

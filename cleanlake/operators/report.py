"""Reports of what was done, and how well it agrees with what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .policy import LEVELS

#: Bytes of a value that a log line shows.
SHOWN = 128


def level_number(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in LEVELS)), level) - 1


def reports(actions: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """key, input, actions: each input with its actions in order; none for those without."""
    packed = actions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "level", "type", "original", "replacement", "loc_start", "loc_end"))).alias("actions"))
    empty = F.array().cast(packed.schema["actions"].dataType)
    return inputs.join(packed, key, "left").withColumn("actions", F.coalesce("actions", empty))


def shortened(value: Column, most: int = SHOWN) -> Column:
    """The longest prefix of value, in whole characters, of less than `most` bytes, and three dots; value if that is all of it."""
    data = F.encode(value, "UTF-8")
    prefix = F.coalesce(*(F.try_validate_utf8(F.substring(data, 1, n).cast("string")) for n in range(most - 1, max(0, most - 5), -1)))
    return F.when(F.octet_length(value) >= most, F.concat(prefix, F.lit("..."))).otherwise(value)


def log_lines(actions: DataFrame, key: str, least: str = "trace") -> DataFrame:
    """key, seq, line: a text line for each action of at least that level, long values cut."""
    line = F.format_string("[%s] %s: %s%s", F.upper("level"), F.col("type"), F.coalesce(shortened(F.col("original")), F.lit("")), F.when(F.col("replacement").isNotNull(), F.concat(F.lit(" -> "), "replacement")).otherwise(""))
    return actions.where(level_number(F.col("level")) >= LEVELS.index(least)).select(key, "seq", line.alias("line"))


def any_error(actions: DataFrame) -> DataFrame:
    """failed: whether there is an action of level error."""
    return actions.agg(F.coalesce(F.bool_or(F.col("level") == "error"), F.lit(False)).alias("failed"))


def rules_of(actions: DataFrame, key: str) -> DataFrame:
    """key, actual_rules: the distinct types of each document's actions, sorted."""
    return actions.groupBy(key).agg(F.array_sort(F.collect_set("type")).alias("actual_rules"))


def verdicts(expected: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """key, expected_rules, actual_rules, match_status of every expected row: TP if all expected rules fired, and so on.

    Null and missing rule lists are empty. Rules beyond the expected ones never count against a true positive.
    """
    none = F.array().cast("array<string>")
    both = expected.join(rules, key, "left").select(key, F.coalesce("expected_rules", none).alias("expected_rules"), F.coalesce("actual_rules", none).alias("actual_rules"))
    missing = F.size(F.array_except("expected_rules", "actual_rules"))
    status = (
        F.when((F.size("expected_rules") > 0) & (missing == 0), "TP")
        .when(F.size("expected_rules") > 0, "FN")
        .when(F.size("actual_rules") > 0, "FP")
        .otherwise("TN")
    )
    return both.withColumn("match_status", status)


def rates(verdict: DataFrame) -> DataFrame:
    """tp, tn, fp, fn, detection_rate, false_positive_rate; a rate of nothing is 0."""
    n = {k: F.count_if(F.col("match_status") == k.upper()).cast("long") for k in ("tp", "tn", "fp", "fn")}
    counted = verdict.agg(*(v.alias(k) for k, v in n.items()))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    return counted.select("*", rate("tp", "fn").alias("detection_rate"), rate("fp", "tn").alias("false_positive_rate"))


def latency(runs: DataFrame, by: str = "size_name") -> DataFrame:
    """by, avg_latency_ms, throughput_ips of runs (by, seconds)."""
    return runs.groupBy(by).agg((F.avg("seconds") * 1000).alias("avg_latency_ms"), F.try_divide(F.count("*").cast("double"), F.sum("seconds")).alias("throughput_ips"))


def speedup(runs: DataFrame) -> DataFrame:
    """workload, threads, seconds, speedup over the run of one thread; null without one."""
    one = F.max(F.when(F.col("threads") == 1, F.col("seconds"))).over(W.partitionBy("workload"))
    return runs.select("workload", "threads", "seconds", F.try_divide(one, F.col("seconds")).alias("speedup"))


def replicate(documents: DataFrame, times: int, key: str) -> DataFrame:
    """documents `times` times over, with `copy` from 0."""
    return documents.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def summary(rates_row, metrics: list[tuple[str, str]] = ()) -> str:  # noqa: ANN001
    """Markdown of the one row of `rates`, and of further named figures."""
    rows = [(k, str(rates_row[k])) for k in ("tp", "tn", "fp", "fn")] + [(k, f"{100 * rates_row[k]:.2f} %") for k in ("detection_rate", "false_positive_rate")]
    return "\n".join(["| metric | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in [*rows, *metrics])]) + "\n"

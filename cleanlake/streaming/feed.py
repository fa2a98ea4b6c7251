"""Documents that arrive: sanitized batch by batch, URLs claimed once, budgets kept by source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.crawl import cut
from ..operators.html import listed_actions, sanitize_rows
from ..operators.policy import Policy


def sanitize_stream(documents: DataFrame, policy: Policy, path: str, checkpoint: str, key: str = "page_id", html: str = "html", every: str | None = None):  # noqa: ANN201
    """A started query that writes the output and the actions of each micro-batch, by its number, so that a batch done twice is written once.

    A batch is worked out once and kept (cut) for both. It stops when all that is there is read, or, with `every` (such
    as "10 seconds"), goes on for what arrives.
    """

    def batch(rows: DataFrame, number: int) -> None:
        got = cut(sanitize_rows(rows, policy, key, html))
        got.select(key, "output").write.mode("overwrite").parquet(f"{path}/output/batch={number}")
        listed_actions(got, key).write.mode("overwrite").parquet(f"{path}/actions/batch={number}")

    started = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if every is None else started.trigger(processingTime=every)).start()


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names, which all executors see."""
    cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def run_once(streamed: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    """The rows of a streaming query over all that is there: those of each batch, or of the last one if mode is complete."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/last" if mode == "complete" else f"{path}/batch={number}")

    streamed.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark, columns = streamed.sparkSession, streamed.columns
    return spark.read.schema(streamed.schema).parquet(f"{path}/last" if mode == "complete" else path).select(columns)


def first_seen(urls: DataFrame, time: str = "ts", within: str | None = None) -> DataFrame:
    """urls (url, ...) at their first sight. The state holds every URL, as a crawl's visited table does.

    With `within` (such as "1 hour") only those that came within that time before are known, which bounds the state.
    """
    if within is None:
        return urls.dropDuplicates(["url"])
    return urls.withWatermark(time, within).dropDuplicatesWithinWatermark(["url"])


def take_budget(urls: DataFrame, most: int) -> DataFrame:
    """source_idx, url, nth of streamed urls: the first `most` of each source; a source's state is one number."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for f in frames:
            part = f.iloc[: max(0, most - n)].reset_index(drop=True)
            yield pd.DataFrame({"source_idx": part["source_idx"], "url": part["url"], "nth": range(n + 1, n + 1 + len(part))})
            n += len(part)
        state.update((n,))

    return urls.groupBy("source_idx").applyInPandasWithState(step, "source_idx long, url string, nth long", "n long", "append", GroupStateTimeout.NoTimeout)


def rule_counts(actions: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, type, n of streamed actions (type, ts)."""
    return actions.withWatermark(time, late).groupBy(F.window(time, width), "type").agg(F.count("*").alias("n"))

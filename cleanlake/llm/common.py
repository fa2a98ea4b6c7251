"""What the operators share: cutting lineage, bounded samples, and batches of rows in Python tasks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that a Python task works on at once (one text may be longer).
SLICE_BYTES = 1 << 20
#: Rows at once.
SLICE_ROWS = 1024
#: Bytes of the texts of one label or language that a model is fitted to on the driver, at most.
SAMPLE_BYTES = 32 << 20


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the folder of spark.checkpoint.dir, so that lost executors do not lose them.

    Without that setting only a local session may go on, in a folder of its own: on a cluster no machine's folder would do.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, row_bytes: int, limit: int = 16 << 20) -> DataFrame:
    """df with a broadcast hint if its counted rows, at row_bytes each, take at most limit; else as it is, for a shuffle join.

    df must be cheap to count: pass the result of cut().
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of batch of at most SLICE_ROWS rows and about SLICE_BYTES of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (held + n > SLICE_BYTES or i - begin >= SLICE_ROWS):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def map_texts(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """fn on slices of df's rows, in Python tasks that keep one slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column):
                yield fn(part)

    return df.mapInArrow(run, schema)


_WORKER: dict[str, object] = {}


def once_a_worker(token: str, make: Callable[[], object]) -> object:
    """make()'s result, made once in a Python worker for each token; a few of the latest are kept."""
    if token not in _WORKER:
        while len(_WORKER) >= 4:
            _WORKER.pop(next(iter(_WORKER)))
        _WORKER[token] = make()
    return _WORKER[token]


def remainder(key: Column, n: int) -> Column:
    """crc32 of key as text, mod n; null for a null key."""
    return F.crc32(key.cast("string")) % n


def sampled_texts(documents: DataFrame, picked: DataFrame, group: str, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text, h and the columns of picked: one text for each picked id (doc_id, h, group, ...), for fitting on the driver.

    Of the unlike texts of an id the one with the least hash is taken. In each group texts are taken in the order of h
    and doc_id while they have `most_bytes` bytes in all, and the first in any case. picked must be few rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id")
    rest = [c for c in picked.columns if c != "doc_id"]
    one = cut(rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("_h"), "text", *rest)).alias("r")).select("doc_id", "r.text", *(f"r.{c}" for c in rest)))
    held = F.sum(F.octet_length("text").cast("long")).over(W.partitionBy(group).orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    nth = F.row_number().over(W.partitionBy(group).orderBy("h", "doc_id"))
    few = one.withColumn("_held", held).withColumn("_nth", nth).where((F.col("_held") <= most_bytes) | (F.col("_nth") == 1))
    return few.drop("_held", "_nth")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, most: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """Texts and labels of at most `most` ids and `most_bytes` bytes of either class, for fitting on the driver.

    Only rows whose fold (crc32 of the id mod folds) is not left_out. The ids come from `labels` alone, in the
    order of a hash; only they, bounded by 2 * most, are broadcast to fetch one text each. Several labels of an id count
    as the largest; repeated texts count once.
    """
    lab = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), folds) != left_out))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    picked = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy("h", "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    seen: dict[str, int] = {}
    for r in sampled_texts(documents, picked, "y", most_bytes).select("doc_id", "text", "y").orderBy("doc_id").collect():
        seen[r["text"]] = max(r["y"], seen.get(r["text"], 0))
    return list(seen.items())

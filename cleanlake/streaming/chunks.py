"""Bodies that come in chunks: entity declarations that chunks cut in two, and budgets that end a body within it.

What a chunk leaves undecided (a declaration that has begun, or the first letters of one) is held until the next chunk; so
any cut of a document into chunks gives the bytes of the whole one. Tables of chunks are read in order within partitions,
a few rows at a time; streams keep what is held, and chunks that came too early, as the state of their document.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import resources
from ..operators.policy import Policy, ReplaceRule

_WHOLE = re.compile(resources.ENTITY.encode())
_BEGUN = re.compile(rb"(?is)<!ENTITY.*|<(?:!(?:E(?:N(?:T(?:I(?:T)?)?)?)?)?)?\Z")
FOUND = "array<struct<original:string,start:bigint,end:bigint>>"
ROW = f"seq bigint, data binary, settled bigint, found {FOUND}"


class EntityFilter:
    """The bytes of one document as they come. settled counts the bytes that are decided, declarations included."""

    def __init__(self, rule: ReplaceRule, held: bytes = b"", settled: int = 0, ended: bool = False):
        self.rule, self.held, self.settled, self.ended = rule, held, settled, ended

    def feed(self, chunk: bytes, last: bool) -> tuple[bytes, list[tuple[str, int, int]]]:
        """What the chunk decides: bytes to pass on, and the declarations (text, and place in the document); nothing after an error."""
        out, found, data, at = [], [], self.held + chunk, 0
        self.held = b""
        if self.ended:
            return b"", []
        for m in _WHOLE.finditer(data):
            out.append(data[at : m.start()])
            found.append((m.group().decode("utf-8", "replace"), self.settled + m.start(), self.settled + m.end()))
            if self.rule.level == "error":
                self.ended, self.settled = True, self.settled + m.end()
                return b"".join(out), found
            out.append(m.group() if self.rule.replace is None else self.rule.replace.encode())
            at = m.end()
        begun = None if last else _BEGUN.search(data, at)
        stop = begun.start() if begun else len(data)
        out.append(data[at:stop])
        self.held, self.settled = data[stop:], self.settled + stop
        return b"".join(out), found


def filter_chunks(chunks: DataFrame, rule: ReplaceRule, key: str = "doc_id") -> DataFrame:
    """key, seq, data, settled, found of each chunk (key, seq, data, last): entity declarations replaced, across chunks.

    A declaration is told, with its place in the document, by the chunk that ends it. An error ends its document: later
    chunks are empty. The chunk of the greatest seq is the last one, whatever `last` says; null keys are one document, null data is empty.
    """
    kind = chunks.schema[key].dataType.simpleString()
    greatest = F.col("seq") == F.max("seq").over(W.partitionBy("key"))
    rows = chunks.select(F.col(key).alias("key"), F.col("seq").cast("long").alias("seq"), F.coalesce("data", F.lit(b"")).alias("data"))
    rows = rows.repartition("key").select("key", "seq", "data", greatest.alias("last")).sortWithinPartitions("key", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = object(), None
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part, out = batch.slice(s, 64), []
                for k, seq, data, last in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if own is None or k != now:
                        now, own = k, EntityFilter(rule)
                    passed, found = own.feed(data, last)
                    out.append({"seq": seq, "data": passed, "settled": own.settled, "found": [dict(zip(("original", "start", "end"), f, strict=True)) for f in found]})
                kinds = pa.schema([("seq", pa.int64()), ("data", pa.binary()), ("settled", pa.int64()), ("found", pa.list_(pa.struct([("original", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
                made = pa.RecordBatch.from_pylist(out, kinds)
                yield pa.RecordBatch.from_arrays([part.column(0), *made.columns], ["key", *made.schema.names])

    return rows.mapInArrow(run, f"key {kind}, {ROW}").withColumnRenamed("key", key)


def filter_stream(chunks: DataFrame, rule: ReplaceRule, key: str = "doc_id") -> DataFrame:
    """filter_chunks() of streamed chunks (key, seq from 0 on, data, last), each passed on once those before it have come.

    The state of a document is what is held, how much is settled, and the chunks that came too early; it goes with the last chunk.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, own, waiting = pickle.loads(state.get[0]) if state.exists else (0, EntityFilter(rule), {})
        for f in frames:
            waiting |= {int(s): (bytes(d) if d is not None else b"", bool(e)) for s, d, e in zip(f["seq"], f["data"], f["last"], strict=True)}
        out, over = [], False
        while following in waiting and not over:
            data, over = waiting.pop(following)
            passed, found = own.feed(data, over)
            out.append((k[0], following, passed, own.settled, [{"original": a, "start": b, "end": c} for a, b, c in found]))
            following += 1
        if over:
            state.remove()
        else:
            state.update((pickle.dumps((following, own, waiting)),))
        yield pd.DataFrame(out, columns=[key, "seq", "data", "settled", "found"])

    rows = chunks.select(key, F.col("seq").cast("long").alias("seq"), "data", "last")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ROW}", "held binary", "append", GroupStateTimeout.NoTimeout)


def within_budget(filtered: DataFrame, policy: Policy, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """What filter_chunks() passed on, up to max_bytes settled bytes of a document; and the actions (key, seq, type, level, original, loc_start, loc_end).

    The first chunk that goes beyond ends its document if the rule is an error: it and what follows is not passed on, its
    declarations are told, then max_bytes. A milder rule tells every chunk that goes beyond.
    """
    limit, rules = policy.max_bytes, policy.xml_entities
    over = limit.exceeded("settled")
    so_far = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    marked = filtered.withColumn("_over", over).withColumn("_before", F.coalesce(F.max(F.col("_over")).over(so_far), F.lit(False)))
    marked = marked.where(~F.col("_before")) if limit.level == "error" else marked
    kept = marked.where(~F.col("_over")) if limit.level == "error" else marked
    told = marked.select(key, "seq", F.posexplode("found").alias("n", "f")).select(key, "seq", "n", F.lit("xml_entities").alias("type"), F.lit(rules.level).alias("level"), "f.original", F.col("f.start").alias("loc_start"), F.col("f.end").alias("loc_end"))
    none = F.lit(None)
    ends = marked.where("_over").select(key, "seq", F.lit(1 << 30).alias("n"), F.lit("max_bytes").alias("type"), F.lit(limit.level).alias("level"), none.cast("string").alias("original"), none.cast("long").alias("loc_start"), none.cast("long").alias("loc_end"))
    return kept.select(filtered.columns), told.unionByName(ends).drop("n")

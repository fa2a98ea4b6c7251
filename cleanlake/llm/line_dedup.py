"""Lines that repeat across documents: two Bloom filters find the suspects, an exact count decides.

Each long line is hashed once, into a row of its text's lines. The hashes are dealt into segments, of which there are as
many as the lines need; in each segment a hash goes into the filter of hashes seen once or, when that one holds it
already, into the filter of hashes seen twice. The lines' hashes are then probed in the filter of their segment, where it
lies: it is never gathered or sent to all. A line whose hash is not in the filter occurs once only and goes no further.
The others, the suspects, are counted by document, by the digest of their whole key, and kept in the largest of their
documents. A segment of very many lines, as a hot line makes it, is probed in parts, each with a copy of the filter.

Texts are not shuffled to find suspects. At the end a third filter, of the texts that lose a line, lets all others pass
by the join with the lost lines; that join is a broadcast while the lost lines are few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import cut, small_enough
from .components import sorted_groups
from .hashing import mix64
from .text import lower_ascii, row_key

#: What `\s` is here: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of a segment of a filter, lines that it is made for (16 bits each), and bits set for a line.
SEGMENT_BITS, SEGMENT_LINES, PROBES = 1 << 19, 1 << 15, 4
#: Lines of a segment, repeats included, that one task probes.
PART_LINES = 1 << 17
#: Segments of the filter of texts that lose a line, at most: it is sent to all (32 MB), and lets more pass when overfull.
TEXT_SEGMENTS = 512


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(BLANKS)))


def long_lines(text: Column, least: int) -> Column:
    """array<struct<pos,hash,digest>>: the lines of text whose key has at least `least` code points; the digest is 16 bytes of SHA-256."""

    def one(line: Column, pos: Column) -> Column:
        hashed = lambda k: F.when(F.length(k) >= least, F.struct(pos.alias("pos"), F.xxhash64(k).alias("hash"), F.substring(F.unhex(F.sha2(k, 256)), 1, 16).alias("digest")))
        return F.when(F.length(line) >= least, let(line_key(line), hashed))

    return F.filter(F.transform(split_lines(text), one), lambda x: x.isNotNull())


def probes(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash within its segment."""
    h = mix64(hashes.astype(np.uint64))
    return np.stack([(h >> np.uint64(k * 15)) % np.uint64(SEGMENT_BITS) for k in range(PROBES - 1)] + [mix64(h) % np.uint64(SEGMENT_BITS)], axis=1).astype(np.int64)


def holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def put(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at.ravel() >> 3, np.left_shift(1, at.ravel() & 7).astype(np.uint8))


def filters(hashes: DataFrame, segments: int, times: int) -> DataFrame:
    """segment, bits, n: of the hashes (array<bigint>), a filter of those seen `times` times (1 or 2) for each segment, and their number."""

    def combine(batches):  # a hash leaves a batch once, with its number there
        for batch in batches:
            got, n = np.unique(np.asarray(batch.column(0).flatten(), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(got % segments), pa.array(got), pa.array(n)], ["segment", "hash", "n"])

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
        hashes, count = rows["hash"].to_numpy(), rows["n"].to_numpy()
        for s in range(0, len(hashes), 1 << 16):
            got, index, n = np.unique(hashes[s : s + (1 << 16)], return_inverse=True, return_counts=True)
            again = n > 1
            again[index[count[s : s + (1 << 16)] > 1]] = True
            at = probes(got)
            put(twice, at[again | holds(once, at)])
            put(once, at)
        return pd.DataFrame({"segment": [key[0]], "bits": [(twice if times > 1 else once).tobytes()], "n": [count.sum()]})

    return hashes.mapInArrow(combine, "segment long, hash long, n long").groupBy("segment").applyInPandas(build, "segment long, bits binary, n long")


def suspects(lines: DataFrame) -> DataFrame:
    """_k1, _k2, doc_id, pos, digest: the lines whose hash was seen twice, or looks so."""
    total = int(lines.agg(F.sum(F.size("lines"))).first()[0] or 0)
    segments = max(1, -(-total // SEGMENT_LINES))
    twice = cut(filters(lines.select("lines.hash"), segments, 2))
    heavy = cut(twice.where(F.col("n") > PART_LINES).select("segment", F.ceil(F.col("n") / PART_LINES).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    each = lines.select("_k1", "_k2", "doc_id", F.inline("lines")).withColumn("segment", F.pmod("hash", F.lit(segments)))
    each = each.join(small_enough(heavy, 16), "segment", "left").withColumn("part", F.pmod(F.xxhash64("_k1", "pos"), parts))
    copies = twice.join(small_enough(heavy, 16), "segment", "left").select("segment", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "bits")
    names = ["_k1", "_k2", "doc_id", "pos", "hash", "digest"]
    kinds = dict(each.dtypes)
    both = each.select("segment", "part", *names, F.lit(None).cast("binary").alias("bits"))
    both = both.union(copies.select("segment", "part", *(F.lit(None).cast(kinds[n]).alias(n) for n in names), "bits"))
    out = [n for n in names if n != "hash"]

    def probe(batches):
        for t in sorted_groups(batches, 2):
            bits, found = np.frombuffer(t.column("bits")[0].as_py(), np.uint8), t.slice(1)
            for batch in found.to_batches():
                hit = holds(bits, probes(np.asarray(batch.column("hash"))))
                if hit.any():
                    yield batch.filter(pa.array(hit)).select(out)

    dealt = both.repartition("segment", "part").sortWithinPartitions("segment", "part", F.col("bits").isNull())
    return dealt.mapInArrow(probe, ", ".join(f"{n} {kinds[n]}" for n in out))


def gone_lines(lines: DataFrame, copies: int) -> DataFrame:
    """_k1, _k2, _gone array<int>: the lines that each text loses."""
    found = cut(suspects(lines))
    by_document = found.where("doc_id is not null").select("digest", "doc_id").distinct()
    repeated = cut(by_document.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= copies).drop("n"))
    lost = found.join(small_enough(repeated, 32), "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("_gone"))


def maybe_in(texts: DataFrame, gone: DataFrame, n: int) -> Column:
    """Whether a row of texts may have lost lines: false only if gone, of n rows, does not name its _k1."""
    segments = min(TEXT_SEGMENTS, max(1, -(-n // SEGMENT_LINES)))
    bits = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for segment, data, _ in filters(gone.select(F.array("_k1")), segments, 1).toLocalIterator():
        bits[segment] = np.frombuffer(data, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits.ravel())

    @F.arrow_udf("boolean")
    def maybe(keys: pa.Array) -> pa.Array:
        got = np.asarray(keys, np.int64)
        return pa.array(holds(shared.value, probes(got) + (got % segments)[:, None] * SEGMENT_BITS))

    return maybe(F.col("_k1"))


def dedup_lines(documents: DataFrame, least: int = 20, copies: int = 3, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The rows of documents, all columns, with the lines that repeat taken out of `text`; n_lines and n_dropped are added.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least `least` code points in at
    least `copies` documents lose all their lines except in the largest doc_id that holds them. Null and empty texts
    are one empty line and come out empty. Rows of the same doc_id count as one document, rows of a null doc_id as
    none: they lose the line and never keep it. Keys are told apart by 128 bits of SHA-256. Columns named n_lines,
    n_dropped, _k1, _k2 or _gone are replaced or dropped. Up to `broadcast_bytes` of lost lines go to all tasks; beyond,
    the texts that lose some are joined with them in a shuffle.
    """
    whole = documents.drop("n_lines", "n_dropped", "_k1", "_k2", "_gone").select("*", *row_key(documents["doc_id"], documents["text"]))
    lines = whole.select("_k1", "_k2", "doc_id", long_lines(F.col("text"), least).alias("lines")).where(F.size("lines") > 0)
    gone = cut(gone_lines(cut(lines), copies))
    n, positions = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()
    if 40 * n + 4 * positions <= broadcast_bytes:
        joined = whole.join(F.broadcast(gone), ["_k1", "_k2"], "left")
    else:
        marked = whole.withColumn("_maybe", maybe_in(whole, gone, n))
        passing = marked.where(~F.col("_maybe")).drop("_maybe").withColumn("_gone", F.lit(None).cast("array<int>"))
        joined = marked.where("_maybe").drop("_maybe").join(gone, ["_k1", "_k2"], "left").unionByName(passing)
    split = split_lines(F.col("text"))
    stay = let(split, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: x[i]), "\n"))
    dropped = F.coalesce(F.size("_gone"), F.lit(0))
    new = F.when(dropped > 0, stay).otherwise(F.coalesce("text", F.lit("")))
    return joined.select(*(c for c in whole.columns if c not in ("_k1", "_k2", "text")), F.size(split).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), new.alias("text")).select(
        *(c for c in whole.columns if c not in ("_k1", "_k2")), "n_lines", "n_dropped"
    )

"""Connected components of links between numbered nodes, without a task or a driver that holds them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_enough

#: Links that a task joins at once.
LOCAL = 200_000


class Forest:
    """Union-find; a root is the least of its tree."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent, top = self.parent, x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top:
            parent[x], x = top, p
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def shorten(links: DataFrame, local: int) -> DataFrame:
    """hi, lo: a link from each node to the least one that its part of the links joins it with; a part has `local` links at most."""

    def flat(forest: Forest) -> pa.RecordBatch:
        nodes = [x for x in {*forest.parent, *forest.parent.values()} if forest.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], ["hi", "lo"])

    def run(batches):
        forest, held = Forest(), 0
        for batch in batches:
            for s in range(0, batch.num_rows, local):
                part = batch.slice(s, local)
                if held + part.num_rows > local:
                    yield flat(forest)
                    forest, held = Forest(), 0
                held += part.num_rows
                for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    forest.join(x, y)
        yield flat(forest)

    return links.select("hi", "lo").mapInArrow(run, "hi long, lo long")


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """node, component: for each node of links (hi, lo: long), the least node that it is joined with; lesser nodes alone are left out.

    Tasks first join what they hold. Then large-star and small-star steps in turn: every node's larger neighbours, then
    its smaller ones, are linked to its least neighbour; each step takes a minimum for each node, combined before the
    shuffle, and joins it back. It ends when nothing changes, or when at most `local` links are left: one task joins those.
    """
    now = cut(shorten(links.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")), local).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0] > local:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.join(small_enough(least, 16), "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = cut(large)
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(small_enough(least, 16), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = cut(shorten(small.union(least.select("hi", F.col("m").alias("lo"))), local).distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    if before[0] <= local:
        now = cut(shorten(now.coalesce(1), local))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def sorted_groups(batches, keys: int):
    """Tables of the rows of one value of the first `keys` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = bool(held) and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys))
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if change[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)

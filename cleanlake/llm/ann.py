"""Nearest neighbours by inner product over additively quantised vectors.

A vector is the sum of one codeword of each of CODEBOOKS codebooks, all of the full dimension, and a residual. The
codewords are chosen by a beam search over the codebooks; the codes, the norm of their sum and the norm of the
residual are stored. A query is scored against a code by looking up its products with the codewords. Rows whose looked
up score, with what their residual may plausibly add, reaches the query's k-th are reranked by their exact product.

Queries and candidates meet in blocks of bounded size, each pair of blocks in a group of its own.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, once_a_worker
from .components import sorted_groups

CODEBOOKS, WORDS, BEAM = 8, 256, 4
#: Rows that the codebooks are fitted to at most; rounds of k-means and of refitting all codebooks together.
SAMPLE, ROUNDS, REFITS = 8192, 8, 1
#: Candidates and queries of a block; standard deviations that a residual's product is allowed for.
CANDIDATES, QUERIES, ALLOWANCE = 8192, 4096, 3.0


class Codebooks:
    def __init__(self, words: np.ndarray):
        self.words = words  # [codebook, word, dimension]
        m, k, d = words.shape
        flat = words.reshape(m * k, d)
        self.products = (flat @ flat.T).reshape(m, k, m, k)
        self.norms = (words**2).sum(axis=2)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """[row, codebook]: codes by a beam search for the least squared residual."""
        n, (m, k, _) = len(x), self.words.shape
        own = np.stack([x @ w.T for w in self.words], axis=1)
        codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for j in range(m):
            add = (self.norms[j] - 2 * own[:, j])[:, None, :] + cost[:, :, None]
            for i in range(j):
                add = add + 2 * self.products[i, :, j][codes[:, :, i]]
            flat = add.reshape(n, -1)
            keep = min(beam if j < m - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.broadcast_to(np.arange(keep), flat.shape)
            row = np.arange(n)[:, None]
            cost = flat[row, best]
            codes = np.concatenate([codes[row, best // k], (best % k)[:, :, None]], axis=2)
        return codes[np.arange(n), cost.argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[j][codes[:, j]] for j in range(len(self.words)))


def kmeans(x: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    words = x[random.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((words**2).sum(axis=1) - 2 * x @ words.T).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words[count > 0] = total[count > 0] / count[count > 0, None]
        words[count == 0] = x[random.choice(len(x), int((count == 0).sum()))]
    return words


def fit(x: np.ndarray) -> Codebooks:
    """Codebooks of the residuals, one after the other, then all refitted to the codes by least squares."""
    random, left, words = np.random.default_rng(1), x.astype(np.float32), []
    k = min(WORDS, len(x))
    for _ in range(CODEBOOKS):
        w = kmeans(left, k, ROUNDS, random)
        left = left - w[((w**2).sum(axis=1) - 2 * left @ w.T).argmin(axis=1)]
        words.append(w)
    books = Codebooks(np.stack(words))
    for _ in range(REFITS):
        codes = np.concatenate([books.encode(x[s : s + 4096].astype(np.float32)) for s in range(0, len(x), 4096)]) + np.arange(CODEBOOKS) * k
        together = np.zeros((CODEBOOKS * k, CODEBOOKS * k), np.float32)
        for i in range(CODEBOOKS):
            for j in range(CODEBOOKS):
                np.add.at(together, (codes[:, i], codes[:, j]), 1)
        sums = np.zeros((CODEBOOKS * k, x.shape[1]), np.float32)
        for i in range(CODEBOOKS):
            np.add.at(sums, codes[:, i], x)
        ridge = np.eye(CODEBOOKS * k, dtype=np.float32)
        flat = books.words.reshape(CODEBOOKS * k, -1)
        flat = flat + np.linalg.solve(together + ridge, sums - together @ flat)
        books = Codebooks(flat.reshape(CODEBOOKS, k, -1).astype(np.float32))
    return books


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def build(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, Codebooks | None, int]:
    """The index, kept: id, v, codes, norm, rest of every vector that takes part; the codebooks; the dimension."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return rows.select("id", "v", F.lit(b"").alias("codes"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("rest")), None, 0
    dimension, n = lengths
    rows = rows.where(F.size("v") == dimension)
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    part = rows.where(order < min(1.0, 1.5 * SAMPLE / n) * (1 << 30)).select("v", order.alias("h"), "id").orderBy("h", "id").limit(SAMPLE).collect()
    books = fit(np.array([r[0] for r in part]))
    shared, token = vectors.sparkSession.sparkContext.broadcast(books.words), uuid.uuid4().hex

    def encode(batches):
        for batch in batches:
            own = once_a_worker(token, lambda: Codebooks(shared.value))
            for s in range(0, batch.num_rows, 2048):
                b = batch.slice(s, 2048)
                x = matrix(b.column(1), dimension)
                codes = own.encode(x.astype(np.float32))
                sums = own.decode(codes)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array((sums**2).sum(axis=1).astype(float) ** 0.5), pa.array(((x - sums) ** 2).sum(axis=1) ** 0.5)],
                    ["id", "v", "codes", "norm", "rest"],
                )

    return cut(rows.mapInArrow(encode, "id long, v array<double>, codes binary, norm double, rest double")), books, dimension


def search_block(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, codes: np.ndarray, norm: np.ndarray, rest: np.ndarray, words: np.ndarray, k: int, distance: bool = False) -> tuple:
    """query ids, candidate ids and exact scores: each query's k best of the block that the codes do not rule out."""
    table = np.einsum("qd,mkd->mqk", q.astype(np.float32), words, optimize=True)
    reach = np.sqrt((q**2).sum(axis=1)) + (norm.max(initial=0) if distance else 0)
    out: tuple[list, list, list] = ([], [], [])
    slack = (ALLOWANCE / np.sqrt(x.shape[1]) * rest).astype(np.float32)
    for s in range(0, len(q), 256):
        looked = sum(t[s : s + 256][:, codes[:, j]] for j, t in enumerate(table))
        if distance:  # |q - y|^2 = |q|^2 - 2 (q.y - |y|^2 / 2), by the stored norm of y
            looked = looked - (norm**2 / 2).astype(np.float32)
        for i, score in enumerate(looked, start=s):
            if len(xid) > k:
                least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]  # one more, for the query itself
                at = np.flatnonzero(score + reach[i] * slack >= least)
            else:
                at = np.arange(len(xid))
            at = at[xid[at] != qid[i]]
            exact = -((x[at] - q[i]) ** 2).sum(axis=1) if distance else (x[at] * q[i]).sum(axis=1)
            best = np.lexsort((xid[at], -exact))[:k]
            out[0].append(np.full(len(best), qid[i]))
            out[1].append(xid[at][best])
            out[2].append(exact[best])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def nearest(vectors: DataFrame, k: int = 20, queries: Column | None = None, key: str = "vec_id", vector: str = "embedding", distance: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row that `queries` holds for, by inner product.

    With distance, by the least Euclidean distance instead, the score being its negative square.

    `queries` is a condition on the id, by default ids divisible by 20; candidates are all rows but those of the
    query's id, all of them if fewer than k. Nearest first, ties to the smaller id. Null, zero and non-finite vectors,
    null ids, and vectors of another length than most take no part; rows that share an id count once. The codebooks
    are fitted on the driver to at most SAMPLE rows; every row is indexed. Lookup leaves rows out by probability
    (ALLOWANCE standard deviations of the residual's product): measured recall is in the README.
    """
    index, books, dimension = build(vectors, key, vector)
    schema = "query_id long, vec_id long, score double"
    if books is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    else:
        asked = index.where(queries if queries is not None else F.col("id") % 20 == 0)
        n, m = index.count(), asked.count()
        groups, sides = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
        left = asked.select(F.lit(0).alias("role"), "id", "v", "codes", "norm", "rest", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(sides)).cast("int").alias("side")).withColumn("part", every(groups))
        right = index.select(F.lit(1).alias("role"), "id", "v", "codes", "norm", "rest", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("part")).withColumn("side", every(sides))
        words = vectors.sparkSession.sparkContext.broadcast(books.words)
        columns = ["part", "side", "role", "id", "v", "codes", "norm", "rest"]

        def search(batches):
            for t in sorted_groups(batches, 2):
                role, ids = t.column("role").to_numpy(), t.column("id").to_numpy()
                picks = []
                for r in (0, 1):
                    at = np.flatnonzero(role == r)
                    _, first = np.unique(ids[at], return_index=True)
                    picks.append(at[first])
                if not len(picks[0]) or not len(picks[1]):
                    continue
                x = matrix(t.column("v").combine_chunks(), dimension)
                codes = np.frombuffer(b"".join(t.column("codes").take(pa.array(picks[1])).to_pylist()), np.uint8).reshape(len(picks[1]), -1)
                norm, rest = (t.column(c).to_numpy()[picks[1]] for c in ("norm", "rest"))
                a, b, c = search_block(x[picks[0]], ids[picks[0]], x[picks[1]], ids[picks[1]], codes, norm, rest, words.value, k, distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c.astype(float))], ["query_id", "vec_id", "score"])

        dealt = left.select(*columns).union(right.select(*columns)).repartition("part", "side").sortWithinPartitions("part", "side", "role", "id")
        found = dealt.mapInArrow(search, schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

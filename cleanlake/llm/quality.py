"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is described by the shares of its kinds of characters and words, and by its
words themselves, hashed into buckets, and encoded by one layer; gated attention, a tanh layer times a sigmoid layer, gives it a weight; the weighted sum of the
codes is classified. Codes, attention and classifier are learned together from the labels of documents alone.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import labelled_sample, map_texts, once_a_worker, remainder
from .hashing import mix64

#: Bytes of a passage at most: a longer line is cut after a blank, or there.
PASSAGE = 800
#: Widths of the code and of the attention layers; training texts of either label; buckets of words.
CODE, GATE, SAMPLE, BUCKETS = 12, 8, 800, 64
ROUNDS, RATE, RIDGE = 120, 0.04, 1e-4
#: How much the buckets of words weigh beside the shares.
WORDS = 0.1
#: Fixed kinds of bytes.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", ".", ",", "!?", "|", "#$%&*@^~+=<>\\", "-_/", "\"'()[]{}:;")
KIND = np.full(256, len(KINDS), np.int8)
for _i, _k in enumerate(KINDS):
    KIND[np.frombuffer(_k.encode(), np.uint8)] = _i
KIND[128:] = len(KINDS) + 1
N_KINDS = len(KINDS) + 2
FEATURES = N_KINDS + 7 + BUCKETS
_POWER = np.cumprod(np.full(PASSAGE + 1, 0x9E3779B97F4A7C15, np.uint64))


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes with a line feed after each; where each passage begins; each text's number of passages."""
    data = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    start = np.concatenate([[0], np.flatnonzero(data == 10) + 1])[:-1] if len(data) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [len(data)]]))
    parts = -(-size // PASSAGE)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(start, parts) + within * PASSAGE
    return data, begin, np.diff(np.concatenate([[0], np.searchsorted(begin, ends)]))


def describe(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """[passage, feature]: of each passage of data, from begin to the next one's."""
    n, size = len(begin), np.diff(np.concatenate([begin, [len(data)]])).astype(float)
    out = np.zeros((n, FEATURES))
    if not n:
        return out
    kind = KIND[data]
    owner = np.repeat(np.arange(n, dtype=np.int64), size.astype(np.int64))
    out[:, :N_KINDS] = np.bincount(owner * N_KINDS + kind, minlength=n * N_KINDS).reshape(n, N_KINDS) / size[:, None]
    gap = (kind == 3) | (data == 10)
    first = ~gap
    first[1:] &= gap[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    if len(at):
        word = np.cumsum(first) - 1  # of each byte; the blanks after a word are its own
        value = np.where(gap, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWER[np.minimum(np.arange(len(data)) - at[np.maximum(word, 0)], PASSAGE)])
        number = mix64(np.add.reduceat(value, at))
        long = np.add.reduceat(~gap, at, dtype=np.float64)
        of = owner[at]
        words = np.maximum(np.bincount(of, minlength=n), 1)
        same = np.concatenate([[False], (number[1:] == number[:-1]) & (of[1:] == of[:-1])])
        order = np.lexsort((number, of))
        new = np.concatenate([[True], (number[order][1:] != number[order][:-1]) | (of[order][1:] != of[order][:-1])])
        shout = np.add.reduceat(kind == 1, at) * 2 > long
        out[:, N_KINDS] = np.bincount(of, same, n) / words
        out[:, N_KINDS + 1] = np.bincount(of[order], new, n) / words
        out[:, N_KINDS + 2] = np.bincount(of, long, n) / words / 10
        out[:, N_KINDS + 3] = np.bincount(of, shout, n) / words
        out[:, N_KINDS + 4] = np.log1p(words) / 5
        out[:, N_KINDS + 5] = np.bincount(of, long > 20, n) / words
        bucket = of * BUCKETS + (number >> np.uint64(40)).astype(np.int64) % BUCKETS
        sign = np.where(number >> np.uint64(63), 1.0, -1.0)
        out[:, N_KINDS + 7 :] = np.bincount(bucket, sign, n * BUCKETS).reshape(n, BUCKETS) / np.sqrt(words)[:, None] * WORDS
    out[:, N_KINDS + 6] = np.log1p(size) / 7
    return out


class Model:
    def __init__(self, center: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.center, self.scale, self.weights = center, scale, weights

    def forward(self, x: np.ndarray, start: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["e"] + w["eb"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        s = (t * g) @ w["a"]
        s -= np.repeat(np.maximum.reduceat(s, start), counts)
        s = np.exp(s)
        s /= np.repeat(np.add.reduceat(s, start), counts)
        z = np.add.reduceat(h * s[:, None], start)
        return {"h": h, "t": t, "g": g, "s": s, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["cb"], -30, 30)))}

    def gradient(self, x: np.ndarray, start: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean cross-entropy of the bags' labels y by each weight."""
        w, f = self.weights, self.forward(x, start, counts)
        d = ((f["p"] - y) / len(y)).astype(x.dtype)
        grad = {"c": f["z"].T @ d, "cb": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * w["c"], counts, axis=0)
        ds = (dz * f["h"]).sum(axis=1)
        ds = f["s"] * (ds - np.repeat(np.add.reduceat(f["s"] * ds, start), counts))
        grad["a"] = (f["t"] * f["g"]).T @ ds
        dt, dg = ds[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        grad["v"], grad["u"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (dz * f["s"][:, None] + dt @ w["v"].T + dg @ w["u"].T) * (1 - f["h"] ** 2)
        grad["e"], grad["eb"] = x.T @ dh, dh.sum(axis=0)
        return grad

    def score(self, texts: list[str]) -> np.ndarray:
        data, begin, counts = passages(texts)
        if not len(texts):
            return np.zeros(0)
        x = (describe(data, begin) - self.center) / self.scale
        return self.forward(x, np.cumsum(counts) - counts, counts)["p"]


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """A model from labelled texts, each label of equal weight to its texts; None if a label has none."""
    rows = sorted(rows)
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    data, begin, counts = passages([t for t, _ in rows])
    x = describe(data, begin)
    start = np.cumsum(counts) - counts
    center, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    x = ((x - center) / scale).astype(np.float32)
    random = np.random.default_rng(1)
    shapes = {"e": (FEATURES, CODE), "eb": (CODE,), "v": (CODE, GATE), "u": (CODE, GATE), "a": (GATE,), "c": (CODE,), "cb": (1,)}
    w = {k: random.normal(0, 0.3, s).astype(np.float32) if k not in ("eb", "cb") else np.zeros(s, np.float32) for k, s in shapes.items()}
    model = Model(center, scale, w)
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, ROUNDS + 1):
        grad = model.gradient(x, start, counts, y)
        for k in w:
            g = grad[k] + RIDGE * w[k]
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            w[k] -= RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def score_quality(documents: DataFrame, labels: DataFrame, folds: int = 4, left_out: int = 2, most: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of documents, from all passages of its whole text.

    Fitted on the driver to at most `most` texts of either label whose crc32 of the id mod `folds` is not left_out;
    held_out marks the others, and rows without an id. Null and empty texts are one empty passage. Without labelled
    texts of both kinds all scores are 1, so that nothing is rejected.
    """
    model = fit(labelled_sample(documents, labels, "quality", folds, left_out, most))
    scored = apply(documents.select("doc_id", "text"), model).withColumnRenamed("_quality", "score")
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == left_out, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def apply(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents, all columns, with the score of `text` added as _quality; a column of that name is replaced."""
    documents = documents.drop("_quality")
    shared, token = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = documents.columns.index("text")
    names = [*documents.columns, "_quality"]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        p = once_a_worker(token, lambda: shared.value).score(texts) if shared.value is not None else np.ones(len(texts))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names)

    schema = StructType([*documents.schema.fields, StructField("_quality", DoubleType())])
    return map_texts(documents, "text", fn, schema)

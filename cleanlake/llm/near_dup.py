"""Near-duplicates by SetSketch registers: banded for candidates, estimated jointly by likelihood, verified on full sets.

A document's set is that of its shingles' hashes. Every element throws points on REGISTERS registers, exponentially
spaced, and a register keeps the least point that fell on it, on a scale of powers of BASE. Registers of two sets merge
by their minimum to those of the union, and agree about as often as the sets do. Documents of equal sets are one class.
Classes that agree in all registers of a band may be linked; they are gathered in clusters, in which pairs are told
apart by the likelihood of their registers alone, 512 bytes a class. The pairs that may reach the threshold make groups;
of these, and no others, the full sets are worked out. Each class is first compared with the likeliest class before it, a
number of comparisons in proportion to the classes, which joins nearly all there is to join. Groups that are in several
parts still are then compared part with part, pair by pair, the likeliest first, as long as they are not joined yet.
A large cluster or group is worked on in pairs of blocks, bounded in classes and bytes, each by another task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, small_enough
from .components import Forest, components, sorted_groups
from .hashing import mix64

#: Registers; base and rate of their scale.
REGISTERS, BASE, RATE = 256, 1.001, 20.0
#: The chance with which a pair at the threshold may escape all bands; how many of its standard errors below the
#: threshold an estimate may be; classes of a block, and bytes of their sets.
ESCAPE, ERRORS, BLOCK, BLOCK_BYTES = 3e-6, 5, 64, 4 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's shingles, joined, and each text's number of them."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"".join(c + b"\n" for c in coded), np.uint8)]
    ends = np.cumsum([len(c) + 1 for c in coded])
    inside = ~_GAP[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = np.flatnonzero(first)
    counts = np.zeros(len(texts), np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), counts
    place = np.arange(len(data)) - at[np.maximum(np.cumsum(first) - 1, 0)]
    power = np.cumprod(np.full(int(np.where(inside, place, 0).max()) + 1, _P, np.uint64))
    value = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * power[np.where(inside, place, 0)], np.uint64(0))
    word = mix64(np.add.reduceat(value, at))
    doc = np.searchsorted(ends, at, side="right")
    per = np.bincount(doc, minlength=len(texts))
    n = len(word) - width + 1
    h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * _Q + word[k : n + k]
        whole = doc[:n] == doc[width - 1 :]
        h, of = h[whole], doc[:n][whole]
    for i in np.flatnonzero((per > 0) & (per < width)):
        x, s = np.uint64(per[i]), int(np.searchsorted(doc, i))
        for w in word[s : s + per[i]]:
            with np.errstate(over="ignore"):
                x = x * _P + w
        h, of = np.append(h, x), np.append(of, i)
    h = mix64(h)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(texts))


def sketch(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[set, register] levels of sets that are joined in flat; empty sets have zeros.

    An element's points are those of a Poisson process of rate REGISTERS * RATE, each on a random register, so that a
    register's least point is exponential with rate RATE times the set's size. Points are thrown, more in each round,
    until they lie beyond all least points of the set.
    """
    n, m = len(counts), REGISTERS
    least = np.full(n * m, np.inf)
    of = np.repeat(np.arange(n), counts)
    seed, reach, live, step, done = flat.copy(), np.zeros(len(flat)), np.arange(len(flat)), 1, 0
    while len(live):
        x, s, o = reach[live], seed[live], of[live]
        for k in range(step):
            r = mix64(s + np.uint64((done + k + 1) * int(_P) % 2**64))
            x = x - np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / (m * RATE)
            np.minimum.at(least, o * m + (mix64(r) >> np.uint64(56)).astype(np.int64), x)
        reach[live] = x
        done += step
        step = min(32, step * 2)
        limit = least.reshape(n, m).max(axis=1)
        live = live[x < limit[o]]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least) / np.log(BASE))
    return np.where(np.isfinite(level), np.clip(level, 0, 65535), 0).astype(np.uint16).reshape(n, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The levels of the union of the sets whose levels are a and b."""
    return np.maximum(a, b)


def banding(percent: int) -> tuple[int, int]:
    """Bands and the registers of each: as many registers as ESCAPE allows at the threshold (36 of 7 at 85, 42 of 6 at 80)."""
    rows = max(r for r in range(1, 65) if r == 1 or (1 - (percent / 100) ** r) ** (REGISTERS // r) <= ESCAPE)
    return REGISTERS // rows, rows


def band_hashes(levels: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[set, band]: a hash of the band's number and levels."""
    x = levels[:, : bands * rows].reshape(len(levels), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), x.shape[:2]).copy()
    for k in range(rows):
        h = mix64(h * _Q + x[:, :, k])
    return h


def joint_estimate(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of sets of n_a and n_b elements with `more` and `less` registers higher and lower."""
    equal = REGISTERS - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + equal * np.log(np.maximum(1e-12, 1 - a - b))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # it has one peak
        left, right = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(left) < likelihood(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def likely(sizes: np.ndarray, levels: np.ndarray, part: np.ndarray, percent: int) -> tuple[list[int], list[int], list[float]]:
    """The pairs of rows of different parts whose sets may overlap by percent, by size and likelihood, and their estimates."""
    ones, twos, rate = [], [], []
    floor = percent / 100 - ERRORS * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
    for i in range(len(sizes) - 1):
        j = np.arange(i + 1, len(sizes))
        j = j[(100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])) & (part[j] != part[i])]
        if not len(j):
            continue
        j = j[(levels[j] == levels[i]).sum(axis=1) >= (floor - 0.04) * REGISTERS]
        if len(j):
            more, less = (levels[i] > levels[j]).sum(axis=1), (levels[i] < levels[j]).sum(axis=1)
            got = joint_estimate(more, less, np.full(len(j), sizes[i], float), sizes[j].astype(float))
            j, got = j[got >= floor], got[got >= floor]
            ones += [i] * len(j)
            twos += j.tolist()
            rate += got.tolist()
    return ones, twos, rate


def overlap(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def joins(pairs: tuple[list[int], list[int], list[float]], parts: np.ndarray, holds: Callable[[int, int], bool]) -> list[int]:
    """The numbers of the pairs that join parts not joined yet, the likeliest first, of those for which `holds`."""
    ones, twos, rate = pairs
    forest, out = Forest(), []
    for k in np.argsort(-np.array(rate), kind="stable").tolist():
        x, y = int(parts[ones[k]]), int(parts[twos[k]])
        if forest.root(x) != forest.root(y) and holds(ones[k], twos[k]):
            forest.join(x, y)
            out.append(k)
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def pairs_of(ids: np.ndarray, pairs: list[tuple[int, int]], rate: list[float]) -> pa.RecordBatch | None:
    """hi, lo, rate of pairs of places in ids."""
    if not pairs:
        return None
    at = ids[np.array(pairs)]
    return pa.RecordBatch.from_arrays([pa.array(at.max(axis=1)), pa.array(at.min(axis=1)), pa.array(rate, pa.float64())], ["hi", "lo", "rate"])


def in_blocks(rows: DataFrame, key: str, fn: Callable[[pa.Table, bool], pa.RecordBatch | None]) -> DataFrame:
    """hi, lo, rate: fn on every pair of blocks of rows (key, class, n, data, part) that share a key, and on every block by itself.

    fn gets the rows of both blocks, with their block's number, and whether these are two. Blocks hold BLOCK classes and
    BLOCK_BYTES, by a hash of the class.
    """
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("data")) / BLOCK_BYTES))
    blocks = cut(rows.groupBy(key).agg(F.count("*").alias("k"), size.cast("int").alias("blocks")).where("k > 1").drop("k"))
    placed = rows.join(small_enough(blocks, 12), key).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    keys = [key, "one", "two"]
    spark = rows.sparkSession  # a fixed number of tasks: a pair of blocks costs far more time than its bytes suggest
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = dealt.select(*keys, "block", "class", "n", "part", "data").repartition(tasks, *keys).sortWithinPartitions(*keys, "class")

    def run(batches):
        for t in sorted_groups(batches, 3):
            if t.num_rows > 1 and (got := fn(t, t.column("one")[0] != t.column("two")[0])) is not None:
                yield got

    return dealt.mapInArrow(run, "hi long, lo long, rate double")


def digests(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words that stand for each set."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for x in (flat, mix64(flat ^ _Q)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        out.append(mix64(total[ends[1:]] - total[ends[:-1]]))
    return out[0], out[1]


def with_roots(found: DataFrame) -> DataFrame:
    """class, component of components()' result, with the least of each component too."""
    return found.select(F.col("node").alias("class"), "component").union(found.select("component", "component").distinct())


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of documents, as linked_rows() finds them."""
    return linked_rows(documents, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def linked_rows(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, group, component_id, kept: a row for each row of documents.

    Words are runs of what is no ASCII blank, A-Z lower-cased; a set holds the distinct shingles of `width` words, or
    the whole sequence if it is shorter. Rows whose sets overlap by `percent` of their union are linked; group numbers
    what can be reached (null for what is linked with nothing by rule) and the component is the smallest id in it. Texts
    without words, and rows without an id, are linked with nothing (without an id, component_id is null and the row is
    kept). Rows that share an id need not be alike: each is linked by its own set, and an id does not join the groups
    of its rows, so that a row is kept, or some row of its group is. A pair at the threshold escapes all bands with a
    chance of ESCAPE, and less if it is more alike.
    """

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, counts = shingle_sets([t or "" for t in batch.column(1).to_pylist()], width)
        d1, d2 = digests(flat, counts)
        levels = sketch(flat, counts)
        binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((np.arange(len(counts) + 1) * 2 * REGISTERS).astype(np.int32)), pa.py_buffer(levels)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), _long(d1), _long(d2), binary, batch.column(2)], ["doc_id", "n", "d1", "d2", "levels", "text_hash"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    known = cut(map_texts(texts, "text", first, "doc_id long, n long, d1 long, d2 long, levels binary, text_hash long"))
    set_key = ["n", "d1", "d2"]
    full = known.where("n > 0 and doc_id is not null")
    # a class is a number, not an id: several classes may have their least row in one id
    classes = full.groupBy(*set_key).agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("class"), *set_key, F.col("row.doc_id").alias("least"), F.col("row.text_hash").alias("least_hash")))
    same_row = lambda of, rows: (of["least"] == rows["doc_id"]) & (of["least_hash"] == rows["text_hash"])
    heads = cut(classes.join(full, same_row(classes, full) & (classes["d1"] == full["d1"]) & (classes["d2"] == full["d2"])).select("class", "levels"))

    bands, size = banding(percent)

    def hashed(batches):
        for batch in batches:
            levels = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            yield pa.RecordBatch.from_arrays([_long(band_hashes(levels, bands, size).ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), bands))], ["band", "class"])

    banded = heads.mapInArrow(hashed, "band long, class long")
    shared = cut(banded.groupBy("band").agg(F.count("*").alias("k"), F.min("class").alias("head")).where("k > 1").select("band", "head"))
    near = banded.join(small_enough(shared, 16), "band").where("class <> head").select(F.col("class").alias("hi"), F.col("head").alias("lo")).distinct()
    clustered = cut(with_roots(components(near)).withColumnRenamed("component", "cluster").join(heads, "class").join(classes.select("class", "n"), "class"))

    def maybe(t: pa.Table, cross: bool) -> pa.RecordBatch | None:
        ids, levels = t.column("class").to_numpy(), np.stack([np.frombuffer(x, np.uint16) for x in t.column("data").to_pylist()])
        block = t.column("block").to_numpy()
        found = likely(t.column("n").to_numpy(), levels, block if cross else np.arange(len(ids)), percent)
        keep = joins(found, np.arange(len(ids)), lambda i, j: True)
        return pairs_of(ids, [(found[0][k], found[1][k]) for k in keep], [found[2][k] for k in keep])

    # what may be linked, as trees of each pair of blocks: all that is likely is connected in them
    trees = in_blocks(clustered.select("cluster", "class", "n", F.col("levels").alias("data"), F.lit(0).cast("long").alias("part")), "cluster", maybe)
    trees = cut(trees)
    groups = cut(with_roots(components(trees.select("hi", "lo"))).withColumnRenamed("component", "cluster"))
    members = groups.join(classes, "class")

    def again(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, counts = shingle_sets([t or "" for t in batch.column(0).to_pylist()], width)
        levels, ends = sketch(flat, counts), np.concatenate([[0], np.cumsum(counts)])
        data = pa.array([levels[i].tobytes() + flat[ends[i] : ends[i + 1]].tobytes() for i in range(len(counts))], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(counts), data], ["class", "cluster", "n", "data"])

    rows = texts.join(small_enough(cut(members), 80), same_row(members, texts)).select("text", "class", "cluster").dropDuplicates(["class"])  # an id's repeated rows count once
    sets = cut(map_texts(rows, "text", again, "class long, cluster long, n long, data binary"))

    # each class with the likeliest one before it
    first = trees.groupBy("hi").agg(F.max(F.struct("rate", F.col("lo"))).alias("best")).select("hi", F.col("best.lo").alias("lo"))
    two = first.join(sets.select(F.col("class").alias("hi"), F.col("data").alias("a")), "hi").join(sets.select(F.col("class").alias("lo"), F.col("data").alias("b")), "lo").select("hi", "lo", "a", "b")

    def compare(batches):
        read = lambda x: np.frombuffer(x.as_py(), np.uint64, offset=2 * REGISTERS)
        for batch in batches:
            hit = [overlap(read(a), read(b), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["hi", "lo"]).filter(pa.array(hit, pa.bool_()))

    sure = cut(two.mapInArrow(compare, "hi long, lo long"))
    parts = cut(with_roots(components(sure)).withColumnRenamed("component", "part"))
    placed = groups.join(small_enough(parts, 16), "class", "left").withColumn("part", F.coalesce("part", "class"))
    several = placed.groupBy("cluster").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("cluster")
    open_ones = cut(placed.join(small_enough(cut(several), 8), "cluster", "left_semi").select("class", "part"))

    def verify(t: pa.Table, cross: bool) -> pa.RecordBatch | None:
        ids, part, block = (t.column(c).to_numpy() for c in ("class", "part", "block"))
        raw = t.column("data").to_pylist()
        levels, own = np.stack([np.frombuffer(x, np.uint16, REGISTERS) for x in raw]), [np.frombuffer(x, np.uint64, offset=2 * REGISTERS) for x in raw]
        found = likely(t.column("n").to_numpy(), levels, part, percent)
        if cross:
            keep = [k for k in range(len(found[0])) if block[found[0][k]] != block[found[1][k]]]
            found = tuple([x[k] for k in keep] for x in found)
        keep = joins(found, part, lambda i, j: overlap(own[i], own[j], percent))
        return pairs_of(ids, [(found[0][k], found[1][k]) for k in keep], [found[2][k] for k in keep])

    rest = in_blocks(sets.join(small_enough(open_ones, 16), "class"), "cluster", verify)
    links = cut(sure.union(rest.select("hi", "lo")))
    linked = cut(with_roots(components(links)).join(classes.select("class", "least"), "class"))
    names = cut(linked.groupBy("component").agg(F.min("least").alias("name")))
    linked = cut(linked.select("class", "component").join(small_enough(names, 16), "component"))
    of_class = classes.join(small_enough(linked, 24), "class", "left").select(*set_key, F.coalesce("component", "class").alias("group"), F.coalesce("name", "least").alias("name"))
    rows = known.select("doc_id", "text_hash", *set_key).withColumn("at", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("n")))
    of_class = small_enough(cut(of_class.withColumnRenamed("n", "at")), 40)
    out = rows.join(of_class, ["at", "d1", "d2"], "left").withColumn("component_id", F.coalesce("name", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "group", "component_id", kept.alias("kept"))

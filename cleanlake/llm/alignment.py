"""Tokens of two tokenizers aligned with each other: least groups of equal bytes, links, and how often ids are linked.

Each text is encoded by a byte-level tokenizer (A) and a sentencepiece one (B). Tokens whose bytes overlap are joined in a
bipartite graph; its connected components, found by union-find over all texts of a batch at once, are the least groups of
tokens that cover the same bytes. In a component the tokens of A and B that end together are linked.

Texts are encoded once; ids, with a mark where a group ends, are kept packed in a checkpoint. Tasks count pairs of linked ids
before the shuffle. Back at the texts, the LOOKED_UP most frequent pairs, whose number arithmetic bounds, are looked up in
the tasks, so that no pair is a hot key; only links of rarer pairs are shuffled to their counts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, once_a_worker
from .splice import CHUNK, OVERLAP, encode_long, larger
from .token_counts import JsonTokenizer

#: Pairs that tasks look up, at 16 bytes each.
LOOKED_UP = 1 << 20
#: Pairs that a task counts before it passes them on.
COUNTED = 1 << 19
#: An id pair is a's id times 2**B_BITS, and b's.
B_BITS = 24
#: The bit of a packed id that says that its group ends with it.
LAST = 1 << 30
#: Bytes of packed ids that are unpacked at once.
UNPACKED = 1 << 20


class PieceIds:
    """A sentencepiece model as ids and their bytes; the model puts a blank before a text."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.own = own = SentencePieceProcessor(model_proto=model)
        byte = lambda i: bytes([int(own.id_to_piece(i)[3:5], 16)])
        self.bytes = [byte(i) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    def encode_chunk(self, data: bytes) -> tuple[np.ndarray, int]:
        blank = data[:1] == b" "
        return np.array(self.own.encode(data[blank:].decode()), np.int64), 0 if blank else 1

    def ids(self, texts: list[str], chunk: int, overlap: int) -> list[np.ndarray]:
        huge = [larger(t, chunk) for t in texts]
        short = iter(self.own.encode([t for t, h in zip(texts, huge, strict=True) if not h], num_threads=1))
        return [self.long(t, chunk, overlap) if h else np.array(next(short), np.int64) for t, h in zip(texts, huge, strict=True)]

    def long(self, text: str, chunk: int, overlap: int) -> np.ndarray:
        """The ids of a long text, by chunks if these hold its bytes; else (the model rewrites it) of the whole."""
        data = b" " + text.encode()
        ids = encode_long(data, self.encode_chunk, self.size, chunk, overlap)
        return ids if joined(ids, self.bytes) == data else np.array(self.own.encode(text), np.int64)


def joined(ids: np.ndarray, words: list[bytes]) -> bytes:
    return b"".join(map(words.__getitem__, ids.tolist()))


def roots(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is joined with by the edges one-two: union by hooking the larger of two roots to
    the smaller, for all edges at once, and finding with all paths halved until they are flat."""
    parent = np.arange(n)
    while len(one):
        a, b = parent[one], parent[two]
        open_ = a != b
        one, two, a, b = one[open_], two[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while len(one) and not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def overlaps(ends_a: np.ndarray, size_a: np.ndarray, ends_b: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of tokens whose byte ranges overlap; at most as many as tokens."""
    first = np.searchsorted(ends_b, ends_a - size_a, side="right")
    many = np.searchsorted(ends_b - size_b, ends_a, side="left") - first
    one = np.repeat(np.arange(len(ends_a)), many)
    return one, np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(one))


def group_ends(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B, whether it is the last of its group; both cover the same bytes."""
    sa, sb = size_a[ids_a], size_b[ids_b]
    na, nb = len(sa), len(sb)
    one, two = overlaps(np.cumsum(sa), sa, np.cumsum(sb), sb)
    group = roots(na + nb, one, two + na)
    last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
    return last(group[:na]), last(group[na:])


def packed(ids: np.ndarray) -> bytes:
    """Compressed 32-bit words, the like bytes of all together."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(ids) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


@functools.cache
def _names(bits: int) -> list[np.ndarray]:
    """The ids below 2**bits as text after `,`, `;` and `|`."""
    return [np.array([f"{s}{i}" for i in range(1 << bits)], object) for s in ",;|"]


class Unpacked:
    """The ids of all rows of a batch (.., n_a, n_b, ids): those of A and of B, joined, and where groups end."""

    def __init__(self, batch: pa.RecordBatch):
        self.n_a, self.n_b = (np.asarray(batch.column(c), np.int64) for c in ("n_a", "n_b"))
        rows = [unpacked(data, int(n)) for data, n in zip(batch.column("ids").to_pylist(), self.n_a + self.n_b, strict=True)]
        none = np.zeros(0, np.int64)
        a = np.concatenate([none, *(r[:n] for r, n in zip(rows, self.n_a, strict=True))])
        b = np.concatenate([none, *(r[n:] for r, n in zip(rows, self.n_a, strict=True))])
        self.last_a, self.last_b = (a & LAST) != 0, (b & LAST) != 0
        self.a, self.b = a & ~LAST, b & ~LAST
        #: The last tokens of a group end together, and no others do.
        self.pairs = self.a[self.last_a] << B_BITS | self.b[self.last_b]
        ends = np.cumsum(self.last_a)
        self.links = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.n_a)])])

    def written(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each row, the ids in order."""
        starts = lambda last, n: np.concatenate([[True], last[:-1]]) if n else last
        first_a, first_b = starts(self.last_a, len(self.a)), starts(self.last_b, len(self.b))
        group_a, group_b = np.cumsum(first_a) - 1, np.cumsum(first_b) - 1
        before_b = np.concatenate([[0], np.flatnonzero(self.last_b) + 1])[group_a]  # tokens of B in earlier groups
        through_a = (np.flatnonzero(self.last_a) + 1)[group_b] if len(group_b) else group_b
        out = np.empty(len(self.a) + len(self.b), object)
        if len(out):
            comma, semi, bar = _names(int(max(self.a.max(initial=0), self.b.max(initial=0))).bit_length())
            out[np.arange(len(self.a)) + before_b] = np.where(first_a, semi[self.a], comma[self.a])
            out[np.arange(len(self.b)) + through_a] = np.where(first_b, bar[self.b], comma[self.b])
        at = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return ["".join(out[s:e].tolist())[1:] for s, e in zip(at, at[1:], strict=False)]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about UNPACKED bytes of packed ids."""
    for batch in batches:
        size = np.array([len(x) for x in batch.column("ids").to_pylist()], np.int64)
        part = np.cumsum(size) // UNPACKED
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                yield batch.slice(s, e - s)


def encode_both(documents: DataFrame, path_a: str, path_b: str, key: str, text: str, chunk: int, overlap: int) -> DataFrame:
    """row, key, n_a, n_b, ids: both encodings of each text, packed, with the ends of groups marked; none where they hold other bytes."""
    sc = documents.sparkSession.sparkContext
    one, two = sc.broadcast(Path(path_a).read_bytes()), sc.broadcast(Path(path_b).read_bytes())
    token = hashlib.sha256(hashlib.sha256(one.value).digest() + hashlib.sha256(two.value).digest()).hexdigest()

    def both() -> tuple[JsonTokenizer, PieceIds]:
        a = JsonTokenizer(one.value.decode(), special=False)
        if not a.chunks:
            raise ValueError("the first tokenizer must be a byte-level one")
        return a, PieceIds(two.value)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = once_a_worker(f"{token}:aligned", both)
        texts = batch.column(2).to_pylist()
        some = [i for i, t in enumerate(texts) if t]
        spaced = [f" {texts[i]}" for i in some]
        rows_a, rows_b, kept = a.ids(spaced, chunk, overlap), b.ids([texts[i] for i in some], chunk, overlap), []
        for i, t, x, y in zip(some, spaced, rows_a, rows_b, strict=True):
            data = t.encode()
            if (a.lossless or joined(x, a.bytes) == data) and joined(y, b.bytes) == data:
                kept.append((i, x, y))
        n_a, n_b, ids = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [b""] * len(texts)
        if kept:
            flat_a, flat_b = np.concatenate([x for _, x, _ in kept]), np.concatenate([y for _, _, y in kept])
            last_a, last_b = group_ends(flat_a, flat_b, a.size, b.size)
            flat_a, flat_b, s, u = flat_a | last_a * LAST, flat_b | last_b * LAST, 0, 0
            for i, x, y in kept:
                n_a[i], n_b[i] = len(x), len(y)
                ids[i] = packed(np.concatenate([flat_a[s : s + len(x)], flat_b[u : u + len(y)]]))
                s, u = s + len(x), u + len(y)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_a), pa.array(n_b), pa.array(ids, pa.binary())], ["row", "key", "n_a", "n_b", "ids"])

    rows = documents.select(F.monotonically_increasing_id().alias("row"), documents[key].alias("key"), documents[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return map_texts(rows, "text", fn, f"row long, key {kind}, n_a long, n_b long, ids binary")


def pair_counts(encoded: DataFrame, held: int = COUNTED) -> DataFrame:
    """pair, n, best: how many links of all texts hold each pair of ids linked, and whether that is the most of its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
        for part in slices(batches):
            new, n = np.unique(Unpacked(part).pairs, return_counts=True)
            both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, counts = both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            if len(keys) > held:
                yield out()
                keys, counts = keys[:0], counts[:0]
        yield out()

    counts = cut(encoded.select("n_a", "n_b", "ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair") % (1 << B_BITS)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(documents: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", looked_up: int = LOOKED_UP, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: each whole text's tokens of A and B, aligned.

    A (path_a, byte-level .json) encodes a blank and the text, B (path_b, .model) the text, before which it puts a blank;
    strings of special tokens are plain text. groups is `a1,a2|b1;a3|b2,b3`: the ids of each least group of tokens that
    cover the same bytes, in order. A link joins two tokens that end together; n_best counts links whose pair of ids is, in all
    texts, as frequent as any pair of that B id; count_sum adds the counts of the links' pairs. Texts that are null or
    empty, or that A or B does not encode byte for byte, have zeros and an empty string. A row out for each row in,
    repeated and null keys too; other columns are not read.
    """
    encoded = cut(encode_both(documents, path_a, path_b, key, text, chunk, overlap))
    counts = cut(pair_counts(encoded))
    frequent = counts
    if rare := counts.count() > looked_up:
        least = -(-int(counts.agg(F.sum("n")).first()[0]) // looked_up)
        frequent = counts.where(F.col("n") >= least)  # no more than looked_up pairs can have so many links
    found = frequent.orderBy("pair").toArrow()
    table = documents.sparkSession.sparkContext.broadcast(tuple(np.asarray(found.column(c).combine_chunks() if c != "best" else found.column(c).cast(pa.int8()).combine_chunks()) for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        for part in slices(batches):
            own = Unpacked(part)
            at = np.searchsorted(pairs, own.pairs).clip(max=max(len(pairs) - 1, 0))
            known = pairs[at] == own.pairs if len(pairs) else np.zeros(len(own.pairs), bool)
            some = at[known] if len(pairs) else at[:0]
            owner = np.repeat(np.arange(part.num_rows), own.links)
            total = lambda values: np.bincount(owner[known], values, part.num_rows).astype(np.int64)  # noqa: B023, E731
            sums = np.zeros(part.num_rows, np.int64)
            np.add.at(sums, owner[known], n[some])
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=part.num_rows))]).astype(np.int32)), pa.array(own.pairs[~known]))
            more = [pa.array(own.links), pa.array(total(best[some])), pa.array(sums), pa.array(own.written(), pa.string()), rest]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), *more], ["row", "key", "n_a", "n_b", "n_links", "n_best", "count_sum", "groups", "rest"])

    kind = encoded.schema["key"].dataType.simpleString()
    rows = encoded.mapInArrow(run, f"row long, key {kind}, n_a long, n_b long, n_links long, n_best long, count_sum long, groups string, rest array<long>")
    if rare:
        links = rows.select("row", F.explode("rest").alias("pair"))
        late = links.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("b"), F.sum("n").alias("s"))
        rows = rows.join(late, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))})
    return rows.select(F.col("key").alias(key), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups")

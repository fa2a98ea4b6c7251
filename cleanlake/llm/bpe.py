"""Byte-level BPE encoding and decoding with a public rank vocabulary.

A text is split by the vocabulary's pattern; the pieces not met before are merged together, in matrices: pieces of
like length form the padded rows of one matrix, and in each round every row merges its leftmost pair of minimum rank,
found by a hashed lookup of pairs, and closes the gap. A piece longer than LONGEST bytes is a matrix of one row, which in
a round merges all its pairs of minimum rank, from the left, where that gives what one after the other would give, and
closes its gaps when half of it is gone.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_texts
from .hashing import HashTable

#: Widths of the matrices; the last one is the longest piece, in bytes, that goes into a matrix.
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64, 128)
LONGEST = WIDTHS[-1]
#: Cells of a matrix.
CELLS = 1 << 18
#: Pieces looked up at once.
PIECES = 1 << 15
#: Distinct pieces that a Python worker remembers as young; then these are the old ones, of which those met again stay.
REMEMBERED = 100_000
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's byte strings in the order of their ranks, from a file with a base64 string and a rank a line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    words = [b""] * len(pairs)
    for word, rank in pairs:
        words[int(rank)] = base64.b64decode(word)
    return words


class Vocabulary:
    def __init__(self, words: list[bytes]):
        self.words = words
        self.rank = {w: i for i, w in enumerate(words)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for i, w in enumerate(words):
            for k in range(1, len(w)):
                a, b = self.rank.get(w[:k]), self.rank.get(w[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        self.pairs = HashTable(np.array(keys, np.uint64), np.array(values, np.int32))
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = np.frombuffer(b"".join(words), np.uint8)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the joined pair; NONE if it is none or a cell is empty."""
        got = self.pairs.get(np.where((a < 0) | (b < 0), np.int64(-1), a.astype(np.int64) << 32 | b).astype(np.uint64))
        return np.where(got < 0, NONE, got)

    def merge_matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of at most width bytes, joined, and each piece's number of ids."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.pair_rank(ids[:, :-1], ids[:, 1:])
        rows, done, column = np.arange(n), ids.copy(), np.arange(width)
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                done[rows[over], :width], done[rows[over], width:] = ids[over], -1
                go = ~over
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            take = np.minimum(column + (column > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            ids[:, -1], rank[:, -1] = -1, NONE
            ids[each, at] = best
            after = np.minimum(at + 1, width - 1)
            rank[each, at] = np.where(at + 1 < width, self.pair_rank(best, ids[each, after]), NONE)
            some = at > 0
            before = at[some] - 1
            rank[each[some], before] = self.pair_rank(ids[each[some], before], best[some])
            longest = int((ids >= 0).sum(axis=1).max())
            if longest <= width // 2 and width > 4:  # compaction: fewer columns, once the rows are short enough
                width = max(4, longest)
                ids, rank, column = ids[:, :width].copy(), rank[:, :width].copy(), np.arange(width)
                rank[:, -1] = NONE
        full = done >= 0
        return done[full], full.sum(axis=1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The ids of one piece. All pairs of minimum rank merge in a round if no pair that this makes has that rank or less."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        while True:
            n = len(ids)
            after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: none
            rank = np.append(self.pair_rank(ids[:-1], ids[1:]), NONE)
            live = n
            while (best := rank.min()) != NONE and live > n // 2:
                at = np.flatnonzero(rank == best)
                if len(at) > 1:  # a run of such pairs that share an element: every other one
                    first = np.concatenate([[True], after[at[:-1]] != at[1:]])
                    run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
                made = self.merged_ranks(ids, before, after, at, best)
                if len(at) > 1 and min(x.min() for x in made) <= best:
                    at = at[:1]
                    made = self.merged_ranks(ids, before, after, at, best)
                gone, left = after[at], before[at]
                ids[at], rank[gone], ids[gone] = best, NONE, -1
                after[at] = after[gone]
                some = after[at] < n
                before[after[at[some]]] = at[some]
                rank[at] = made[1]
                there = (left >= 0) & (ids[left] >= 0)  # else that pair is the right one of the place before
                rank[left[there]] = made[0][there]
                live -= len(at)
            ids = ids[ids >= 0]
            if best == NONE:
                return ids

    def merged_ranks(self, ids: np.ndarray, before: np.ndarray, after: np.ndarray, at: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of the pairs to the left and to the right of each place where two elements become `best`."""
        new = ids.copy() if len(at) > 1 else ids
        if len(at) > 1:
            new[at] = best
        left, right = before[at], after[after[at].clip(max=len(ids) - 1)]
        a = np.where(left >= 0, new[left], -1)
        beyond = (after[at] >= len(ids)) | (right >= len(ids))
        b = np.where(beyond, -1, new[right.clip(max=len(ids) - 1)])
        if len(at) > 1:  # a neighbour that is merged away in the same round reads as what it becomes
            dead = np.zeros(len(ids), bool)
            dead[after[at]] = True
            a = np.where((left >= 0) & dead[left], best, a)
        each = np.full(len(at), best)
        return self.pair_rank(a, each), self.pair_rank(each, b)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all pieces, joined in some order; for each piece, where its ids start and how many they are."""
        at, groups = {}, [([], [], [])]
        for i, p in enumerate(pieces):
            whole = self.rank.get(p)
            if whole is not None or len(p) > LONGEST:
                groups[0][0].append(i)
                got = np.array([whole], np.int32) if whole is not None else self.merge_long(p)
                groups[0][1].append(got)
                groups[0][2].append(len(got))
            else:
                at.setdefault(next(w for w in WIDTHS if len(p) <= w), []).append(i)
        for width, members in at.items():
            for s in range(0, len(members), CELLS // width):
                part = members[s : s + CELLS // width]
                flat, size = self.merge_matrix([pieces[i] for i in part], width)
                groups.append((part, [flat], size))
        order = np.concatenate([np.asarray(g[0], np.int64) for g in groups])
        flat = np.concatenate([np.zeros(0, np.int32), *(x for g in groups for x in g[1])])
        sizes = np.concatenate([np.asarray(g[2], np.int64) for g in groups])
        size, start = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        size[order], start[order] = sizes, np.cumsum(sizes) - sizes
        return flat, start, size

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, joined, and each id's number of bytes."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)], size


class Pieces:
    """Pieces with their ids, in one flat array."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.size, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, pieces: list[str], flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + start])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def get(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


class Encoder:
    """A vocabulary, its pattern and the pieces met lately: those since the young ones were too many, and those before."""

    def __init__(self, words: list[bytes], pattern: str):
        self.vocabulary, self.pattern = Vocabulary(words), regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.young, self.old = Pieces(), Pieces()

    def look_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, joined, and each piece's number of ids."""
        distinct = set(pieces)
        new = distinct.difference(self.young.known)
        if len(self.young.known) + len(new) > REMEMBERED:
            self.young, self.old, new = Pieces(), self.young, distinct
        if new:
            met = sorted(new.intersection(self.old.known))
            if met:
                ids, size = self.old.get(met)
                self.young.add(met, ids, np.cumsum(size) - size, size)
            fresh = sorted(new.difference(self.old.known))
            if fresh:
                self.young.add(fresh, *self.vocabulary.encode([p.encode("utf-8", "surrogatepass") for p in fresh]))
        return self.young.get(pieces)

    def split(self, text: str) -> Iterator[list[str]]:
        """The pieces of text, in lists; of a long text in lists of PIECES."""
        if len(text) <= PIECES:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while some := [m.group() for m in itertools.islice(found, PIECES)]:
            yield some

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and each text's number of ids; about PIECES pieces are held at once."""
        counts, flat = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        pieces: list[str] = []
        owners: list[int] = []
        per: list[int] = []

        def look_up() -> None:
            ids, size = self.look_up(pieces)
            flat.append(ids)
            np.add.at(counts, np.repeat(owners, per), size)
            pieces.clear(), owners.clear(), per.clear()

        for i, t in enumerate(texts):
            for some in self.split(t) if t else ():
                pieces += some
                owners.append(i)
                per.append(len(some))
                if len(pieces) >= PIECES:
                    look_up()
        if pieces:
            look_up()
        return np.concatenate(flat), counts


@functools.lru_cache(maxsize=2)
def encoder(words: tuple[bytes, ...], pattern: str) -> Encoder:
    return Encoder(list(words), pattern)


@functools.lru_cache(maxsize=2)
def vocabulary(words: tuple[bytes, ...]) -> Vocabulary:
    return Vocabulary(list(words))


def _list(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def white_space(pattern: str) -> str:
    """The pattern with the Unicode property written out where \\s and \\S stand, as Python's \\s holds four more characters."""
    return pattern.replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")


def _bytes(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The bytes that each row's ids stand for."""
    data, size = vocabulary.decode(ids)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """key, ids array<int>: the ids of each row's whole text; none for a null or an empty text.

    A row out for each row in, repeated rows and null keys too; other columns are not read. `path` is a file on the
    driver with the vocabulary's ranks, of bounded size, which is broadcast; `pattern` splits a text into pieces. With
    decoded, the ids are decoded again in the same task, into bytes in a column of that name.
    """
    spark = documents.sparkSession
    words, split = spark.sparkContext.broadcast(tuple(read_ranks(path))), white_space(pattern)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(words.value, split)
        ids, sizes = own.encode([t or "" for t in batch.column(1).to_pylist()])
        more = [_bytes(own.vocabulary, ids, sizes)] if decoded else []
        return pa.RecordBatch.from_arrays([batch.column(0), _list(pa.array(ids), sizes), *more], ["key", "ids", "decoded"][: 2 + decoded])

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return map_texts(rows, "text", fn, f"key {kind}, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The rows of encoded, with the bytes that the ids stand for in a column `decoded`; no bytes for null or no ids."""
    spark = encoded.sparkSession
    words = spark.sparkContext.broadcast(tuple(read_ranks(path)))

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                lists = part.column(1)
                lists = lists.fill_null(pa.scalar([], lists.type)) if lists.null_count else lists
                voc = vocabulary(words.value)
                counts = np.asarray(pc.list_value_length(lists), np.int64)
                binary = _bytes(voc, np.asarray(lists.flatten(), np.int64), counts)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, binary], ["key", "ids", "decoded"])

    rows = encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded binary").withColumnsRenamed({"key": key, "ids": ids})

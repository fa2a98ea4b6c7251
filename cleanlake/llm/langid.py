"""Language of texts by unigram piece models over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary. The probability of a word is the sum, over all ways
to cut it into pieces, of the products of their probabilities; a forward pass over the word's characters gives it. The
pieces' probabilities are fitted by expectation-maximisation: expected counts from forward and backward sums.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SAMPLE_BYTES, cut, map_texts, once_a_worker, remainder, sampled_texts
from .hashing import HashTable

MARK = "▁"
#: Longest piece used; probability of a character that is no piece; weight of the pooled counts, in tokens.
PIECE_CHARS, UNKNOWN, POOLED = 16, 1e-8, 200.0
#: Training documents of a language, languages, and bytes of training texts of all languages, at most.
SAMPLE, LANGUAGES, TRAIN_BYTES = 400, 200, 64 << 20
#: Distinct words that a Python worker remembers; cells of a matrix.
REMEMBERED, CELLS = 400_000, 1 << 20
#: Characters of a block of a long word; cells of the matrices of blocks that are found at once.
BLOCK, BLOCK_CELLS = 512, 1 << 21
WORD = re.compile(r"[^\W\d_]+")


def usable_pieces(path: str) -> list[str]:
    """The pieces of a SentencePiece model that can stand in a marked word, in the model's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not skip(i))
    return [p for p in dict.fromkeys(pieces) if len(p) <= PIECE_CHARS and MARK not in p[1:]]


def substring_hashes(codes: np.ndarray):
    """For k = 1.. the hashes of all substrings of k characters of each row."""
    h = np.zeros(codes.shape, np.uint64)
    for k in range(1, min(PIECE_CHARS, codes.shape[1]) + 1):
        n = codes.shape[1] - k + 1
        h = h[:, :n] * np.uint64(0x9E3779B97F4A7C15) + codes[:, k - 1 :].astype(np.uint64) + np.uint64(1)
        yield h ^ np.uint64(k << 56)


class Lattice:
    """The vocabulary as a table from substrings to piece numbers."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        keys = np.empty(self.n, np.uint64)
        for members in by_length(pieces).values():
            *_, whole = substring_hashes(self.codes([pieces[i] for i in members]))
            keys[members] = whole[:, 0]
        self.table = HashTable(keys, np.arange(self.n))

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)

    def pieces(self, codes: np.ndarray) -> list[np.ndarray]:
        """[k - 1][row, begin]: the piece of k characters there; n for an unknown character, n + 1 for no piece."""
        out = [self.table.get(h) for h in substring_hashes(codes)]
        return [np.where(x < 0, self.n + (k > 0), x) for k, x in enumerate(out)]

    def forward(self, pieces: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """[row, language]: the logarithm of the sum over all segmentations; p[piece, language], with two rows more."""
        rows, length = pieces[0].shape
        if length > BLOCK:
            return np.concatenate([self.long_word([x[i] for x in pieces], p) for i in range(rows)])
        a = np.zeros((length + 1, rows, p.shape[1]))
        a[0] = 1
        logs = np.zeros((rows, p.shape[1]))
        for e in range(1, length + 1):
            for k in range(1, min(len(pieces), e) + 1):
                a[e] += a[e - k] * p[pieces[k - 1][:, e - k]]
            if e % PIECE_CHARS == 0:  # keeps long words in range
                top = a[e].copy()
                a[e - PIECE_CHARS : e + 1] /= top
                logs += np.log(top)
        return np.log(np.maximum(a[length], 1e-300)) + logs

    def long_word(self, pieces: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """[1, language]: the same of one long word, all its blocks at once.

        The sums at the last PIECE_CHARS places are a linear function of those a block before. Each block finds its own
        matrix, from as many starts as there are places; the matrices are then applied one after the other. Some blocks are
        done at once, as many as BLOCK_CELLS holds.
        """
        length, width, n = len(pieces[0]), PIECE_CHARS, p.shape[1]
        blocks = -(-length // BLOCK)
        at = np.full((width, blocks * BLOCK), self.n + 1)  # [k - 1, end]: the piece of k characters that ends there
        for k, x in enumerate(pieces, start=1):
            at[k - 1, k - 1 : k - 1 + len(x)] = x
        at = at.reshape(width, blocks, BLOCK)
        real = np.minimum(BLOCK, length - np.arange(blocks) * BLOCK)  # the last block may be shorter
        state, total = np.zeros((width, n)), np.zeros(n)
        state[0] = 1
        some = max(1, BLOCK_CELLS // (width * width * n))
        for first in range(0, blocks, some):
            own, ends = at[:, first : first + some], real[first : first + some]
            now = np.zeros((width, len(ends), width, n))  # [place, the last first; block; start; language]
            now[np.arange(width), :, np.arange(width)] = 1
            for e in range(BLOCK):
                new = sum(now[k - 1] * p[own[k - 1, :, e]][:, None, :] for k in range(1, width + 1))
                live = e < ends
                now[1:, live] = now[:-1, live].copy()
                now[0, live] = new[live]
                if e % width == width - 1:
                    top = now.max(axis=(0, 2))
                    now /= top[None, :, None, :]
                    total += np.log(top).sum(axis=0)
            for b in range(len(ends)):
                state = np.einsum("jsn,sn->jn", now[:, b], state)
                top = state.max(axis=0)
                state, total = state / top, total + np.log(top)
        return (np.log(np.maximum(state[0], 1e-300)) + total)[None]

    def expected(self, pieces: list[np.ndarray], p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The expected number of each piece in the rows, each counted weight times, under one language's p."""
        rows, length = pieces[0].shape
        q = [p[x] for x in pieces]
        a, b = np.zeros((length + 1, rows)), np.zeros((length + 1, rows))
        log_a, log_b = np.zeros((length + 1, rows)), np.zeros((length + 1, rows))  # a and b are as large as exp of these says
        a[0] = b[length] = 1
        for e in range(1, length + 1):
            log_a[e] = log_a[e - 1]
            for k in range(1, min(len(q), e) + 1):
                a[e] += a[e - k] * q[k - 1][:, e - k]
            if e % PIECE_CHARS == 0:
                held, top = slice(e - PIECE_CHARS, e + 1), a[e].copy()
                a[held] /= top
                log_a[held] = log_a[e] + np.log(top)
        for s in range(length - 1, -1, -1):
            log_b[s] = log_b[s + 1]
            for k in range(1, min(len(q), length - s) + 1):
                b[s] += b[s + k] * q[k - 1][:, s]
            if (length - s) % PIECE_CHARS == 0:
                held, top = slice(s, s + PIECE_CHARS + 1), b[s].copy()
                b[held] /= top
                log_b[held] = log_b[s] + np.log(top)
        whole, out = np.log(np.maximum(a[length], 1e-300)) + log_a[length], np.zeros(self.n + 2)
        for k in range(1, len(q) + 1):
            n = length - k + 1
            share = a[:n].T * q[k - 1] * b[k:].T * np.exp(log_a[:n] + log_b[k:] - whole).T * weight[:, None]
            out += np.bincount(pieces[k - 1].ravel(), share.ravel(), self.n + 2)
        return out


def by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def fit(pieces: list[str], texts: dict[str, list[str]], rounds: int = 4) -> np.ndarray:
    """[piece, language]: probabilities, languages in the order of `texts`; the last two rows stand for no piece."""
    lattice, n = Lattice(pieces), len(pieces)
    data = []
    for language in texts.values():
        count: dict[str, int] = {}
        for t in language:
            for w in WORD.findall(t.lower()):
                count[MARK + w] = count.get(MARK + w, 0) + 1
        words = list(count)
        groups = []
        for length, members in by_length(words).items():
            for s in range(0, len(members), max(1, CELLS // 16 // length)):
                part = [words[i] for i in members[s : s + max(1, CELLS // 16 // length)]]
                groups.append((lattice.pieces(lattice.codes(part)), np.array([count[w] for w in part], float)))
        data.append(groups)
    p = np.full((n + 2, len(data)), 1.0 / n)
    p[n], p[n + 1] = UNKNOWN, 0
    for _ in range(rounds):
        counts = np.stack([sum((lattice.expected(x, p[:, j], w) for x, w in groups), np.zeros(n + 2)) for j, groups in enumerate(data)], axis=1)[:n]
        pooled = counts.sum(axis=1) + 0.01
        counts = counts + POOLED * (pooled / pooled.sum())[:, None]
        p[:n] = counts / counts.sum(axis=0)
    return p


class Scorer:
    def __init__(self, pieces: list[str], p: np.ndarray):
        self.lattice, self.p = Lattice(pieces), p
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, self.p.shape[1]))

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        got = np.empty((len(words), self.p.shape[1]))
        for length, members in by_length(words).items():
            step = max(1, CELLS // ((length + 1) * self.p.shape[1]))
            for s in range(0, len(members), step):
                part = members[s : s + step]
                got[part] = self.lattice.forward(self.lattice.pieces(self.lattice.codes([MARK + words[i] for i in part])), self.p)
        n = len(self.known)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.logs = np.concatenate([self.logs, got])

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language]: the logarithms of the texts' probabilities; the number of words of each text."""
        found = [WORD.findall(t.lower()) for t in texts]
        words = [w for f in found for w in f]
        distinct = set(words)
        new = sorted(distinct.difference(self.known))
        if new:
            known = len(self.known)
            self.learn(new)
            if len(self.known) < known + len(new):
                self.learn(sorted(distinct.difference(new)))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        row = np.repeat(np.arange(len(found)), counts)
        return np.stack([np.bincount(row, self.logs[at, j], len(found)) for j in range(self.p.shape[1])], axis=1), counts


def training_texts(documents: DataFrame, folds: int, left_out: int, most: int, languages: int = LANGUAGES, most_bytes: int = SAMPLE_BYTES, all_bytes: int = TRAIN_BYTES) -> dict[str, list[str]]:
    """Texts of at most `most` ids and `most_bytes` bytes of each of the `languages` most frequent languages, from rows outside the fold.

    All languages together have at most `all_bytes` bytes, in equal shares, and one text each in any case. Ids are taken in the order of a hash, an id of several languages for the first of them by name.
    """
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != left_out))
    names = cut(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang"))
    most_bytes = min(most_bytes, all_bytes // max(1, names.count()))
    ids = rows.select("doc_id", "lang").join(F.broadcast(names), "lang").withColumn("h", F.xxhash64("doc_id")).groupBy("doc_id", "h").agg(F.min("lang").alias("lang"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    picked = cut(ids.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth"))
    out: dict[str, dict[str, None]] = {}
    for r in sampled_texts(rows, picked, "lang", most_bytes).select("lang", "text", "doc_id").orderBy("lang", "doc_id").collect():
        out.setdefault(r["lang"], {})[r["text"]] = None
    return {lang: list(texts) for lang, texts in out.items()}


def identify(documents: DataFrame, path: str, folds: int = 4, left_out: int = 2, most: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each row of documents, from its whole text.

    `path` is a SentencePiece model on the driver. The models are fitted on the driver to at most `most` documents of
    each of the `languages` most frequent languages, whose crc32 of the id mod `folds` is not left_out; held_out marks the others, and rows without an
    id. score is the share of the predicted language in the sum of all languages' probabilities. `und`, with score 0, if a text
    is null or has no letter, or nothing could be learned. Ties go to the first language by name.
    """
    texts = training_texts(documents, folds, left_out, most, languages)
    names = list(texts)
    pieces = usable_pieces(path)
    model = documents.sparkSession.sparkContext.broadcast((pieces, fit(pieces, texts) if names else None))
    token = uuid.uuid4().hex

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [t or "" for t in batch.column(1).to_pylist()]
        if not names:
            lang, score = ["und"] * len(got), np.zeros(len(got))
        else:
            logs, words = once_a_worker(token, lambda: Scorer(*model.value)).score(got)
            best = logs.argmax(axis=1)
            score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            score[words == 0] = 0
            lang = [names[b] if n else "und" for b, n in zip(best, words, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = map_texts(documents.select("doc_id", "text"), "text", fn, f"doc_id {kind}, lang_pred string, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == left_out, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

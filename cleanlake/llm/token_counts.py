"""How many tokens each text has under a public tokenizer, however long it is.

Short texts are encoded in batches by the library. Texts of more than CHUNK bytes are encoded in overlapping chunks with byte
offsets and spliced at tokens that both chunks have, which is proved to give the library's ids of the whole (splice.py).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, once_a_worker
from .splice import CHUNK, OVERLAP, encode_long, larger, splittable, token_bytes

#: Tokens beyond which a text is over the limit.
LIMIT = 512


class JsonTokenizer:
    """A tokenizer of the tokenizers library, without added tokens, truncation, padding or threads of its own."""

    def __init__(self, text: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(text)
        self.own.no_truncation(), self.own.no_padding()
        self.own.encode_special_tokens = not special
        self.chunks = splittable(text)
        if self.chunks:
            self.bytes = token_bytes(text)
            self.size = np.array([len(b) for b in self.bytes], np.int64)
            self.chunks = bool(self.size.all())
            #: Bytes are left as they are, and each has a token, so that every text comes back from its tokens.
            self.lossless = {bytes([i]) for i in range(256)} <= set(self.bytes)

    def encode_chunk(self, data: bytes) -> tuple[np.ndarray, int]:
        return np.array(self.own.encode(data.decode(), add_special_tokens=False).ids, np.int64), 0

    def long(self, text: str, chunk: int, overlap: int) -> np.ndarray:
        return encode_long(text.encode(), self.encode_chunk, self.size, chunk, overlap)

    def _batch(self, texts: list[str], chunk: int) -> tuple[list[bool], Iterator]:
        """Which texts have more than chunk bytes, if that matters, and the library's encodings of the others."""
        huge = [self.chunks and larger(t, chunk) for t in texts]
        return huge, iter(self.own.encode_batch_fast([t for t, h in zip(texts, huge, strict=True) if not h], add_special_tokens=False))

    def counts(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """The number of tokens of each text; only texts of more than chunk bytes are cut."""
        huge, short = self._batch(texts, chunk)
        return [len(self.long(t, chunk, overlap)) if h else len(next(short)) for t, h in zip(texts, huge, strict=True)]

    def ids(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[np.ndarray]:
        huge, short = self._batch(texts, chunk)
        return [self.long(t, chunk, overlap) if h else np.array(next(short).ids, np.int64) for t, h in zip(texts, huge, strict=True)]


class PieceTokenizer:
    """A tokenizer of the sentencepiece library, without added tokens."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_proto=model)

    def counts(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        return list(map(len, self.own.encode(texts, num_threads=1)))


def count_tokens(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row's whole text; null is read as empty, without tokens.

    `path` is a tokenizer file on the driver (.json for tokenizers, .model for sentencepiece), which is broadcast. Special
    tokens written in a text count as the library's default has them. A row out for each row in, repeated and null keys
    too; other columns are not read. Texts of more than `chunk` bytes are cut if the tokenizer allows a proof (byte-level .json).
    """
    data, json_file = documents.sparkSession.sparkContext.broadcast(Path(path).read_bytes()), path.endswith(".json")
    token = f"{hashlib.sha256(data.value).hexdigest()}:counted"

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = once_a_worker(token, lambda: JsonTokenizer(data.value.decode()) if json_file else PieceTokenizer(data.value))
        counts = own.counts([t or "" for t in batch.column(1).to_pylist()], chunk, overlap)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    whole = F.coalesce(documents[text], F.lit(""))
    rows = documents.select(documents[key].alias("key"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    kind = rows.schema["key"].dataType.simpleString()
    out = map_texts(rows, "text", fn, f"key {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("key", key)

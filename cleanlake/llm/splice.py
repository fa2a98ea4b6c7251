"""Token ids of texts of any length: long texts are encoded in overlapping chunks and spliced where both must agree.

A sequence of tokens of a byte-pair vocabulary is the encoding of its bytes if and only if each two neighbours are the
encoding of theirs. So two chunks of a text may be spliced at a token that both have at the same place: every two
neighbours of the result are neighbours in one of the chunks, whatever stands further off. A pre-tokenizer that splits
words first must agree on both sides too: one that looks at nothing behind, and ahead only at the end of a run of blanks,
finds the same words in both chunks once it is MARGIN bytes from the ends, as is any special token there.

The next chunk begins at a token of the one before it, so that periodic texts stay in step. If no token is shared, the
overlap is doubled; if it would be half a chunk, chunks are doubled and the text is begun again: at last it is one chunk.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of a chunk and of the overlap of two, at first, and bytes at the ends of a chunk where nothing is spliced.
CHUNK, OVERLAP, MARGIN = 1 << 16, 512, 64

Encode = Callable[[bytes], tuple[np.ndarray, int]]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it is printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def splittable(tokenizer_json: str) -> bool:
    """Whether texts of this tokenizer may be spliced: byte-level words, plain byte pairs, bytes left as they are."""
    spec = json.loads(tokenizer_json)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and len(t["content"].encode()) < MARGIN for t in spec.get("added_tokens", []))
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return spec.get("normalizer") is None and spec.get("post_processor") is None and byte_level and model.get("type") == "BPE" and plain and added


def token_bytes(tokenizer_json: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer; those of an added token are its text."""
    spec, letters = json.loads(tokenizer_json), byte_letters()
    out: dict[int, bytes] = {i: bytes(map(letters.__getitem__, w)) for w, i in spec["model"]["vocab"].items() if all(c in letters for c in w)}
    out |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def larger(text: str, n: int) -> bool:
    """Whether text has more than n bytes of UTF-8."""
    return len(text) > n or (4 * len(text) > n and len(text.encode()) > n)


def _border(data: bytes, at: int) -> int:
    """The last place, at or before `at`, where a code point begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class Chunk:
    """The encoding of data[begin:end]: ids, and where each begins in data."""

    def __init__(self, data: bytes, begin: int, end: int, encode: Encode, size: np.ndarray):
        self.end = end
        self.ids, more = encode(data[begin:end])
        ends = begin - more + np.cumsum(size[self.ids])
        self.starts = ends - size[self.ids]
        self.begin = begin


def shared(one: Chunk, two: Chunk) -> tuple[int, int] | None:
    """The places in both of the first token that both have, MARGIN bytes from the end of one and from the begin of two."""
    _, i, j = np.intersect1d(one.starts, two.starts, assume_unique=True, return_indices=True)
    ends = np.append(one.starts[1:], one.end)
    good = (one.ids[i] == two.ids[j]) & (two.starts[j] >= two.begin + MARGIN) & (ends[i] <= one.end - MARGIN)
    at = np.flatnonzero(good)
    return (int(i[at[0]]), int(j[at[0]])) if len(at) else None


def _spliced(data: bytes, encode: Encode, size: np.ndarray, chunk: int, overlap: int) -> Iterator[np.ndarray | None]:
    """The parts of the ids; None at last if an overlap of half a chunk shares no token."""
    now, first = Chunk(data, 0, _border(data, chunk) if chunk < len(data) else len(data), encode, size), 0
    while now.end < len(data):
        reach = overlap
        while True:
            places = np.flatnonzero(now.starts[first:] <= now.end - reach)
            if 2 * reach > chunk or not len(places):
                yield None
                return
            begin = _border(data, int(now.starts[first + places[-1]]))
            end = _border(data, begin + chunk) if begin + chunk < len(data) else len(data)
            if begin <= now.starts[first] or end <= now.end:
                yield None
                return
            after = Chunk(data, begin, end, encode, size)
            if (met := shared(now, after)) is not None and met[0] > first:
                break
            reach *= 2
        yield now.ids[first : met[0]]
        now, first = after, met[1]
    yield now.ids[first:]


def encode_long(data: bytes, encode: Encode, size: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids that encode would give for all of data (UTF-8), which is given to it in chunks.

    encode(chunk) returns the ids and how many bytes they hold before the chunk's own; size is the number of bytes of each id, none of which is 0.
    """
    while True:
        parts = list(_spliced(data, encode, size, chunk, overlap))
        if parts[-1] is not None:
            return np.concatenate(parts)
        chunk, overlap = 2 * chunk, 2 * overlap

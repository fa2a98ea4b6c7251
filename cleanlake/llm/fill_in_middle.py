"""Documents cut in three and written out of order, as training samples for filling in a middle; and back again.

The units of a text are the matches of UNIT, found by the tokenizers library's Split pre-tokenizer, whose isolated matches
come with their ranges in code points: as many ranges as units, and the k-th range ends where k units end. A long text is
split block by block, each ending where no unit can go on; only the number of units of a block is kept, and the blocks
that hold the two cuts are split once more, so that a task never holds the ranges of a whole long text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .common import map_texts

#: Fixed values of the format.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, those left plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Code points that are split at once (a longer run of letters is one unit, and is split whole).
BLOCK = 1 << 16


@functools.cache
def splitter() -> Split:
    return Split(Regex(UNIT), "isolated")


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def blocks(text: str, most: int = BLOCK) -> list[tuple[int, int]]:
    """Ranges of text of about `most` code points each, none of which ends between two letters."""
    out, begin = [], 0
    while begin < len(text):
        end = min(begin + most, len(text))
        while end < len(text) and _letter(text[end - 1]) and _letter(text[end]):
            end += 1
        out.append((begin, end))
        begin = end
    return out


class Units:
    """The units of one text: how many there are, and where the first k of them end."""

    def __init__(self, text: str, most: int = BLOCK):
        self.text, self.ranges = text, blocks(text, most)
        self.held = [self._offsets(a, b) for a, b in self.ranges] if len(self.ranges) == 1 else None
        sizes = [len(x) for x in self.held] if self.held else [len(self._offsets(a, b)) for a, b in self.ranges]
        self.ends = np.cumsum([0, *sizes])

    def _offsets(self, begin: int, end: int) -> list[tuple[str, tuple[int, int]]]:
        return splitter().pre_tokenize_str(self.text[begin:end])

    def __len__(self) -> int:
        return int(self.ends[-1])

    def end(self, k: int) -> int:
        """The code points that the first k units take."""
        if k == 0:
            return 0
        i = int(np.searchsorted(self.ends, k)) - 1
        offsets = self.held[i] if self.held else self._offsets(*self.ranges[i])
        return self.ranges[i][0] + offsets[k - 1 - int(self.ends[i])][1][1]


def drawn(key: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the SHA-256 of `seed:key`; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def rearranged(text: str, h: tuple[int, int, int, int], plain: int, suffix_first: int, block: int = BLOCK) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, and the text in that form."""
    units = Units(text, block)
    n = len(units)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = units.end(one), units.end(two)
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def fill_in_middle(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output: each row's whole text, rearranged as the hash of its key says.

    n is the number of units. `plain` of a hundred keys, and texts that are null (read as empty), empty or hold a marker,
    keep their text as it is: form plain, no lengths. Of the others `suffix_first` of a hundred have the form spm, the rest psm. A row out for each
    row in: rows of one key draw the same numbers, null keys those of an empty one. Other columns are not read.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        draws = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
        rows = [rearranged(t or "", h, plain, suffix_first) for t, h in zip(batch.column(1).to_pylist(), draws, strict=True)]
        n, form, a, b, out = zip(*rows, strict=True) if rows else ((),) * 5
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"), *drawn(documents[key], seed))
    kind = rows.schema["key"].dataType.simpleString()
    out = map_texts(rows, "text", fn, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of. A rearranged text holds each marker once, since texts that hold one stay plain
    and no marker can begin within another."""
    between = lambda begin, end: F.substr(output, F.locate(begin, output) + len(begin), F.locate(end, output) - F.locate(begin, output) - len(begin))
    after = F.substr(output, F.locate(MIDDLE, output) + len(MIDDLE))
    psm = F.concat(between(PREFIX, SUFFIX), after, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

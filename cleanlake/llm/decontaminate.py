"""Test items that stand in training texts, by a positional inverted index.

The index holds a posting (term, document, position) for each token of the training texts whose term occurs in any
item; terms of no item are never asked for. The windows of the items are then looked up by intersecting lists, each
list shifted by the term's offset: a posting of an item's term at position p of a document puts the item at
p - offset there. The rarest term of each window starts, the second rarest must agree, and what is left is compared
term by term, so that common terms are read for few places only.

Edited items are found by proximity in the same lists: the second rarest term may stand SLACK words off the place that the
rarest expects, and so may every other; a window with all its words but MISSING there is a near match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small_enough
from .text import lower_ascii, row_key

#: What is no part of a word: ASCII but for letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEYS = ["_k1", "_k2"]
#: How far off, in words, those of a near match may stand; how many of a window may be missing.
SLACK, MISSING = 2, 1
#: Parts that the tokens of one term are dealt into where terms are too many to broadcast.
SALTS = 32
#: Bytes of terms, at 64 each, that are broadcast.
TERM_BYTES = 16 << 20
#: Stands for an item without an id.
NAMELESS = "\x00"


def words(text: Column) -> Column:
    """The words of text, in its own case; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, at, term, n: the words of each distinct item by position; n words in all."""
    each = items.select(F.coalesce(items[key].cast("string"), F.lit(NAMELESS)).alias("item"), words(items[text]).alias("w"))
    return each.select("item", F.size("w").alias("n"), F.xxhash64(F.to_json(F.struct("w"))).alias("version"), F.posexplode("w").alias("at", "term")).withColumn("term", lower_ascii(F.col("term")))


def build_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """term_id, _k1, _k2, pos: the postings of `terms` (term, term_id) in each whole text of documents, kept."""
    tokens = documents.select(*row_key(F.col("doc_id"), F.col("text")), F.posexplode(words(lower_ascii(F.col("text")))).alias("pos", "term"))
    if terms.count() * 64 <= TERM_BYTES:
        return cut(tokens.join(F.broadcast(terms), "term").select("term_id", "_k1", "_k2", "pos"))
    salt = F.pmod(F.xxhash64("_k1", "pos"), F.lit(SALTS)).cast("int")
    dealt = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cut(tokens.withColumn("salt", salt).join(dealt, ["term", "salt"]).select("term_id", "_k1", "_k2", "pos"))


def windows(terms: DataFrame, frequency: DataFrame, width: int, missing: int = 0) -> DataFrame:
    """item, version, n, start, size, by_rarity: the windows whose terms occur, all but `missing`, with those that do, rarest first.

    by_rarity: array<struct<df,at,term_id>>. Items shorter than width are one window.
    """
    known = terms.join(small_enough(frequency, 16), "term_id", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    size = F.least("n", F.lit(width))
    spread = known.withColumn("size", size).withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("size") + 1), F.least(F.col("at"), F.col("n") - F.col("size")))))
    occurs = F.when(F.col("df") > 0, F.struct("df", "at", "term_id"))
    made = spread.groupBy("item", "version", "n", "size", "start").agg(F.array_sort(F.collect_list(occurs)).alias("by_rarity"))
    return made.where(F.size("by_rarity") >= F.greatest(F.lit(1), F.col("size") - F.when(F.col("size") < width, 0).otherwise(missing)))


def aligned(index: DataFrame, terms: DataFrame, width: int, slack: int = 0, missing: int = 0) -> DataFrame:
    """item, version, n, _k1, _k2, shift, at, exact: the item's words that stand in a document where its first word stands at `shift`.

    Shifts are those where the rarest word of a window stands in its place, and the second rarest at most `slack` words off. The
    word at `at` stands at most `slack` words off; exact says that it is in its place.
    """
    frequency = cut(index.groupBy("term_id").agg(F.count("*").alias("df")))
    asked = windows(terms, frequency, width, missing)
    first = asked.select("item", "version", F.col("by_rarity")[0].alias("a"), F.get("by_rarity", F.lit(1)).alias("b"))
    first = cut(first.select("item", "version", F.col("a.term_id").alias("term_id"), F.col("a.at").alias("at"), F.col("b.term_id").alias("b_term"), F.col("b.at").alias("b_at")).distinct())
    off = F.explode(F.sequence(F.lit(-slack), F.lit(slack)))
    places = index.join(small_enough(first, 64), "term_id").select("item", "version", *KEYS, (F.col("pos") - F.col("at")).alias("shift"), "b_term", "b_at")
    alone = places.where("b_term is null").select("item", "version", *KEYS, "shift")
    second = small_enough(cut(first.where("b_term is not null").select(F.col("b_term").alias("term_id")).distinct()), 16)
    rest = index.join(second, "term_id", "left_semi").withColumnRenamed("term_id", "b_term")
    wanted = places.where("b_term is not null").withColumn("off", off).withColumn("pos", F.col("shift") + F.col("b_at") + F.col("off"))
    agreed = wanted.select("item", "version", *KEYS, "shift", "pos", "b_term").distinct().join(rest, [*KEYS, "pos", "b_term"], "left_semi").select("item", "version", *KEYS, "shift")
    shifts = cut(agreed.unionByName(alone).distinct())
    holders = small_enough(cut(shifts.select(*KEYS).distinct()), 32)
    near = index.join(holders, KEYS, "left_semi")
    expected = shifts.join(small_enough(terms, 64), ["item", "version"]).withColumn("off", off).withColumn("pos", F.col("shift") + F.col("at") + F.col("off"))
    met = expected.join(near, [*KEYS, "pos", "term_id"], "left_semi")
    return met.groupBy("item", "version", "n", *KEYS, "shift", "at").agg(F.bool_or(F.col("off") == 0).alias("exact"))


def phrase_matches(met: DataFrame, width: int) -> DataFrame:
    """item, version, _k1, _k2, shift, begin, end: runs of document positions in which every word is in an occurrence of a window.

    met is aligned()'s. A run covers one or more windows that overlap at the same shift; runs of other shifts may overlap it.
    """
    by_shift = W.partitionBy("item", "version", *KEYS, "shift").orderBy("at")
    runs = (
        met.where("exact")
        .withColumn("pos", F.col("shift") + F.col("at"))
        .withColumn("run", F.col("at") - F.row_number().over(by_shift))
        .groupBy("item", "version", *KEYS, "shift", "run")
        .agg(F.min("pos").alias("begin"), (F.max("pos") + 1).alias("end"), F.first("n").alias("n"))
    )
    return runs.where(F.col("end") - F.col("begin") >= F.least("n", F.lit(width))).select("item", "version", *KEYS, "shift", "begin", "end")


def proximity_matches(met: DataFrame, width: int, missing: int = MISSING) -> DataFrame:
    """item, version, _k1, _k2, shift: where all words of a window but `missing` stand near their places; exact matches are among them.

    met is aligned()'s with the same number missing. Items of fewer than `width` words have no near match.
    """
    by_place = W.partitionBy("item", "version", *KEYS, "shift").orderBy("at")
    hit = F.lit(False)
    for before in range(missing + 1):  # words of the window that are missing before the first one that is met
        held = F.count("*").over(by_place.rangeBetween(0, width - 1 - before))
        hit = hit | ((held >= width - missing) & (F.col("at") >= before) & (F.col("at") - before + width <= F.col("n")))
    return met.where(F.col("n") >= width).withColumn("near", hit).where("near").select("item", "version", *KEYS, "shift").distinct()


def index_for(documents: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index of documents for items, and the items' terms: item, version, n, at, term_id."""
    terms = item_terms(items, key, text)
    ids = cut(terms.select("term").distinct().withColumn("term_id", F.xxhash64("term")))
    terms = cut(terms.withColumn("term_id", F.xxhash64("term")).drop("term").distinct())
    return build_index(documents, ids), terms


def contamination(documents: DataFrame, items: DataFrame, width: int = 10, key: str = "item_id", text: str = "text", near: bool = False) -> DataFrame:
    """doc_id, _k1, _k2, n_words, n_hit, items array<string>, with `near` also near_items: a row for each row of documents.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Windows are `width` consecutive
    words of an item; an item of fewer words, but not none, is one window. n_hit counts the document's words inside
    any occurrence of a window, items are the ids, as strings and sorted, with an occurrence. Null texts have no words.
    Repeated rows each get their result, null ids too; items that share an id are looked up each and named once; those
    without an id count for hits and are not named. near_items are the ids of items of `width` words or more with a near
    match (proximity_matches), exact ones among them.
    """
    index, terms = index_for(documents, items, key, text)
    met = cut(aligned(index, terms, width, SLACK if near else 0, MISSING if near else 0))
    runs = cut(phrase_matches(met, width))
    before = F.coalesce(F.max("end").over(W.partitionBy(*KEYS).orderBy("begin", "end").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = runs.select(*KEYS, "begin", "end").distinct().withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("begin", before)))
    hits = ranges.groupBy(*KEYS).agg(F.sum("new").alias("n_hit"))
    ids = lambda: F.array_sort(F.collect_set(F.when(F.col("item") != NAMELESS, F.col("item"))))
    named = runs.groupBy(*KEYS).agg(ids().alias("items"))
    found = hits.join(named, KEYS)
    if near:
        found = found.join(proximity_matches(met, width).groupBy(*KEYS).agg(ids().alias("near_items")), KEYS, "full_outer")
    rows = documents.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ["items", "near_items"][: 1 + near]]
    return rows.join(found, KEYS, "left").select("doc_id", *KEYS, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *lists)

"""Running totals of arrays and the ranges of pattern matches, without an accumulator that grows with each element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Neighbours that a doubling step adds up: arrays hold fewer than 2^31 elements, so that sixteen steps of four suffice.
_STEP, _STEPS = 4, 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_totals(numbers: Column) -> Column:
    """array<bigint>: the sums of the first 1, 2, ... numbers of an array; null for null.

    In step k every element takes in its neighbours at 1, 2 and 3 times 4^k before it, so that a step costs as much as the
    array is long, and short arrays need one step.
    """

    def step(reach: int) -> Callable[[Column], Column]:
        def one(a: Column) -> Column:
            def total(x: Column, i: Column) -> Column:
                for j in range(1, _STEP):
                    x = x + F.coalesce(F.get(a, i - j * reach), F.lit(0).cast("bigint"))
                return x

            return F.when(F.size(a) > reach, F.transform(a, total)).otherwise(a)

        return one

    def all_steps(a: Column) -> Column:
        for k in range(1, _STEPS):
            a = let(a, step(_STEP**k))
        return a

    first = lambda a: let(step(1)(a), lambda x: F.when(F.size(x) > _STEP, all_steps(x)).otherwise(x))
    return let(numbers.cast("array<bigint>"), first)


def match_ranges(text: Column, pattern: str, made: Callable[[Column, Column, Column], Column]) -> Column:
    """An array of made(match, begin, end) for the leftmost non-overlapping matches of pattern in text, by characters, the end exclusive.

    The ranges come from running totals of the lengths of the matches and of what lies between them. Null for null texts;
    patterns must not match the empty string.
    """

    def placed(x: Column) -> Column:
        lengths = F.transform(F.arrays_zip(x["found"].alias("w"), F.slice(x["between"], 1, F.size(x["found"])).alias("b")), lambda p: F.length(p["w"]) + F.length(p["b"]))
        zipped = F.arrays_zip(x["found"].alias("w"), running_totals(lengths).alias("e"))
        return F.transform(zipped, lambda p: made(p["w"], p["e"] - F.length(p["w"]), p["e"]))

    between = lambda found: F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.isNotNull(), let(found, lambda f: let(F.struct(f.alias("found"), between(f).alias("between")), placed)))

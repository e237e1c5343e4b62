"""Sets of whole numbers as sorted, disjoint intervals: union, difference, intersection and membership without listing them.

An interval is ``struct<lo:long,hi:long>``, both ends included; a set is an array of them in which neighbours neither
overlap nor touch. A range of two million ids costs as much as a single id.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<lo:bigint,hi:bigint>>"


def _interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def _none() -> Column:
    return F.array().cast(TYPE)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a lambda would compute it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(raw: Column) -> Column:
    """Set of any array of intervals; empty ones (``lo`` above ``hi``) are left out.

    Starts and ends are sorted apart: a gap follows the i-th end if the next start lies beyond it, as then all intervals
    that began before have ended.
    """
    kept = F.filter(raw, lambda x: x["lo"] <= x["hi"])
    ends = _let(kept, lambda k: F.struct(F.sort_array(k["lo"]).alias("lo"), F.sort_array(k["hi"]).alias("hi")))

    def merge(e: Column) -> Column:
        lo = F.filter(e["lo"], lambda v, i: (i == 0) | (v > F.get(e["hi"], i - 1) + 1))
        hi = F.filter(e["hi"], lambda v, i: F.coalesce(F.get(e["lo"], i + 1) > v + 1, F.lit(True)))
        return F.arrays_zip(lo, hi).cast(TYPE)

    return _let(ends, merge)


def parse(c: Column) -> Column:
    """``1,10-12`` to its set; blanks don't matter, malformed and backward parts are left out, null is the empty set."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""), ",")
    numbers = F.filter(parts, lambda p: p.rlike(r"^\d{1,18}(-\d{1,18})?$"))  # what is cast below is a number: failing casts are slow
    number = lambda p, pattern: F.regexp_extract(p, pattern, 1).cast("long")
    return normalize(F.transform(numbers, lambda p: _interval(number(p, r"^(\d+)"), number(p, r"(\d+)\D*$"))))


def of_ids(ids: Column) -> Column:
    """Set of the numbers in an array of texts or numbers; texts may be ranges, words are left out."""
    return parse(F.array_join(F.transform(F.coalesce(ids, F.array()), lambda v: v.cast("string")), ","))


def union(a: Column, b: Column) -> Column:
    return normalize(F.concat(a, b))


def difference(a: Column, b: Column) -> Column:
    """What ``a`` has and ``b`` has not: every cut leaves the part below it and the part above it."""

    def cut(pieces: Column, q: Column) -> Column:
        sides = F.transform(pieces, lambda p: F.array(_interval(p["lo"], F.least(p["hi"], q["lo"] - 1)), _interval(F.greatest(p["lo"], q["hi"] + 1), p["hi"])))
        return F.filter(F.flatten(sides), lambda p: p["lo"] <= p["hi"])

    return F.aggregate(b, a, cut)


def intersection(a: Column, b: Column) -> Column:
    return difference(a, difference(a, b))


def contains(a: Column, v: Column) -> Column:
    return F.exists(a, lambda x: (x["lo"] <= v) & (v <= x["hi"]))


def count(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"] + 1)


def text(a: Column) -> Column:
    """``1,5-2000000``."""
    return F.array_join(F.transform(a, lambda x: F.when(x["lo"] == x["hi"], x["lo"].cast("string")).otherwise(F.concat_ws("-", x["lo"].cast("string"), x["hi"].cast("string")))), ",")


def ids(a: Column) -> Column:
    """All numbers, ascending; the one place where a set is listed."""
    return F.flatten(F.transform(a, lambda x: F.sequence(x["lo"], x["hi"])))

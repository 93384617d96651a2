"""Array columns whose values depend on what stands before, in time that grows with their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of an array that are handled in one go.
PART = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_parts(array: Column) -> Column:
    """An array as an array of arrays of ``PART`` elements, the last one shorter."""
    return bound(array, lambda a: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / PART).cast("int") - 1), lambda k: F.slice(a, k * PART + 1, F.lit(PART))))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers, ``merge`` of 0 and all before it; arrays that grow by copying are short."""

    def before(array: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, begin, lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def over(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), merge))
        return F.flatten(F.zip_with(parts, before(whole, F.lit(0)), before))

    return F.when(F.size(values) > 0, bound(in_parts(values), over)).otherwise(F.array().cast("array<int>"))


def match_places(text: Column, pattern: str) -> Column:
    """Place (from 1) and size of each match of ``pattern``: texts between matches and matches are found once, and summed up."""

    def places(parts: Column) -> Column:
        starts = running(F.transform(parts, lambda p: p["gap"] + p["size"]), lambda a, b: a + b)
        return F.filter(F.zip_with(parts, starts, lambda p, before: F.when(p["size"] > 0, F.struct((before + p["gap"] + 1).alias("pos"), p["size"].alias("size")))), lambda x: x.isNotNull())

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(hit), F.lit(0)).alias("size"))), places)

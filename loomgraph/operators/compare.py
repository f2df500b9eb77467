"""Comparing two books, builds or methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import unordered
from .tables import spread


def added_removed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change: rows only in one of the two, nulls alike (J13, U03). Both go through one shuffle."""
    both = old.select(*keys, F.lit(True).alias("_old")).unionByName(new.select(*keys, F.lit(False).alias("_old")))
    sides = spread(both, *keys).groupBy(*keys).agg(F.min("_old").alias("_all"), F.max("_old").alias("_any")).where("_all = _any")
    return sides.select(*keys, F.when(F.col("_all"), "removed").otherwise("added").alias("change"))


def overlap(first: DataFrame, second: DataFrame, typed: bool = False) -> DataFrame:
    """only_first, both, only_second of unordered pairs, with the type if ``typed``."""
    lo, hi = unordered("src", "dst")
    cols = [lo.alias("a"), hi.alias("b"), *([F.col("rel_type")] if typed else [])]
    keys = ["a", "b", *(["rel_type"] if typed else [])]
    x = first.select(*cols).distinct().withColumn("x", F.lit(1))
    y = second.select(*cols).distinct().withColumn("y", F.lit(1))
    j = x.join(y, keys, "full_outer")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return j.agg(n(F.col("y").isNull()).alias("only_first"), n(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"), n(F.col("x").isNull()).alias("only_second"))


def group_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pair, n: links between two groups, whichever comes first."""
    lo, hi = unordered(a, b)
    return pairs.groupBy(F.concat_ws(" <-> ", lo, hi).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    """(U01, U02, U05)"""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def nested(strict: DataFrame, loose: DataFrame) -> bool:
    """Whether a stricter setting's rows are all among a looser one's."""
    return strict.exceptAll(loose.select(*strict.columns)).isEmpty()


def matrix(links: DataFrame, source: str, target: str, values: list[str]) -> DataFrame:
    """source x target counts."""
    return links.groupBy(source).pivot(target, values).count().na.fill(0)


def markers(text: Column, words: tuple[str, ...]) -> Column:
    """How often any of the words occurs in a text."""
    total = F.lit(0)
    for w in words:
        total = total + (F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)
    return total.cast("long")


def first_of(column: str, n: int) -> Column:
    """The n least values of a group as an array."""
    return F.slice(F.sort_array(F.collect_set(column)), 1, n)

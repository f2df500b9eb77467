"""Exact order statistics of many groups at once, by counting.

Each round splits the range that still holds a wanted place into ``PROBES`` equal parts and counts values, with the least and the greatest of each part; the
part that holds the place is the next range. A place is found when its part holds one value. Equal parts of the range and of its logarithms take turns, so
neither even nor widely spread values need many rounds. Rounds need partial sums only: no
sort, no window over values and no buffer for a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, small

PROBES = 256


def _part(value: Column, low: Column, high: Column, by_size: bool) -> Column:
    """Part of [low, high] a value falls in, equal parts of the range or of its logarithms; the greatest value has the last part."""

    def scale(c: Column) -> Column:
        d = c.cast("double")
        # above 0 for the least double; halves keep differences finite
        return F.when(d == 0, F.lit(0.0)).otherwise(F.signum(d) * (F.log(F.abs(d)) + 746)) if by_size else d / 2

    share = F.coalesce((scale(value) - scale(low)) / F.nullif(scale(high) - scale(low), F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(share * PROBES), F.lit(PROBES - 1)).cast("int")


def values_at(df: DataFrame, value: str, keys: list[str], places: dict[str, Column]) -> DataFrame:
    """keys and, for each name, the value at that place (from 0, as an expression of n) among the non-null values of the group in order.

    ``n``, ``low`` and ``high`` come along. Groups without values are left out; null keys are a group. NaN and infinite values count as null.
    """
    v = F.col(value)
    kind = dict(df.dtypes)[value]
    fine = ~F.isnan(v) & (F.abs(v) < float("inf")) if kind in ("double", "float") else F.lit(True)
    rows = df.where(v.isNotNull() & fine).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], v.alias("_v"))
    own = [f"_{i}" for i in range(len(keys))]
    groups = cut(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("at")) for name, place in places.items()]))
    state = groups.select(*own, asked.alias("p"), "low", "high").select(*own, "p.*", "low", "high")
    found, open_, by_size = [], cut(state), False
    while True:
        found.append(open_.where("low = high").select(*own, "name", F.col("low").alias("value")))
        open_ = cut(open_.where("low < high"))
        if open_.isEmpty():
            break
        ranges = cut(open_.select(*[F.col(c).alias(f"r{c}") for c in own], F.col("low").alias("_low"), F.col("high").alias("_high")).distinct())
        ranges = small(cut(ranges.withColumn("range", F.monotonically_increasing_id())))
        same = [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in own]
        met = rows.join(ranges, [*same, F.col("_v") >= F.col("_low"), F.col("_v") <= F.col("_high")])
        parts = met.groupBy("range", _part(F.col("_v"), F.col("_low"), F.col("_high"), by_size).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("first"), F.max("_v").alias("last"))
        # PROBES rows a range
        before = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        step = open_.join(ranges, [*same, F.col("low") == F.col("_low"), F.col("high") == F.col("_high")]).select(*own, "name", "at", "range")
        step = step.join(parts.withColumn("before", before), "range").where("at >= before and at < before + n")
        open_ = cut(step.select(*own, "name", (F.col("at") - F.col("before")).alias("at"), F.col("first").alias("low"), F.col("last").alias("high")))
        by_size = not by_size
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    wide = every.groupBy(*[F.col(c).alias(f"r{c}") for c in own]).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(f"_at_{name}") for name in places])
    out = groups.join(wide, [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in own] or F.lit(True))
    return out.select(*[F.col(c).alias(k) for c, k in zip(own, keys, strict=True)], "n", "low", "high", *[F.col(f"_at_{name}").alias(name) for name in places])

"""From neighbours to candidate links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPES = ("all", "single", "cross", "cross_all")


def unordered(a: str = "source", b: str = "target") -> tuple[Column, Column]:
    """The two ends in a fixed order."""
    return F.least(a, b), F.greatest(a, b)


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order (W04, K05 with ON CREATE)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def last_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The last row of each key: what repeated SET leaves."""
    return first_wins(df, keys, [F.desc(c) if isinstance(c, str) else c.desc() for c in order])


def across_grades(a: str = "source_grade", b: str = "target_grade") -> Column:
    """Both grades known and different; empty counts as unknown."""
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (F.col(a) != F.col(b))


def scope_filter(scope: str, selected: str | None = None) -> Column:
    """Scope of a run as a condition on source_grade and target_grade."""
    if scope not in SCOPES:
        raise ValueError(f"scope {scope!r} is none of {SCOPES}")
    if scope in ("single", "cross") and not selected:
        raise ValueError(f"scope {scope} needs a selected document")
    return {
        "all": F.lit(True), "cross_all": across_grades(),
        "single": (F.col("source_grade") == F.lit(selected)) & (F.col("target_grade") == F.lit(selected)),
        "cross": across_grades() & ((F.col("source_grade") == F.lit(selected)) | (F.col("target_grade") == F.lit(selected))),
    }[scope]


def candidate_pairs(pairs: DataFrame, grades: DataFrame, threshold: float, scope: str = "cross_all", selected: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """a, b, score, grade_a, grade_b: each unordered pair once, filters after the rank as in live retrieval."""
    g = grades.select(F.col("id").cast("string").alias("id"), F.col("grade").cast("string").alias("grade"))
    rows = pairs.where(F.col("score") >= threshold)
    rows = rows.join(g.toDF("source", "source_grade"), "source").join(g.toDF("target", "target_grade"), "target").where(scope_filter(scope, selected))
    if allowed is not None:
        rows = rows.join(allowed.select(F.col("id").cast("string").alias("target")), "target", "left_semi")
    lo, hi = unordered()
    swapped = F.col("source") > F.col("target")
    out = rows.select(
        lo.alias("a"), hi.alias("b"), "score",
        F.when(swapped, F.col("target_grade")).otherwise(F.col("source_grade")).alias("grade_a"), F.when(swapped, F.col("source_grade")).otherwise(F.col("target_grade")).alias("grade_b"),
    )
    return out.groupBy("a", "b", "grade_a", "grade_b").agg(F.max("score").alias("score"))


def without_existing(pairs: DataFrame, edges: DataFrame, similar_type: str = "SIMILAR_TO") -> DataFrame:
    """Pairs that no other edge joins in either direction."""
    lo, hi = unordered("src", "dst")
    typed = edges.where(F.col("rel_type") != similar_type).select(lo.alias("a"), hi.alias("b")).distinct()
    return pairs.join(typed, ["a", "b"], "left_anti")


def stale(nodes: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Nodes that have no stored vector of this model (J07, S11's missing)."""
    return nodes.join(stored.where(F.col("model") == model).select(F.col("node_id").alias("id")), "id", "left_anti")


def anchor_cap(pairs: DataFrame, cap: int) -> DataFrame:
    """Pairs that are among the ``cap`` best of one of their ends (W09, independent of the order of arrival)."""
    ends = pairs.select("a", "b", "score", F.explode(F.array("a", "b")).alias("anchor"))
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "a", "b"))
    return ends.withColumn("r", rank).where(F.col("r") <= cap).select("a", "b", "score").distinct()

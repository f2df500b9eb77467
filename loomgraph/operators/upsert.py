"""Merges, guards, deletes and staged dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CROSS_BOOK_FLOOR, CROSS_BOOK_FLOORS
from .candidates import last_wins


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list | None = None, keep_non_empty: bool = False) -> DataFrame:
    """Table after MERGE on keys and SET of the changes' columns: last change of a key wins, null changes leave old values.

    Without an order, changes of one key are ordered by all their other columns, so the same changes always give the same table.

    ``keep_non_empty``: empty strings leave old values too, so a poorer extraction erases nothing.
    Running it twice gives what running it once gives.
    """
    if keep_non_empty:
        texts = [f.name for f in changes.schema.fields if f.dataType.simpleString() == "string" and f.name not in keys]
        changes = changes.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in texts})
    new = last_wins(changes, keys, order or [c for c in changes.columns if c not in keys] or keys)
    others = [c for c in table.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in others if c in new.columns])
    out = table.join(renamed, keys, "full_outer")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in others and c in new.columns else F.col(c) for c in table.columns])


def index_meta(stored: DataFrame) -> DataFrame:
    """model, n, dimension, consistent: what an index of the stored vectors would be built for."""
    d = F.size("vector")
    return stored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("dimension"), (F.min(d) == F.max(d)).alias("consistent"))


def require_dimension(stored: DataFrame, model: str, dimension: int) -> DataFrame:
    """The vectors of a model, if all have the length that the model has; else an error."""
    rows = stored.where(F.col("model") == model)
    if not rows.where(F.size("vector") != dimension).isEmpty():
        raise ValueError(f"vectors of {model} with another length than {dimension}")
    return rows


def upsert_similar(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """SIMILAR_TO edges with sorted ends merged with new pairs (a, b, score)."""
    new = pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit("SIMILAR_TO").alias("rel_type"), "score")
    return upsert(edges, new.groupBy("src", "dst", "rel_type").agg(F.max("score").alias("score")), ["src", "dst", "rel_type"])


def guard_vocabulary(edges: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """The edges, if all types are allowed; else an error that names some that are not."""
    bad = [r.rel_type for r in edges.where(~F.coalesce(F.col("rel_type").isin(*allowed), F.lit(False))).select("rel_type").distinct().limit(5).collect()]
    if bad:
        raise ValueError(f"relation types outside the vocabulary: {bad}")
    return edges


def edge_reason() -> Column:
    """First reason why a staged edge can't be replayed; null if it can."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(empty("rel_type"), "no relation type").when(~F.col("rel_type").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "bad relation type").when(empty("source_name"), "no source").when(empty("target_name"), "no target")
        .when((F.col("source_name") == F.col("target_name")) & F.col("source_grade").eqNullSafe(F.col("target_grade")), "self loop")
    )


def prediction_reason(allowed: tuple[str, ...], symmetric: tuple[str, ...], floors: dict[str, float] = CROSS_BOOK_FLOORS, floor: float = CROSS_BOOK_FLOOR) -> Column:
    """Verdict on a prediction: empty, NONE, bad_type, low_conf (a floor for each type), sym or asym."""
    t = F.upper(F.trim("rel_type"))
    least = F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])[t] if floors else F.lit(None)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "empty").when(t == "NONE", "none").when(~t.isin(*allowed), "bad_type")
        .when(F.coalesce("confidence", F.lit(0.0)) < F.coalesce(least, F.lit(floor)), "low_conf").when(t.isin(*symmetric), "sym").otherwise("asym")
    )


def not_none() -> Column:
    """Classified as something."""
    return F.upper(F.coalesce(F.nullif(F.trim("rel_type"), F.lit("")), F.lit("NONE"))) != "NONE"


def staged(classified: DataFrame, prefix: str = "") -> DataFrame:
    """Edges to stage: classified pairs without 'none', prefix off the stored type."""
    keep = classified.where(not_none())
    return keep.withColumn("rel_type", F.when(F.col("rel_type").startswith(prefix), F.expr(f"substring(rel_type, {len(prefix) + 1})")).otherwise(F.col("rel_type"))) if prefix else keep


def write_staged(edges: DataFrame, path: str, header: dict[str, str], overwrite: bool = False) -> DataFrame:
    """Write edges and a one-row header (counts by type, descending) as JSON; an existing dump is an error unless ``overwrite``."""
    mode = "overwrite" if overwrite else "errorifexists"
    edges.write.mode(mode).json(f"{path}/edges")
    counts = edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "rel_type", "n")))
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edge_count"), F.map_from_entries(F.transform(order, lambda s: F.struct(s["rel_type"], s["n"]))).alias("edge_type_breakdown"))
    row = row.withColumns({k: F.lit(v) for k, v in header.items()})
    row.coalesce(1).write.mode(mode).json(f"{path}/header")
    return row


def replay(edges: DataFrame, dump: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    """(edges after the merge, rejected rows with reason); the same dump replayed again changes nothing.

    Of rows for one edge the last by ``position`` (as ``files.edge_dump`` reads it) wins; a dump without positions is ordered by confidence, then description.
    """
    marked = dump.withColumn("reason", edge_reason())
    good = marked.where("reason is null").select(
        F.concat_ws("\x1f", "source_grade", "source_name").alias("src"), F.concat_ws("\x1f", "target_grade", "target_name").alias("dst"), "rel_type",
        F.col("properties.description").alias("description"), F.col("properties.confidence").alias("confidence"), F.coalesce("properties.method", F.lit(method)).alias("method"),
        *[c for c in ("position",) if c in dump.columns],
    )
    order = [*[c for c in ("position",) if c in dump.columns], "confidence", "description", "method"]
    return upsert(edges, good, ["src", "dst", "rel_type"], order), marked.where("reason is not null")


def without(edges: DataFrame, method: str | None = None, prefix: str | None = None) -> DataFrame:
    """Edges left after a delete by method or type prefix."""
    gone = F.lit(False)
    if method is not None:
        gone = gone | F.coalesce(F.col("method") == method, F.lit(False))
    if prefix is not None:
        gone = gone | F.coalesce(F.col("rel_type").startswith(prefix), F.lit(False))
    return edges.where(~gone)


def wiped(rows: DataFrame) -> DataFrame:
    """The table without any row."""
    return rows.where(F.lit(False))


def overwrite_grades(rows: DataFrame, path: str) -> None:
    """Replace only the grades that the rows hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("grade").parquet(path)


def numbered(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows numbered from 1 in the order of a hexadecimal hash: ranks within its first three digits, plus the rows of the digits before."""
    rows = rows.withColumns({"_key": key, "_cell": F.substring(key, 1, 3)})
    cells = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))  # 4096 at most
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_key"))
    return rows.join(F.broadcast(cells), "_cell").withColumn(name, F.col("_before") + rank).drop("_key", "_cell", "_before")


def survey(edges: DataFrame, seed: str, floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(shown, held out): edges of enough confidence in an order by seeded hash with ids LB001..., the rest apart."""
    sure = F.coalesce("confidence", F.lit(0.0)) >= floor
    key = F.sha2(F.concat_ws("\x1f", F.lit(seed), "src", "dst", "rel_type"), 256)
    shown = numbered(edges.where(sure), key, "_order")
    return shown.withColumn("id", F.format_string("LB%03d", "_order")).drop("_order"), edges.where(~sure)


def split_failures(rows: DataFrame, path: str) -> None:
    """Write results and failed inputs apart."""
    rows.where("error is null").drop("error").write.mode("overwrite").parquet(f"{path}/results")
    rows.where("error is not null").write.mode("overwrite").parquet(f"{path}/failed")

"""Expert ratings: distributions, precision, consensus, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RATINGS

# What a consensus leads to.
ACTIONS = {"correct": "keep", "partial": "annotate", "wrong": "drop", "missing": "annotate"}


def rating_rows(reviews: DataFrame) -> DataFrame:
    """reviewer, course, index, rating: the ratings map as rows; keys that are no number go."""
    r = reviews.select("reviewer", "course", F.explode("ratings").alias("key", "rating"))
    return r.select("reviewer", "course", F.expr("try_cast(key as bigint)").alias("index"), "rating").where("index is not null")


def resolved(ratings: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ratings with their triple, ratings whose index is out of range) by (course = grade, index)."""
    t = triples.withColumnRenamed("grade", "course")
    return ratings.join(t, ["course", "index"]), ratings.join(t.select("course", "index"), ["course", "index"], "left_anti")


def active(ratings: DataFrame, excluded: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """Ratings of reviewers who are not excluded and gave enough."""
    rows = ratings.where(~F.col("reviewer").isin(*excluded)) if excluded else ratings
    busy = rows.groupBy("reviewer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.join(busy.select("reviewer"), "reviewer", "left_semi")


def distribution(ratings: DataFrame, *keys: str) -> DataFrame:
    """keys, a column for each rating, total."""
    out = ratings.groupBy(*keys).pivot("rating", list(RATINGS)).count().na.fill(0)
    return out.withColumn("total", sum((F.col(r) for r in RATINGS[1:]), F.col(RATINGS[0])))


def weight(rating: Column) -> Column:
    return F.when(rating == "correct", 1.0).when(rating == "partial", 0.5).otherwise(0.0)


def precision_recall(ratings: DataFrame, *keys: str) -> DataFrame:
    """keys, n, precision (C + P/2)/n, missing, recall (C + P/2)/(n + missing); null without ratings."""
    rated = F.col("rating") != "missing"
    out = ratings.groupBy(*keys).agg(F.sum(rated.cast("long")).alias("n"), F.sum(weight(F.col("rating"))).alias("hits"), F.sum((~rated).cast("long")).alias("missing"))
    return out.select(*keys, "n", "missing", (F.col("hits") / F.nullif("n", F.lit(0))).alias("precision"), (F.col("hits") / F.nullif(F.col("n") + F.col("missing"), F.lit(0))).alias("recall"))


def precision_rollup(ratings: DataFrame, key: str) -> DataFrame:
    """Rows by key and a grand total (null key) weighted by ratings."""
    rated = F.col("rating") != "missing"
    out = ratings.where(rated).rollup(key).agg(F.count(F.lit(1)).alias("n"), F.avg(weight(F.col("rating"))).alias("precision"))
    return out.select(key, "n", "precision")


def consensus(ratings: DataFrame, *keys: str) -> DataFrame:
    """keys, consensus, votes, n_reviewers, action: the most frequent rating, ties in the order of RATINGS."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RATINGS]), F.col("rating"))
    votes = ratings.groupBy(*keys, "rating").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(*keys).agg(F.sum("votes").alias("n_reviewers"), F.min(F.struct((-F.col("votes")).alias("v"), rank.alias("k"), "rating")).alias("best"))
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return best.select(*keys, F.col("best.rating").alias("consensus"), (-F.col("best.v")).alias("votes"), "n_reviewers", action[F.col("best.rating")].alias("action"))


def reviewer_pairs(ratings: DataFrame, *item: str) -> DataFrame:
    """a < b: ratings of the same item by two reviewers."""
    a = ratings.select(*item, F.col("reviewer").alias("a"), F.col("rating").alias("rating_a"))
    b = ratings.select(*item, F.col("reviewer").alias("b"), F.col("rating").alias("rating_b"))
    return a.join(b, list(item)).where("a < b")


def cohen_kappa(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys, n, agreement, kappa of (rating_a, rating_b) rows; 1 if chance agreement is complete."""
    cell = pairs.groupBy(*keys, "rating_a", "rating_b").agg(F.count(F.lit(1)).alias("c"))
    side = lambda col: cell.groupBy(*keys, F.col(col).alias("rating")).agg(F.sum("c").alias(col))
    both = [*keys, "rating"]
    chance = side("rating_a").join(side("rating_b"), both).groupBy(*keys).agg(F.sum(F.col("rating_a") * F.col("rating_b")).alias("x"))
    total = cell.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("rating_a") == F.col("rating_b"), F.col("c")).otherwise(0)).alias("same"))
    row = total.join(chance, list(keys), "left") if keys else total.join(F.broadcast(chance))
    po, pe = F.col("same") / F.col("n"), F.coalesce("x", F.lit(0)) / (F.col("n") * F.col("n"))
    return row.select(*keys, "n", po.alias("agreement"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def agreement(ratings: DataFrame, *item: str) -> DataFrame:
    """item, n_reviewers, status: agreed, disagreed or single."""
    out = ratings.groupBy(*item).agg(F.countDistinct("reviewer").alias("n_reviewers"), F.min("rating").alias("lo"), F.max("rating").alias("hi"))
    return out.select(*item, "n_reviewers", F.when(F.col("n_reviewers") == 1, "single").when(F.col("lo") == F.col("hi"), "agreed").otherwise("disagreed").alias("status"))


def missing_by_chapter(rows: DataFrame, placeholder: str = "(no chapter)") -> DataFrame:
    """chapter, n of proposed triples; blank chapters under a placeholder."""
    return rows.groupBy(F.coalesce(F.nullif(F.trim("chapter"), F.lit("")), F.lit(placeholder)).alias("chapter")).agg(F.count(F.lit(1)).alias("n"))


def sweep_quality(survivors: DataFrame, answers: DataFrame) -> DataFrame:
    """threshold, k, survivors, rated, validity, type_ok, direction_ok of each setting (G40, J10). survivors: threshold, k, id."""
    rows = survivors.join(answers, "id", "left")
    ok = lambda c, good: F.avg(F.when(F.col(c).isNull(), None).when(F.col(c) == good, 1.0).otherwise(0.0))
    return rows.groupBy("threshold", "k").agg(F.count(F.lit(1)).alias("survivors"), F.count("valid").alias("rated"), ok("valid", "Ya").alias("validity"), ok("type_ok", "Benar").alias("type_ok"), ok("direction", "Benar").alias("direction_ok"))


def report_lines(title: str, rows: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a small result."""
    names = rows.columns
    lines = [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect()]
    return "\n".join(lines) + "\n"


def write_bundle(tables: dict[str, DataFrame], path: str, title: str, mode: str = "errorifexists") -> DataFrame:
    """Write each table as CSV with a header under ``path``/name, and a Markdown page with their rows and columns; table, n, columns.

    Arrays, maps and structs are JSON in the CSV. The counts are those of the files written.
    """
    out = None
    for k, (name, df) in enumerate(tables.items()):
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        flat.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/{name}")
        rows = df.sparkSession.read.schema(flat.schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(f"{path}/{name}")
        row = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), F.lit(name).alias("table"), "n", F.lit(", ".join(df.columns)).alias("columns"))
        out = row if out is None else out.unionByName(row)
    out = out.orderBy("k").drop("k").coalesce(1)  # a row for each table
    page = df.sparkSession.createDataFrame([(report_lines(title, out),)], "value string")
    page.coalesce(1).write.mode(mode).text(f"{path}/README")
    return out


def ranked(df: DataFrame, order: list, *keys: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

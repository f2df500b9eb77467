"""Readers with explicit schemas (S01-S05, S07-S21). All paths go through Spark, so any store Spark reads will do."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

REVIEW_NAME = r"^(?:(?<reviewer>[A-Za-z0-9._-]+?)__)?(?<course>.+?)(?:\.(?<stamp>[0-9T:-]+))?\.json$"


def books(spark: SparkSession, path: str) -> DataFrame:
    """Nested books."""
    return spark.read.schema(schemas.BOOK).json(path, multiLine=True)


def edge_dump(spark: SparkSession, path: str) -> DataFrame:
    """Rows of staged edges and their position in the dump: from an object with ``edges``, or from a bare list."""
    wrapped = spark.read.schema(schemas.EDGE_DUMP).json(path, multiLine=True).where("edges is not null").selectExpr("posexplode(edges) as (position, e)").select("e.*", F.col("position").cast("long"))
    bare = spark.read.schema(schemas.STAGED_EDGE).json(path, multiLine=True).withColumn("position", F.monotonically_increasing_id()).where("rel_type is not null")
    return wrapped.unionByName(bare)


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviewer payloads with reviewer and course from the file name '<reviewer>__<course>.json'; no reviewer is 'default' (S03, S04)."""
    raw = spark.read.schema(schemas.REVIEW_FILE).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    name = lambda k: F.regexp_extract("file", REVIEW_NAME, k)
    return raw.withColumns({"reviewer": F.lower(F.coalesce(F.nullif(name(1), F.lit("")), F.lit("default"))), "course": name(2)}).where(F.col("ratings").isNotNull() | F.col("missingTriples").isNotNull())


def latest(paths: list[str]) -> str:
    """The last snapshot folder by name."""
    if not paths:
        raise FileNotFoundError("no snapshot folder")
    return max(paths)


def survey(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all strings, a byte-order mark taken off the first name."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def low_confidence(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOW_CONFIDENCE).csv(path, header=True, escape='"')


def survey_answers(spark: SparkSession, path: str) -> DataFrame:
    """id and answer fields of a JSON map of answers."""
    raw = spark.read.schema(f"answers MAP<STRING, STRUCT<{schemas.SURVEY_ANSWER}>>").json(path, multiLine=True)
    return raw.select(F.explode("answers").alias("id", "a")).select("id", "a.*")


def key_values(dump: DataFrame, prefix: str) -> DataFrame:
    """reviewer, course, payload of 'prefix reviewer:course' keys; text that is no JSON object is left out (S08). dump: key, value."""
    rows = dump.where(F.col("key").startswith(prefix)).withColumn("rest", F.substring("key", len(prefix) + 1, 1_000_000))
    payload = F.from_json("value", schemas.REVIEW_FILE, {"mode": "PERMISSIVE"})
    parts = F.split("rest", ":", 2)
    rows = rows.where(F.trim("value").startswith("{")).select(F.get(parts, F.lit(0)).alias("reviewer"), F.get(parts, F.lit(1)).alias("course"), payload.alias("payload"))
    return rows.where("payload is not null and course is not null and (payload.ratings is not null or payload.missingTriples is not null)")


def graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges as Parquet, also as views of these names."""
    n, e = spark.read.schema(schemas.NODES).parquet(f"{folder}/nodes"), spark.read.schema(schemas.EDGES).parquet(f"{folder}/edges")
    n.createOrReplaceTempView("nodes")
    e.createOrReplaceTempView("edges")
    return n, e


def connection(name: str, explicit: dict[str, str] | None = None, defaults: dict[str, str] | None = None, env: dict[str, str] | None = None) -> dict[str, str]:
    """Options of a connection: explicit, then environment (NAME_OPTION), then defaults (S07). Nothing secret has a default."""
    env = dict(os.environ) if env is None else env
    start = f"{name.upper()}_"
    found = {k[len(start) :].lower(): v for k, v in env.items() if k.startswith(start) and v}
    return {**(defaults or {}), **found, **{k: v for k, v in (explicit or {}).items() if v}}


def pages(spark: SparkSession, path: str, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """book, page, text of documents, one parser call for each file (S09). The parser is a parameter; none comes with the library."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                texts = parser(content)
                yield pd.DataFrame({"book": p.rsplit("/", 1)[-1].rsplit(".", 1)[0], "page": range(1, len(texts) + 1), "text": texts})

    return files.mapInPandas(run, "book string, page int, text string")


def font_blocks(spark: SparkSession, path: str, parser: Callable[[bytes], list[dict]]) -> DataFrame:
    """book, page, block, text, size, flags."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = ["book", "page", "block", "text", "size", "flags"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                book = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pd.DataFrame([{"book": book, **b} for b in parser(content)], columns=names)

    return files.mapInPandas(run, "book string, page int, block int, text string, size double, flags int")


def cached_vectors(texts: DataFrame, cache: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with their vector, rows without): zero vectors count as missing."""
    good = cache.where(F.exists("vector", lambda e: e != 0)).select(F.col("key").alias("_k"), "vector")
    keyed = texts.withColumn("_k", key)
    return keyed.join(good, "_k").drop("_k"), keyed.join(good, "_k", "left_anti").drop("_k")


def concepts_for_completion(nodes: DataFrame, edges: DataFrame, document: str | None = None, cross: bool = False) -> DataFrame:
    """id, name, grade, description of concepts: of one document, of it and all others, or of all; the first of an id wins."""
    c = nodes.where("label in ('Konsep', 'Concept', 'SubKonsep')").select("id", "name", F.coalesce("grade", F.lit("")).alias("grade"), "description")
    if document is not None and not cross:
        c = c.where(F.col("grade") == document)
    linked = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst"))).distinct()
    return c.join(linked.withColumn("linked", F.lit(True)), "id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def documents_with_counts(nodes: DataFrame) -> DataFrame:
    """grade, concepts: distinct concepts of each grade, grades without any at 0."""
    g = nodes.where("label in ('Grade', 'Document')").select(F.col("name").alias("grade"))
    c = nodes.where("label in ('Concept', 'Konsep')").groupBy("grade").agg(F.countDistinct("name").alias("concepts"))
    return g.join(c, "grade", "left").select("grade", F.coalesce("concepts", F.lit(0)).alias("concepts"))


def topics(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """id, children: names below a node by a kind of edge, sorted, empty for none."""
    below = edges.where(F.col("rel_type") == kind).join(nodes.select(F.col("id").alias("dst"), "name"), "dst").groupBy("src").agg(F.sort_array(F.collect_set("name")).alias("children"))
    return nodes.select("id").join(below.withColumnRenamed("src", "id"), "id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def similar_edges(edges: DataFrame) -> DataFrame:
    """SIMILAR_TO edges, best first."""
    return edges.where("rel_type = 'SIMILAR_TO'").orderBy(F.desc("score"), "src", "dst")


def typed_edges(edges: DataFrame, types: tuple[str, ...], prefix: str) -> DataFrame:
    """Edges of listed types or of a prefix."""
    return edges.where(F.col("rel_type").isin(*types) | F.col("rel_type").startswith(prefix)).orderBy("rel_type", "src", "dst")


def fields_of(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Classifier fields of the named concepts."""
    return nodes.join(names.select("name").distinct(), "name", "left_semi").select("id", "name", "grade", "description", "materi_pokok_ref")


def listing(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path, length, modificationTime of files without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")

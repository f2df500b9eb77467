"""Retrieval queries: embeddings are concepts, their label is the book."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import candidates as C
from ..operators import similarity as S
from ..operators import vector_index as V
from ..operators.compare import group_pairs
from ..operators.tables import cut, shared_dir

THRESHOLD, K = 0.65, 10
#: Entries of an embedding.
DIMENSION = 64

#: All scored ordered pairs, for the oracles.
_SCORED = """
v as (select cast(vec_id as varchar) as id, cast(label as varchar) as grade, cast(embedding as double[]) as e from embeddings),
s as materialized (select a.id as source, b.id as target, a.grade as source_grade, b.grade as target_grade,
             round((1 + list_cosine_similarity(a.e, b.e)) / 2, 6) as score from v a join v b on a.id <> b.id)
"""
_TOP = f"t as (select * from (select *, row_number() over (partition by source order by score desc, target) as rank from s) where rank <= {K})"


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("grade"))


def index(spark: SparkSession, sf_dir: str) -> V.VectorIndex:
    """The index of the embeddings, with their labels as groups: built once for an application and a set of files."""
    e = table(spark, sf_dir, "embeddings")
    key = hashlib.sha256("\n".join([sf_dir, *sorted(e.inputFiles())]).encode()).hexdigest()[:16]
    rows = S.vectors(e, "vec_id", "embedding").join(_grades(spark, sf_dir), "id")
    return V.ensure(rows, f"{shared_dir(spark)}/indexes-{key}", "embeddings", DIMENSION, "grade")


def _top(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return S.neighbours(None, index(spark, sf_dir), k)


def _pairs(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    return C.candidate_pairs(_top(spark, sf_dir), _grades(spark, sf_dir), threshold)


_PAIRS = f"""with {_SCORED}, {_TOP},
p as (select least(source, target) as a, greatest(source, target) as b, max(score) as score,
  any_value(case when source < target then source_grade else target_grade end) as grade_a, any_value(case when source < target then target_grade else source_grade end) as grade_b
  from t where score >= {THRESHOLD} and source_grade <> target_grade group by 1, 2)"""


@query("candidate_pairs", f"{_PAIRS} select a, b, grade_a, grade_b, score from p")
def candidate_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("topk_after_filter", f"""with {_SCORED} select source, target, score, cast(rank as integer) as rank from (
  select *, row_number() over (partition by source order by score desc, target) as rank from s where source_grade <> target_grade) where rank <= 3""")
def topk_after_filter(spark, sf_dir):
    return S.neighbours(None, index(spark, sf_dir), 3, group="grade")


@query("vector_index_state", """with v as (select len(embedding) as d, count(*) as n from embeddings where embedding is not null and len(embedding) > 0 group by 1)
select 'embeddings' as model, cast(d as integer) as dimension, cast(n as bigint) as n, cast(1 as integer) as version, n as indexed, n as ids from v
union all select 'halves', cast(d // 2 as integer), n, 1, n, n from v""")
def vector_index_state(spark, sf_dir):
    """What is left after an index of one model was built twice and one of another after a change of dimension."""
    e, path = S.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    V.ensure(e, path, "embeddings", DIMENSION)
    V.ensure(e, path, "embeddings", DIMENSION)
    V.create(e.select("id", F.slice("v", 1, DIMENSION // 4).alias("v")), path, "halves")
    V.create(e.select("id", F.slice("v", 1, DIMENSION // 2).alias("v")), path, "halves")
    rows = None
    for model in ("embeddings", "halves"):
        found = V.load(spark, path, model)
        held = found.blocks.agg(F.sum("n").alias("indexed")).withColumn("model", F.lit(model)).join(found.ids.agg(F.countDistinct("id").alias("ids")).withColumn("model", F.lit(model)), "model")
        rows = held if rows is None else rows.unionByName(held)
    return V.describe(spark, path).select("model", "dimension", "n", "version").join(rows, "model")


@query("knn_rank_both_ways", f"""with {_SCORED}, r as (select source, target, rank() over (partition by source order by score desc) as rank from s),
p as (select least(source, target) as a, greatest(source, target) as b, cast(max(rank) filter (source < target) as integer) as rank_ab, cast(max(rank) filter (source > target) as integer) as rank_ba from r group by 1, 2)
select a, b, rank_ab, rank_ba, least(rank_ab, rank_ba) as best_rank from p where least(rank_ab, rank_ba) <= 5""")
def knn_rank_both_ways(spark, sf_dir):
    vectors = index(spark, sf_dir)
    top = cut(S.neighbours(None, vectors, 5, ties=True).select("source", "target", "score", "rank"))
    back = S.ranks_of(top.select(F.col("target").alias("source"), F.col("source").alias("target"), "score"), None, vectors).select("source", "target", "rank")
    ranks = top.select("source", "target", "rank").unionByName(back)
    way = lambda ahead: F.max(F.when((F.col("source") < F.col("target")) == ahead, F.col("rank")))
    pairs = ranks.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(way(F.lit(True)).alias("rank_ab"), way(F.lit(False)).alias("rank_ba"))
    return pairs.withColumn("best_rank", F.least("rank_ab", "rank_ba"))


@query("group_pair_counts", f"{_PAIRS} select least(grade_a, grade_b) || ' <-> ' || greatest(grade_a, grade_b) as pair, count(*) as n from p group by 1")
def group_pair_counts(spark, sf_dir):
    return group_pairs(_pairs(spark, sf_dir), "grade_a", "grade_b")


_GRID = "(values (0.60, 10), (0.62, 10), (0.65, 10), (0.65, 3), (0.70, 1)) as g(threshold, k)"


@query("sweep_survivors", f"""with {_SCORED}, {_TOP} select cast(threshold as double) as threshold, k, count(source) as n_links, count(distinct source) as n_nodes
from {_GRID} left join t on score >= threshold and rank <= k group by 1, 2""")
def sweep_survivors(spark, sf_dir):
    grid = spark.createDataFrame([(0.60, 10), (0.62, 10), (0.65, 10), (0.65, 3), (0.70, 1)], "threshold double, k int")
    top = _top(spark, sf_dir)
    hit = (F.col("score") >= F.col("threshold")) & (F.col("rank") <= F.col("k"))
    rows = grid.join(top, hit, "left")  # a stated grid of a few settings
    return rows.groupBy("threshold", "k").agg(F.count("source").alias("n_links"), F.countDistinct("source").alias("n_nodes"))


@query("threshold_coverage", f"""with {_SCORED}, m as (select source, max(score) as top from s group by 1)
select cast(threshold as double) as threshold, avg(case when top >= threshold then 1.0 else 0.0 end) as share from m cross join (values (0.60), (0.65), (0.68), (0.70)) as g(threshold) group by 1""")
def threshold_coverage(spark, sf_dir):
    best = S.best_of_node(_top(spark, sf_dir, 1))
    steps = F.explode(F.array(*[F.lit(x) for x in (0.60, 0.65, 0.68, 0.70)]))
    return best.select("top", steps.alias("threshold")).groupBy("threshold").agg(F.avg(F.when(F.col("top") >= F.col("threshold"), 1.0).otherwise(0.0)).alias("share"))


@query("pairs_without_existing_edge", f"""{_PAIRS}, e as (select distinct least(cast(l_partkey as varchar), cast(l_suppkey as varchar)) as a, greatest(cast(l_partkey as varchar), cast(l_suppkey as varchar)) as b
from lineitem where l_returnflag <> 'N') select a, b, score from p anti join e using (a, b)""")
def pairs_without_existing_edge(spark, sf_dir):
    end = lambda c: F.col(c).cast("string")
    edges = table(spark, sf_dir, "lineitem").select(end("l_partkey").alias("src"), end("l_suppkey").alias("dst"), F.when(F.col("l_returnflag") == "N", "SIMILAR_TO").otherwise("TYPED").alias("rel_type"))
    return C.without_existing(_pairs(spark, sf_dir), edges).select("a", "b", "score")


@query("embedding_misses", """select cast(vec_id as varchar) as id from embeddings where label >= 5""")
def embedding_misses(spark, sf_dir):
    nodes = _grades(spark, sf_dir)
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("node_id"), F.when(F.col("label") < 5, "m1").otherwise("m0").alias("model"))
    return C.stale(nodes, stored, "m1").select("id")


@query("anchor_cap", f"""{_PAIRS}, x as (select a, b, score, unnest([a, b]) as anchor from p), r as (select *, row_number() over (partition by anchor order by score desc, a, b) as r from x)
select distinct a, b, score from r where r <= 2""")
def anchor_cap(spark, sf_dir):
    return C.anchor_cap(_pairs(spark, sf_dir), 2)


@query("merged_ranking", f"""with {_SCORED}, {_TOP} select source, target, score, cast(rank as integer) as rank from (
  select *, row_number() over (partition by source order by score desc, target) as rank from (select distinct source, target, score from t where target_grade <> source_grade or target_grade <= '4')) where rank <= 4""")
def merged_ranking(spark, sf_dir):
    g = _grades(spark, sf_dir)
    rows = cut(_top(spark, sf_dir)).join(g.toDF("source", "sg"), "source").join(g.toDF("target", "tg"), "target")
    return S.merged_ranking(rows.where("sg <> tg"), rows.where("tg <= '4'"), 4)

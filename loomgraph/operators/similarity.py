"""Nearest neighbours of concept vectors (J04, J05, X15) and ranks over them.

Scores are (1 + cosine)/2 by default, or the raw cosine. Self is excluded by node id before the cut at k
unless ``self_in_k`` asks for the live index's habit of spending a place on it.

All searches are exact and run on a ``VectorIndex``; a DataFrame of vectors gets one for the occasion, in the shared folder. Only k rows (and
ties of the k-th, where asked for) of each query leave a task, groups are told apart inside it.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vector_index as V
from .tables import cut, shared_dir


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id string, v array<double>) without null, empty and zero vectors."""
    v = F.transform(vec_col, lambda e: e.cast("double"))
    out = df.select(F.col(id_col).cast("string").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    return out.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e)) & F.exists("v", lambda e: e != 0))


def index_of(data: DataFrame | V.VectorIndex, group: str | None = None) -> V.VectorIndex:
    """The index itself, or one built for (id, v[, group]) rows."""
    if isinstance(data, V.VectorIndex):
        if group and not data.grouped:
            raise ValueError(f"the index of {data.model} holds no groups")
        return data
    return V.create(data, f"{shared_dir(data.sparkSession)}/index-{uuid.uuid4().hex}", "own", group)


def _own_block(k: int, raw: bool, self_in_k: bool, by_group: bool):
    """What k rows of a query's own block reach already."""

    def floor(b: V.Block, _) -> np.ndarray:
        s = V.scores(b, b, raw, self_in_k, by_group)
        return -np.partition(-s, k - 1, axis=1)[:, k - 1] if k <= s.shape[1] else np.full(len(s), -np.inf)

    return floor


def _nothing(b: V.Block, _) -> np.ndarray:
    return np.full(len(b.ids), -np.inf)


def visited_share(index: V.VectorIndex, k: int, raw: bool = False) -> float:
    """Share of all pairs of rows in pairs of blocks that a search for k neighbours of all rows may visit; blocks ruled out on the way are counted too."""
    pairs = V.candidate_blocks(index.blocks, index, _own_block(k, raw, False, False), raw)
    size = lambda c: index.blocks.select(F.col("block").alias(c), F.col("n").alias(f"n_{c}"))
    met = pairs.join(size("q"), "q").join(size("block"), "block").agg(F.sum(F.col("n_q") * F.col("n_block").cast("double"))).first()[0]
    return (met or 0.0) / max(1, index.n) ** 2


def neighbours(queries: DataFrame | None, data: DataFrame | V.VectorIndex, k: int, raw: bool = False, self_in_k: bool = False, group: str | None = None, ties: bool = False) -> DataFrame:
    """source, target, score, rank: the k best targets of each source, ties to the smaller id.

    Queries are (id, v[, group]) rows, or all rows of the index (None). With ``group``, only targets of another known group count, before the cut at k (P08,
    W11). With ``ties``, the rank is 1 + the number of strictly better targets, and all targets of rank k or better stay (W03).
    """
    index, own = index_of(data, group), queries is None
    rows, floor = (index.blocks, _own_block(k, raw, self_in_k, bool(group))) if own else (V.blocks_of(queries, index, group), _nothing)
    found = V.visit(rows, index, floor, lambda b, _: V.Nearest(b, k, raw, self_in_k, bool(group), ties), "source string, target string, score double", raw)
    order = Window.partitionBy("source").orderBy(F.desc("score"), *([] if ties else ["target"]))
    return found.withColumn("rank", F.rank().over(order) if ties else F.row_number().over(order)).where(F.col("rank") <= k).where("source <> target")


def links(data: DataFrame | V.VectorIndex, least: float, raw: bool = False) -> DataFrame:
    """source, target: pairs of rows of at least a score, as many as it takes to connect all that such pairs connect; no number of partners is dropped.

    A task hands out a pair only if it joins two components of what the task has seen: fewer pairs than its rows, however many reach the score.
    """
    index = index_of(data)
    floor = lambda b, _: np.full(len(b.ids), least)
    return V.visit(index.blocks, index, floor, lambda b, _, joined: V.Links(b, least, raw, joined), "source string, target string", raw, shared=V.Joined)


def ranks_of(pairs: DataFrame, queries: DataFrame | None, data: DataFrame | V.VectorIndex, raw: bool = False) -> DataFrame:
    """source, target, score, rank of the given pairs (source, target, score), sources among the queries as in ``neighbours``: 1 + the number of targets that suit the source strictly better.

    A rank hangs on source and score, so each source asks for the distinct (rounded) scores of its pairs; blocks that hold nothing better are
    not visited, counts of the others are added up. No other pair becomes a row.
    """
    asked = pairs.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set("score")).alias("asked"))
    index = index_of(data)
    blocks = index.blocks if queries is None else V.blocks_of(queries, index, None)
    places = blocks.select("block", F.posexplode("ids").alias("pos", "id")).join(asked, "id", "left")
    none = F.array().cast("array<double>")
    of_block = cut(places.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("asked", none).alias("asked")))).alias("a"), F.count("asked").alias("n")).where("n > 0"))
    rows = blocks.join(of_block.select("block", F.transform("a", lambda x: x["asked"]).alias("asked")), "block")

    def floor(_, asked_of) -> np.ndarray:
        return np.array([min(a, default=np.inf) for a in asked_of])

    found = V.visit(rows, index, floor, lambda b, a: V.Better(b, a, raw), "source string, score double, better bigint", raw, "asked")
    ranks = found.groupBy("source", "score").agg((F.sum("better") + 1).cast("int").alias("rank"))
    return pairs.select("source", "target", "score").join(ranks, ["source", "score"])


def top_after_filter(pairs: DataFrame, condition, k: int) -> DataFrame:
    """k best of each source among the pairs that meet the condition."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))
    return pairs.where(condition).withColumn("rank", rank).where(F.col("rank") <= k)


def competition_rank(pairs: DataFrame) -> DataFrame:
    """rank = 1 + number of strictly better targets of the source, over pairs that are all there."""
    return pairs.withColumn("rank", F.rank().over(Window.partitionBy("source").orderBy(F.desc("score"))))


def best_of_node(pairs: DataFrame) -> DataFrame:
    """source, top: the best score of each node."""
    return pairs.groupBy("source").agg(F.max("score").alias("top"))


def merged_ranking(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Two ranked lists as one, each target once with its best score, cut at k."""
    both = first.select("source", "target", "score").unionByName(second.select("source", "target", "score"))
    both = both.groupBy("source", "target").agg(F.max("score").alias("score"))
    return top_after_filter(both, F.lit(True), k)

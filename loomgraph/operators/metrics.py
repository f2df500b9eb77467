"""Counters, ratios and structural metrics of a graph held as nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import STRUCTURAL, WITHIN_BOOK
from .order_statistics import values_at
from .tables import spread


def share(condition: Column) -> Column:
    """Share of rows that meet a condition; null counts as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def filled(column: str) -> Column:
    """Not null and not empty; an empty string counts like null."""
    return F.nullif(F.trim(F.col(column)), F.lit("")).isNotNull()


def counts_by(df: DataFrame, *keys: str, least: int = 0, top: int | None = None) -> DataFrame:
    """keys, n: counts in descending order, ties by key; HAVING and LIMIT as options."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return out.orderBy(F.desc("n"), *keys).limit(top) if top is not None else out


def shares_by(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n, share of the total."""
    out = counts_by(df, *keys)
    # counts per key are few; the total is one more aggregation, not a window over one partition
    total = out.agg(F.sum("n").alias("total"))
    return out.join(F.broadcast(total)).select(*keys, "n", (F.col("n") / F.col("total")).alias("share"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """a < b: the simple undirected projection without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame, undirected_simple: bool = False) -> DataFrame:
    """id, degree, zero included: of the multigraph, or of its simple projection."""
    pairs = simple_edges(edges).toDF("src", "dst") if undirected_simple else edges.select("src", "dst")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n, m, directed m/(n(n-1)) and, of the simple projection, undirected 2m/(n(n-1))."""
    n, m, s = (df.agg(F.count(F.lit(1)).alias(c)) for df, c in ((nodes, "n"), (edges, "m"), (simple_edges(edges), "s")))
    row = n.join(F.broadcast(m)).join(F.broadcast(s))
    pairs = F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))
    return row.select("n", "m", (F.col("m") / pairs).alias("directed"), (2 * F.col("s") / pairs).alias("undirected"))


def average_degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The three definitions in use: m/n, multigraph mean degree/(n-1), simple mean degree/(n-1)."""
    def mean(simple: bool, name: str) -> DataFrame:
        return degrees(nodes, edges, simple).agg(F.avg("degree").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    row = mean(False, "multi").join(F.broadcast(mean(True, "simple"))).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("m"))))
    others = F.nullif(F.col("n_multi") - 1, F.lit(0))
    return row.select(
        (F.col("m") / F.nullif("n_multi", F.lit(0))).alias("per_node"), F.col("multi").alias("mean_degree"), (F.col("multi") / others).alias("multigraph"), (F.col("simple") / others).alias("simple")
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label counters, edge counters and averages in one row: a pass over nodes and one over edges."""
    a = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("label").alias("labels"), F.sum(filled("description").cast("long")).alias("described"), F.countDistinct("name").alias("names"))
    b = edges.agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("rel_type").alias("types"), F.countDistinct("src", "dst").alias("joined"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"),
        F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.avg("confidence").alias("mean_confidence"),
    )
    return a.join(F.broadcast(b))


#: Counters of a graph row: labels of nodes and types of edges.
NODE_COUNTERS = {"subjects": "MataPelajaran", "documents": "Document", "babs": "Bab", "sub_babs": "SubBab", "konsep": "Konsep", "sub_konsep": "SubKonsep"}
EDGE_COUNTERS = {"similar_rels": ("SIMILAR_TO",), "prereq_rels": ("isPrerequisiteOf",), "supports_rels": ("supports",), "analogous_rels": ("analogousTo",), "inline_rels": WITHIN_BOOK}


def graph_counters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of six node and five edge counters, and topics and subtopics, older names of konsep and sub_konsep."""
    a = nodes.agg(*[F.count_if(F.col("label") == label).alias(n) for n, label in NODE_COUNTERS.items()])
    b = edges.agg(*[F.count_if(F.col("rel_type").isin(*types)).alias(n) for n, types in EDGE_COUNTERS.items()])
    return a.join(F.broadcast(b)).withColumns({"topics": F.col("konsep"), "subtopics": F.col("sub_konsep")})


def listing(nodes: DataFrame, which: str, top: int = 50) -> DataFrame:
    """The first concepts or chapters by name of a quality list: without subject matter, validated against the glossary, or chapters with a summary."""
    concept = F.col("label") == "Concept"
    rows = nodes.where({"no_subject_matter": concept & ~filled("materi_pokok_ref"), "validated": concept & F.col("glossary_validated"), "summarised": (F.col("label") == "Chapter") & F.col("description").isNotNull()}[which])
    return rows.select("id", "name", "description", "materi_pokok_ref").orderBy("name", "id").limit(top)


def by_provenance(df: DataFrame, *wanted: str) -> DataFrame:
    """Rows of the wanted provenances; unmarked rows are of the extraction (P25)."""
    return df.where(F.coalesce("provenance", F.lit("extraction")).isin(*wanted))


def typed_ratio(edges: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Share of edges of an allow-list, and share not structural: the two definitions in use."""
    return edges.agg(share(F.col("rel_type").isin(*allowed)).alias("allowed"), share(~F.col("rel_type").isin(*STRUCTURAL)).alias("not_structural"))


def inbound(nodes: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """name, n: most referenced nodes, unreferenced ones with 0."""
    n = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(n, nodes.id == n.dst, "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "id").limit(top)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """dst, n: targets that are no node, with the edges affected."""
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def symmetric(edges: DataFrame) -> DataFrame:
    """a < b, rel_type: edges that also exist the other way."""
    ends = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    e = spread(edges.where("src <> dst").select(*ends, "rel_type", (F.col("src") < F.col("dst")).alias("_ahead")), "a", "b", "rel_type")
    both = e.groupBy("a", "b", "rel_type").agg(F.min("_ahead").alias("_all"), F.max("_ahead").alias("_any"))
    return both.where("_any and not _all").select("a", "b", "rel_type")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """src, dst, rel_type, extra copies."""
    return edges.groupBy("src", "dst", "rel_type").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


def endpoint_coverage(nodes: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """touched, nodes, coverage and orphan_rate, of each group of ``keys`` if there are any: shares of nodes that some edge touches or none does."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("touched", F.lit(True))
    met = F.coalesce("touched", F.lit(False))
    return nodes.select("id", *keys).join(touched, "id", "left").groupBy(*keys).agg(F.count("touched").alias("touched"), F.count(F.lit(1)).alias("nodes"), share(met).alias("coverage"), share(~met).alias("orphan_rate"))


def orphans(nodes: DataFrame, edges: DataFrame, filler: Column | None = None) -> DataFrame:
    """Nodes without an edge other than filler."""
    real = edges if filler is None else edges.where(~F.coalesce(filler, F.lit(False)))
    return nodes.join(real.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")


def bridges(edges: DataFrame, groups: int = 2) -> DataFrame:
    """id, others: nodes whose partners lie in at least so many other groups (G30). edges: src, dst, src_group, dst_group."""
    ways = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("src_group").alias("own"), F.col("dst_group").alias("other")), F.struct(F.col("dst").alias("id"), F.col("dst_group").alias("own"), F.col("src_group").alias("other")))).alias("w")).select("w.*")
    return ways.where("own <> other").groupBy("id").agg(F.countDistinct("other").alias("others")).where(F.col("others") >= groups)


def summary_by(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, n, mean, median, low, high; the median lies midway between the two middle values."""
    n = F.col("n")
    middle = values_at(df, value, list(keys), {"_below": F.floor((n - 1) / 2), "_above": F.floor(n / 2)})
    means = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    on = [F.col(f"_k{i}").eqNullSafe(middle[k]) for i, k in enumerate(keys)] or [F.lit(True)]
    median = middle["_below"] + (middle["_above"] - middle["_below"]) / 2
    return means.join(middle, on, "left").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], means["n"], "mean", median.cast("double").alias("median"), "low", "high")


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bucket, low, high, n of half-open buckets, the last one closed; empty ones kept."""
    cases = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        last = k == len(edges) - 2
        inside = (F.col(value) >= edges[k]) & (F.col(value) <= edges[k + 1] if last else F.col(value) < edges[k + 1])
        cases = F.when(inside, F.lit(k)).otherwise(cases)
    found = df.select(cases.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.createDataFrame([(k, float(edges[k]), float(edges[k + 1])) for k in range(len(edges) - 1)], "bucket int, low double, high double")
    return frame.join(found, "bucket", "left").select("bucket", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def upper_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, low, median, high, empty: the median is an element, the (n // 2)-th from 0 of the sorted values."""
    at = values_at(df, value, list(keys), {"median": F.floor(F.col("n") / 2)})
    empty = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.coalesce(F.sum((F.col(value) == 0).cast("long")), F.lit(0)).alias("empty"))
    on = [F.col(f"_k{i}").eqNullSafe(at[k]) for i, k in enumerate(keys)] or [F.lit(True)]
    return at.join(empty, on).select(*keys, "low", "median", "high", "empty")


def top_and_other(df: DataFrame, key: str, top: int, other: str = "other") -> DataFrame:
    """key, n: the most frequent values, the rest as one row."""
    c = counts_by(df, key)
    heads = c.orderBy(F.desc("n"), key).limit(top).select(F.col(key).alias("head"))
    named = c.join(F.broadcast(heads), c[key] == F.col("head"), "left").select(F.coalesce("head", F.lit(other)).alias(key), "n")
    return named.groupBy(key).agg(F.sum("n").alias("n"))


def three_way(df: DataFrame, flag: str) -> DataFrame:
    """true, false and missing values of a flag."""
    return df.agg(F.sum(F.when(F.col(flag), 1).otherwise(0)).alias("true"), F.sum(F.when(~F.col(flag), 1).otherwise(0)).alias("false"), F.sum(F.col(flag).isNull().cast("long")).alias("missing"))


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """q of a partition (id, part) over the simple undirected edges."""
    e = simple_edges(edges)
    m = e.agg(F.count(F.lit(1)).alias("m"))
    end = lambda c: parts.select(F.col("id").alias(c), F.col("part").alias(f"p{c}"))
    named = e.join(end("a"), "a").join(end("b"), "b")
    inside = named.where("pa = pb").groupBy(F.col("pa").alias("part")).agg(F.count(F.lit(1)).alias("inside"))
    total = named.select(F.explode(F.array("pa", "pb")).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("degree"))
    rows = total.join(inside, "part", "left").join(F.broadcast(m))
    return rows.agg(F.coalesce(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)), F.lit(0.0)).alias("q"))


def embedding_coverage(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """label, nodes, embedded, models."""
    have = stored.groupBy(F.col("node_id").alias("id")).agg(F.sort_array(F.collect_set("model")).alias("models"))
    rows = nodes.select("id", "label").join(have, "id", "left")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.count("models").alias("embedded"))
    names = rows.select("label", F.explode("models").alias("model")).groupBy(F.col("label").alias("_label")).agg(F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))
    return counts.join(names, F.col("label").eqNullSafe(F.col("_label")), "left").select("label", "nodes", "embedded", F.coalesce("models", F.lit("")).alias("models"))


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """stage, position, n: measured counts of a chain of frames."""
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), F.lit(k).alias("position"), "n") for k, (name, df) in enumerate(stages)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# Theory metrics (G48), closed forms over small aggregates.


def type_entropy(edges: DataFrame) -> DataFrame:
    """Shannon entropy, in bits, of the relation types."""
    s = shares_by(edges, "rel_type")
    return s.agg((-F.sum(F.col("share") * F.log2("share"))).alias("entropy"))


def cross_domain_ratio(edges: DataFrame, nodes: DataFrame, domain: str = "grade") -> DataFrame:
    """n, ratio: edges whose ends both have a domain, and the share of them that lead to another one."""
    end = lambda c: nodes.where(filled(domain)).select(F.col("id").alias(c), F.col(domain).alias(f"_{c}"))
    rows = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst")
    return rows.agg(F.count(F.lit(1)).alias("n"), share(F.col("_src") != F.col("_dst")).alias("ratio"))


def pyramid_compliance(df: DataFrame, level: str, levels: list) -> DataFrame:
    """score: 1 less the mean growth of the share from each level to the next one up; 1 if none is larger than the one below it. Other levels don't count."""
    n = [F.sum(F.when(F.col(level) == x, 1).otherwise(0)).alias(f"n{k}") for k, x in enumerate(levels)]
    total = sum((F.col(f"n{k}") for k in range(len(levels))), F.lit(0))
    growth = sum((F.greatest(F.lit(0), F.col(f"n{k + 1}") - F.col(f"n{k}")) for k in range(len(levels) - 1)), F.lit(0))
    return df.agg(*n).select(F.when(total > 0, 1 - growth / total / (len(levels) - 1)).alias("score"))


def uncertainty_rate(edges: DataFrame, floor: float) -> DataFrame:
    """n, rate: typed edges, and the share of them whose confidence is unknown or under the floor."""
    return edges.agg(F.count(F.lit(1)).alias("n"), share(F.coalesce(F.col("confidence"), F.lit(0.0)) < floor).alias("rate"))


def composite(scores: dict[str, tuple[Column, float]]) -> Column:
    """Weighted sum of scores; the weights must add up to 1."""
    if abs(sum(w for _, w in scores.values()) - 1) > 1e-9:
        raise ValueError("weights of a composite score add up to 1")
    return sum((c * w for c, w in scores.values()), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))


def interval95(p: Column, n: Column) -> tuple[Column, Column]:
    """Normal 95 % interval of a share."""
    half = 1.96 * F.sqrt(p * (1 - p) / n)
    return F.greatest(p - half, F.lit(0.0)), F.least(p + half, F.lit(1.0))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """kappa of (item, rating) rows with the same number of raters for each item."""
    cell = ratings.groupBy("item", "rating").agg(F.count(F.lit(1)).alias("n"))
    item = cell.groupBy("item").agg(F.sum("n").alias("k"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"))
    p = item.agg(F.avg(F.col("agree") / (F.col("k") * (F.col("k") - 1))).alias("p"), F.sum("k").alias("all"))
    pe = cell.groupBy("rating").agg(F.sum("n").alias("n")).join(F.broadcast(p)).groupBy("p").agg(F.sum(F.pow(F.col("n") / F.col("all"), 2)).alias("pe"))
    return pe.select(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """b, c and the continuity-corrected chi-square of two boolean columns."""
    row = pairs.agg(F.sum((F.col(a) & ~F.col(b)).cast("long")).alias("b"), F.sum((~F.col(a) & F.col(b)).cast("long")).alias("c"))
    return row.select("b", "c", F.when(F.col("b") + F.col("c") > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / (F.col("b") + F.col("c"))).alias("chi2"))


def likert(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean and sample deviation of ratings on a scale."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))

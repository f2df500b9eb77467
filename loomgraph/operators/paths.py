"""Hierarchy, paths and iterative graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import modularity, simple_edges
from .tables import cut, spread


def hierarchy(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...], outer: bool = False) -> DataFrame:
    """id_L and name_L for each label L, from the first one down along edges (J01); with ``outer``, nodes without children keep a row."""
    level = lambda label: nodes.where(F.col("label") == label).select(F.col("id").alias(f"id_{label}"), F.col("name").alias(f"name_{label}"))
    out = level(labels[0])
    for above, below in zip(labels, labels[1:], strict=False):
        step = edges.select(F.col("src").alias(f"id_{above}"), F.col("dst").alias(f"id_{below}")).join(level(below), f"id_{below}")
        out = out.join(step, f"id_{above}", "left" if outer else "inner")
    return out


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: smallest id reachable (A03, G12). Hooks to the smallest neighbour, jumps, contracts; ends when no edge is left."""
    labels = nodes.select("id", F.col("id").alias("component"))
    e = simple_edges(edges)
    e = cut(e.union(e.select("b", "a")).toDF("x", "y"))
    while not e.isEmpty():
        hooks = e.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to"))
        while True:
            hooks = cut(hooks)
            further = hooks.where("x <> to").select(F.col("x").alias("to"), F.col("to").alias("end"))
            if hooks.join(further, "to", "left_semi").isEmpty():
                break
            hooks = hooks.join(further, "to", "left").select("x", F.coalesce("end", "to").alias("to"))
        labels = cut(labels.join(hooks.toDF("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        ends = e.join(hooks.toDF("x", "p"), "x").select("y", "p").join(hooks.toDF("y", "q"), "y").where("p <> q")
        e = cut(ends.select(F.col("p").alias("x"), F.col("q").alias("y")).distinct())
    return labels


def ancestors(parents: DataFrame, depth: int) -> DataFrame:
    """node, ancestor, distance up to ``depth`` of an acyclic (child, parent) table (J12, A06): joins unrolled, one for each level."""
    level = parents.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out = level
    up = parents.toDF("ancestor", "next")
    for d in range(2, depth + 1):
        level = level.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(d).alias("distance"))
        out = out.unionByName(level)
    return out


def reachable(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """src, dst: all pairs joined by a directed path, cycles allowed; from ``start`` (src) only, if given.

    Without ``start``, sources that no edge leads to are left out of the rounds: no path goes through them, so their edges meet what the others reach once, at
    the end. A round writes only the pairs that it finds.
    """
    if start is not None:
        e = edges.select("src", "dst").distinct()
        return _closure(e.join(start, "src", "left_semi"), e)
    e = cut(spread(edges.select("src", "dst"), "src").distinct())
    led = cut(e.select(F.col("dst").alias("src")).distinct())
    inner, outer = cut(e.join(led, "src", "left_semi")), e.join(led, "src", "left_anti")
    rest = cut(_closure(inner, inner))
    further = spread(outer, "src").join(rest.toDF("dst", "next"), "dst", "left").select("src", F.explode(F.array("dst", "next")).alias("dst"))
    return rest.union(further.where("dst is not null").distinct())


def _closure(first: DataFrame, e: DataFrame) -> DataFrame:
    """src, dst: pairs of ``first`` and what edges lead to from there; each round's new pairs are a table of their own."""
    seen = fresh = cut(first)
    while not fresh.isEmpty():
        step = fresh.join(e.toDF("dst", "next"), "dst").select("src", F.col("next").alias("dst")).distinct()
        fresh = cut(step.join(seen, ["src", "dst"], "left_anti"))
        seen = seen.union(fresh)
    return seen


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, part: communities by synchronous label propagation, ties to the smaller label (A04, a cheaper approximation)."""
    e = simple_edges(edges)
    e = cut(e.union(e.select("b", "a")).toDF("x", "y"))
    labels = cut(nodes.select("id", F.col("id").alias("part")))
    for _ in range(rounds):
        votes = e.join(labels.toDF("y", "part"), "y").groupBy("x", "part").agg(F.count(F.lit(1)).alias("n"))
        votes = votes.unionByName(labels.select(F.col("id").alias("x"), "part", F.lit(1).cast("long").alias("n"))).groupBy("x", "part").agg(F.sum("n").alias("n"))
        best = votes.groupBy("x").agg(F.min(F.struct((-F.col("n")).alias("n"), "part")).alias("best")).select(F.col("x").alias("id"), F.col("best.part").alias("part"))
        new = cut(labels.join(best.toDF("id", "new"), "id", "left").select("id", F.coalesce("new", "part").alias("part"), F.col("part").alias("was")))
        if new.where("part <> was").isEmpty():
            break
        labels = new.select("id", "part")
    return labels


def greedy_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, part (least id of the community) by greedy merging for modularity.

    In each round every community names the neighbour whose merging gains most, ties to the smaller one, and communities joined by such
    choices become one, so rounds are few; choices end in two that name each other, and are followed there by pointer jumping. It ends when no
    merge gains, or when a round would lower the modularity, which is not taken. Counts are sums over the edges between communities: a round
    is a few aggregations and joins whatever the sizes. Gains are whole numbers.
    """
    e = simple_edges(edges)
    m = e.count()
    whole = lambda c: c.cast("decimal(18,0)")
    labels = cut(nodes.select("id", F.col("id").alias("part")))
    between = cut(e.union(e.select("b", "a")).toDF("x", "y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))
    best = None
    while m:
        degrees = cut(between.groupBy("x").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0)).alias("inside")))
        score = degrees.agg(F.sum(whole(F.col("inside")) * whole(F.lit(2 * m)) - whole(F.col("d")) * whole(F.col("d")))).first()[0]
        if best is not None and score <= best[0]:
            labels = best[1]
            break
        best = score, labels
        gain = whole(F.col("w")) * whole(F.lit(2 * m)) - whole(F.col("d")) * whole(F.col("dy"))
        offers = between.where("x <> y").join(degrees.select("x", "d"), "x").join(degrees.select(F.col("x").alias("y"), F.col("d").alias("dy")), "y").withColumn("gain", gain).where("gain > 0")
        chosen = cut(offers.groupBy("x").agg(F.min(F.struct((-F.col("gain")).alias("gain"), "y"))["y"].alias("y")))
        if chosen.isEmpty():
            break
        back = chosen.toDF("y", "back")
        merged = cut(chosen.join(back, "y").select("x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("y")))
        while True:
            further = cut(merged.join(merged.toDF("y", "end"), "y").select("x", "y", "end"))
            if further.where("y <> end").isEmpty():
                break
            merged = further.select("x", F.col("end").alias("y"))
        moved = lambda df, c, merged=merged: df.join(merged.toDF(c, "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        labels = cut(moved(labels, "part").select("id", "part"))
        between = cut(moved(moved(between, "x"), "y").groupBy("x", "y").agg(F.sum("w").alias("w")))
    least = labels.groupBy("part").agg(F.min("id").alias("least"))
    return labels.join(least, "part").select("id", F.col("least").alias("part"))


def best_partition(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """q and number of the communities found by greedy merging; q is 0 if there is a single one."""
    parts = greedy_communities(nodes, edges)
    many = parts.agg(F.countDistinct("part").alias("k"))
    return modularity(edges, parts).join(F.broadcast(many)).select(F.when(F.col("k") > 1, F.col("q")).otherwise(0.0).alias("q"), F.col("k").alias("communities"))


def neighbours_in_order(df: DataFrame, key: str, order: list, name: str, first=None, last=None) -> DataFrame:
    """previous and next of a column in reading order; ends take the given defaults."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({"previous": F.lag(name, 1, first).over(w), "next": F.lead(name, 1, last).over(w)})


def sections(df: DataFrame, key: str, order: list, heading) -> DataFrame:
    """Number of the section each row stands in: headings seen so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("section", F.sum(F.when(heading, 1).otherwise(0)).over(w))


#: Ranges that are broadcast, and ranges of a cell beyond that.
BROADCAST_RANGES, _CELL_RANGES, _RUN = 100_000, 64, 4096


def assign_ranges(points: DataFrame, at: str, starts: DataFrame, start: str, end: str = "_end", last=None) -> DataFrame:
    """Rows with the range [start, next start) they fall in.

    Up to ``BROADCAST_RANGES`` ranges are broadcast after a count. More of them are cut at cells of equal width, and points meet the ranges of their cell.
    """
    inside = lambda r: (points[at] >= r[start]) & (r[end].isNull() | (points[at] < r[end]))
    n = starts.count()
    if n <= BROADCAST_RANGES:
        ranges = starts.withColumn(end, F.lead(start, 1, last).over(Window.orderBy(start)))
        return points.join(F.broadcast(ranges), inside(ranges), "left")
    low, high = starts.agg(F.min(start), F.max(start)).first()
    cells = max(1, n // _CELL_RANGES)
    cell = lambda c: F.floor((F.least(F.greatest(c, F.lit(low)), F.lit(high)) - F.lit(low)) * cells / F.lit((high - low) or 1))
    s = starts.withColumn("_cell", cell(F.col(start)))
    # the next cell with a start: within runs of cells, and from one run to the next (a row for each run)
    firsts = s.groupBy("_cell").agg(F.min(start).alias("_first")).withColumn("_run", F.floor(F.col("_cell") / _RUN))
    runs = firsts.groupBy("_run").agg(F.min("_first").alias("_next")).withColumn("_next", F.lead("_next").over(Window.orderBy("_run")))
    within = F.lead("_first").over(Window.partitionBy("_run").orderBy("_cell"))
    after = firsts.withColumn("_within", within).join(runs, "_run").select("_cell", F.coalesce("_within", "_next").alias("_after"))
    own = F.lead(start).over(Window.partitionBy("_cell").orderBy(start))
    ranges = s.withColumn("_own", own).join(after, "_cell").withColumn(end, F.coalesce("_own", "_after", F.lit(last)))
    ranges = ranges.withColumn("_cell", F.explode(F.sequence("_cell", F.coalesce(cell(F.col(end)), F.lit(cells)).cast("long")))).drop("_own", "_after")
    met = points.join(ranges, (cell(points[at]) == ranges["_cell"]) & inside(ranges), "left")
    return met.drop(ranges["_cell"])

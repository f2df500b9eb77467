"""Directed graphs without cycles: strong components, the acyclic filter, prerequisite chains and their lengths.

An edge between two strongly connected components closes no cycle, so only edges inside a component are looked at in order;
elsewhere the filter is a join. Components are found by trimming (what has no way in or no way out is alone) and by forward and
backward colouring; each round is a few aggregations, rounds follow the longest path. Tables are cut in the shared folder.

Inside a component edges are decided one source after the other, by searches while these are short; where they begin to cover the component, by blocks of
sources: one pass over the graph tells for each node, as bits, which sources of a block it reaches, and a matrix of bits which of them reach one another.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, small

#: Nodes that are broadcast, at most.
NODES = 1_000_000
#: Steps of searches for each edge, after which sources are decided in blocks; and sources of a block.
PATIENCE, SOURCES = 4, 2048


def _trimmed(e: DataFrame) -> tuple[DataFrame, int]:
    """Edges between nodes with a way in and a way out, and their number."""
    n = e.count()
    while n:
        live = small(cut(e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")), NODES)
        kept = cut(e.join(live.toDF("src"), "src", "left_semi").join(live.toDF("dst"), "dst", "left_semi").select("src", "dst"))
        m = kept.count()
        if m == n:
            break
        e, n = kept, m
    return e, n


def _coloured(e: DataFrame) -> DataFrame:
    """id, c: the greatest id that reaches each node of the edges."""
    colours = cut(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")))
    fresh = colours
    while not fresh.isEmpty():
        sent = e.join(fresh.toDF("src", "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("sent"))
        met = cut(colours.join(sent, "id", "left").select("id", F.greatest("c", F.coalesce("sent", "c")).alias("c"), (F.col("sent") > F.col("c")).alias("new")))
        colours, fresh = met.select("id", "c"), met.where("new").select("id", "c")
    return colours


def strong_components(edges: DataFrame) -> DataFrame:
    """id, scc: nodes in strongly connected components of two or more, by a node of the component; all others are alone and not listed."""
    return _components(cut(edges.select("src", "dst")))


def _components(edges: DataFrame) -> DataFrame:
    """``strong_components`` of a table that is read several times; repeated edges go once most edges are trimmed."""
    rest, first, found = edges.where("src <> dst").select("src", "dst"), True, None
    while True:
        rest, n = _trimmed(rest)
        if not n:
            break
        if first:
            rest, first = cut(rest.distinct()), False
        colours = _coloured(rest)
        inside = rest.join(colours.toDF("src", "c"), "src").join(colours.toDF("dst", "d"), "dst").where("c = d").select("src", "dst", "c")
        inside = cut(inside)
        reached = cut(colours.where("id = c"))
        fresh = reached
        while not fresh.isEmpty():
            back = inside.join(fresh.toDF("dst", "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            fresh = cut(back.join(reached, ["id", "c"], "left_anti"))
            reached = cut(reached.unionByName(fresh))
        found = reached if found is None else found.unionByName(reached)
        done = reached.select("id")
        rest = cut(inside.join(done.toDF("src"), "src", "left_anti").join(done.toDF("dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.sparkSession.createDataFrame([], f"id {edges.schema['src'].dataType.simpleString()}, scc {edges.schema['src'].dataType.simpleString()}")
    sizes = found.groupBy(F.col("c").alias("scc")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.select("id", F.col("c").alias("scc")).join(sizes.select("scc"), "scc", "left_semi").select("id", "scc")


class TopologicalOrder:
    """Places of nodes so that every accepted edge goes up; an edge that goes up already costs nothing, another one only a search between its ends' places."""

    def __init__(self):
        self.place: dict = {}
        self.out: dict = {}
        self.into: dict = {}
        self.cyclic = False
        self.edges = self.steps = 0

    def _at(self, n) -> int:
        return self.place.setdefault(n, len(self.place))

    def _between(self, starts: list, ways: dict, low: int, high: int) -> list:
        seen, stack, place = set(starts), list(starts), self.place
        while stack:
            found = ways.get(stack.pop(), ())
            self.steps += len(found)
            for m in found:
                if m not in seen and low <= place[m] <= high:
                    seen.add(m)
                    stack.append(m)
        return sorted(seen, key=place.__getitem__)

    def closes(self, s, d) -> bool:
        """Whether s -> d would close a cycle; if not, places are moved so that it goes up."""
        low, high = self._at(d), self._at(s)
        if s == d:
            return True
        if self.cyclic:  # accepted before that closed cycles themselves: no order to rely on
            return s in self._between([d], self.out, 0, len(self.place))
        if high < low:
            return False
        after = self._between([d], self.out, low, high)
        if after[-1] == s:
            return True
        before = self._between([s], self.into, low, high)
        moved = [*before, *after]
        for n, place in zip(moved, sorted(self.place[n] for n in moved), strict=True):
            self.place[n] = place
        return False

    def closing(self, s, run: list) -> set:
        """Those of ``run`` to which an edge from ``s`` would close a cycle; places are moved so that the other edges go up.

        What an edge from s adds lies behind s, so it changes nothing for the next edge from s: one search answers for all of them.
        """
        if self.cyclic:
            return {d for d in run if self.closes(s, d)}
        high = self._at(s)
        down = [d for d in dict.fromkeys(run) if self._at(d) <= high]
        if not down:
            return set()
        low = min(self.place[d] for d in down)
        before = self._between([s], self.into, low, high)
        met = set(before)
        bad = {d for d in down if d in met}
        if len(bad) < len(down):
            moved = [*before, *self._between([d for d in down if d not in bad], self.out, low, high)]
            for n, place in zip(moved, sorted(self.place[n] for n in moved), strict=True):
                self.place[n] = place
        return bad

    def add(self, s, d) -> None:
        self._at(s), self._at(d)
        self.out.setdefault(s, []).append(d)
        self.into.setdefault(d, []).append(s)
        self.edges += 1

    def accept(self, runs: list[tuple]) -> list[bool]:
        """For each edge of ``runs`` (source, its ends) whether it is accepted, in order."""
        keep, k = [], 0
        while k < len(runs) and (self.cyclic or self.steps <= PATIENCE * (self.edges + SOURCES)):
            s, ends = runs[k]
            bad = self.closing(s, ends)
            keep += [d not in bad for d in ends]
            for d in ends:
                if d not in bad:
                    self.add(s, d)
            k += 1
        for at in range(k, len(runs), SOURCES):
            keep += self._block(runs[at : at + SOURCES])
        return keep

    def _block(self, runs: list[tuple]) -> list[bool]:
        """``accept`` without searches, over edges without cycles; places are not kept up.

        A path back to a source goes through the edges of before to a source of the block, from there by an accepted edge on, and so forth. So it is enough to know the
        sources of the block that each end reaches by the edges of before (``met``), and those that reach a source by now (``above``, a row of bits each).
        """
        number: dict = {}
        for s, _ in runs:
            number.setdefault(s, len(number))
        met: dict = {}
        for s, ends in runs:
            self._reached([s, *ends], number, met)
        size = 8 * -(-len(number) // 64)
        reached = np.stack([np.frombuffer(met[s].to_bytes(size, "little"), np.uint8) for s in number])
        above = np.packbits(np.unpackbits(reached, axis=1, bitorder="little")[:, : len(number)].T, axis=1, bitorder="little")
        above = np.ascontiguousarray(np.pad(above, ((0, 0), (0, size - above.shape[1])))).view(np.uint64)
        keep = []
        for s, ends in runs:
            own, beyond = above[number[s]], 0
            here = int.from_bytes(own.tobytes(), "little")
            for d in ends:
                keep.append(not met[d] & here)
                if keep[-1]:
                    beyond |= met[d]
                    self.out.setdefault(s, []).append(d)
            if beyond:
                above[(above & np.frombuffer(beyond.to_bytes(size, "little"), np.uint64)).any(axis=1)] |= own
        return keep

    def _reached(self, starts: list, number: dict, met: dict) -> None:
        """Put into ``met`` for all that is reached from the starts the numbered nodes that it reaches, itself included, as bits."""
        stack, out = list(starts), self.out
        while stack:
            n = stack[-1]
            if n in met:
                stack.pop()
                continue
            ways = out.get(n, ())
            further = [m for m in ways if m not in met]
            if further:
                stack += further
                continue
            bits = 1 << number[n] if n in number else 0
            for m in ways:
                bits |= met[m]
            met[n] = bits
            stack.pop()

    def seeded(self, edges: Iterable[tuple]) -> TopologicalOrder:
        """With edges that stand whatever they close."""
        for s, d in edges:
            if s != d:
                self.cyclic = self.closes(s, d) or self.cyclic
                self.add(s, d)
        return self


def accept_acyclic(edges: DataFrame, order: list, seed: DataFrame | None = None) -> DataFrame:
    """Edges in order, each accepted unless it closes a cycle over the accepted ones and those of ``seed`` (src, dst).

    Columns in: src, dst and those ordered by (an order without ties, else any of them may come first); out: the same with accepted boolean. A loop is never
    accepted. The rule is sequential inside a strongly connected component of all edges, which is one group there; no other edge is grouped.
    """
    edges = cut(edges)
    scc = small(cut(_components(edges if seed is None else cut(edges.select("src", "dst").union(seed.select("src", "dst"))))), NODES)
    ends = lambda df: df.join(scc.toDF("src", "_s"), "src", "left").join(scc.toDF("dst", "_d"), "dst", "left")
    names = edges.columns
    placed = ends(edges)
    within = F.coalesce(F.col("_s") == F.col("_d"), F.lit(False))
    loose = placed.where(~within).select(*names, (F.col("src") != F.col("dst")).alias("accepted"))
    if scc.isEmpty():
        return loose
    rows = placed.where(within).withColumn("_order", F.row_number().over(Window.partitionBy("_s").orderBy(*order))).drop("_d")
    if seed is not None:
        old = ends(seed.select("src", "dst")).where(within).select("src", "dst", "_s", F.lit(0).alias("_order"))
        rows = rows.unionByName(old, allowMissingColumns=True)

    def accept(group: pa.Table) -> pa.Table:
        group = group.sort_by("_order")
        known = pc.unique(pa.chunked_array(group["src"].chunks + group["dst"].chunks))
        src, dst = (pc.index_in(group[c], known).to_pylist() for c in ("src", "dst"))
        old = pc.sum(pc.equal(group["_order"], 0)).as_py() or 0
        at = TopologicalOrder().seeded(zip(src[:old], dst[:old], strict=True))
        runs = [(s, [d for _, d in run]) for s, run in groupby(zip(src[old:], dst[old:], strict=True), key=itemgetter(0))]
        return group.slice(old).select(names).append_column("accepted", pa.array(at.accept(runs), pa.bool_()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema.fields)
    return loose.unionByName(rows.groupBy("_s").applyInArrow(accept, f"{fields}, accepted boolean"))


def prerequisite_chains(edges: DataFrame, depth: int, start: DataFrame | None = None) -> DataFrame:
    """path (array of ids), length (its edges), closes: all paths of up to ``depth`` edges, from ``start`` (src) only if given.

    A path that comes back to one of its nodes ends there and is reported with ``closes``; it is not followed. Repeated edges count once. Rows are as
    many as there are paths, so the depth bounds them.
    """
    e = cut(edges.select("src", "dst").distinct())
    level = (e if start is None else e.join(start.select("src").distinct(), "src", "left_semi")).select(F.array("src", "dst").alias("path"), (F.col("src") == F.col("dst")).alias("closes"), F.col("dst").alias("src"))
    out = [level]
    for _ in range(1, depth):
        step = level.where(~F.col("closes")).join(e, "src")
        level = step.select(F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("closes"), F.col("dst").alias("src"))
        out.append(level)
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows.select("path", (F.size("path") - 1).alias("length"), "closes")


def chain_lengths(edges: DataFrame) -> DataFrame:
    """id, length: edges of the longest chain that ends in each node; null for nodes in cycles and behind them.

    Nodes without a way in are taken off level by level, so there are as many rounds as the longest chain is long. Repeated edges count once.
    """
    e = cut(edges.select("src", "dst").distinct())
    nodes = cut(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    left, done, level = nodes, [], 0
    while True:
        peeled = cut(left.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        if peeled.isEmpty():
            break
        done.append(peeled.withColumn("length", F.lit(level)))
        left = cut(left.join(peeled, "id", "left_anti"))
        e = cut(e.join(peeled.toDF("src"), "src", "left_anti"))
        level += 1
    rows = left.withColumn("length", F.lit(None).cast("int"))
    for x in done:
        rows = rows.unionByName(x)
    return rows


def chain_summary(lengths: DataFrame) -> DataFrame:
    """nodes, chained, longest, mean_length, cyclic of ``chain_lengths``."""
    return lengths.agg(
        F.count(F.lit(1)).alias("nodes"), F.sum((F.col("length") > 0).cast("long")).alias("chained"), F.max("length").alias("longest"), F.avg("length").alias("mean_length"),
        F.sum(F.col("length").isNull().cast("long")).alias("cyclic"),
    )

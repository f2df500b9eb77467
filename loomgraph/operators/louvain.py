"""Communities by local moving and coarsening (G13), in rounds of moves that do not get in each other's way.

In a round a community is a source if the best move that it takes part in leads out of it, and a target if it leads in (best by gain, then node, then target). Nodes of
sources may move to their best target; of the moves into one target, and out of one source, each is charged with the degrees of those before it, which is the most
they can take from it. Those that still gain are made together: the best of all is among them, and the modularity grows by their sum at least. A level ends
when no node has any move that gains; its communities are the nodes of the next one. Gains are whole numbers, so the result hangs on the graph alone.

Rounds are many and most of them move little, so nodes stay where they are, dealt to tasks by their number, with the communities of their neighbours and the degrees of these; a
round is one job, and its shuffles carry moves and what has changed, not the graph. With many moves, what belongs to a community is decided in the task of the node that it is named
after (five shuffles); at most ``FEW`` moves are sent to all tasks, which decide alike (one shuffle).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .metrics import modularity, simple_edges
from .tables import cut, shared_dir

#: Rows of the graph in a task: at least, while there are fewer tasks than cores, and at most.
LEAST_ROWS, MOST_ROWS = 10_000, 4_000_000
#: Moves that gain, at most, for a round in which each task is sent all of them.
FEW = 100_000
#: Rounds from one checkpoint to the next.
KEPT = 10


def _kind(m2: int) -> type:
    """Of gains, which are up to 2 m2^2: machine integers, or Python's where they do not fit."""
    return np.int64 if m2 < 2**31 else object


def _rows(**columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), [(n, c.dtype) for n, c in columns.items()])
    for n, c in columns.items():
        out[n] = c
    return out


def _ordered(*keys: np.ndarray) -> np.ndarray:
    """Places in the order of the keys, the first one strongest."""
    at = np.arange(len(keys[0]))
    for key in reversed(keys):
        at = at[np.argsort(key[at], kind="stable")]
    return at


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Places where a group of equal neighbours begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _found(sorted_names: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``names`` that are among the sorted ones, and where there."""
    if not len(sorted_names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
    hit = np.flatnonzero(sorted_names[at] == names)
    return hit, at[hit]


def _dealt(rows: np.ndarray, by: str, tasks: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows for each task, by a number in them."""
    task = rows[by] % tasks
    at = np.argsort(task, kind="stable")
    ends = np.searchsorted(task[at], np.arange(tasks + 1))
    for t in range(tasks):
        if ends[t] < ends[t + 1]:
            yield t, rows[at[ends[t] : ends[t + 1]]]


@dataclass(frozen=True)
class Part:
    """Nodes x of a task with degree k and community c, the degrees of which are t; neighbours y of the node at ``row`` with weight w, their community and its degrees; the moves that gain."""

    m2: int
    task: int
    x: np.ndarray
    k: np.ndarray
    c: np.ndarray
    t: np.ndarray
    row: np.ndarray
    y: np.ndarray
    w: np.ndarray
    cy: np.ndarray
    ty: np.ndarray
    moves: np.ndarray | None = None

    @classmethod
    def of(cls, m2: int, task: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, ky: np.ndarray) -> Part:
        """All nodes alone. A loop counts in the degree, and is no neighbour."""
        names, row = np.unique(x, return_inverse=True)
        k = np.zeros(len(names), np.int64)
        np.add.at(k, row, w)
        fine = x != y
        return cls(m2, task, names, k, names, k, row[fine], y[fine], w[fine], y[fine], ky[fine]).searched()

    def searched(self) -> Part:
        """With ``moves``: for each node and community of a neighbour what moving there gains, if it does: 2 m^2 times the growth of the modularity."""
        at = np.lexsort((self.cy, self.row))
        first = _starts(self.row[at], self.cy[at])
        w = np.add.reduceat(self.w[at], first) if len(first) else self.w[:0]
        at = at[first]
        row, c, t = self.row[at], self.cy[at], self.ty[at]
        own = c == self.c[row]
        w_own = np.zeros(len(self.x), np.int64)
        w_own[row[own]] = w[own]
        row, c, t, w = row[~own], c[~own], t[~own], w[~own]
        k, kind = self.k[row], _kind(self.m2)
        gain = (w - w_own[row]).astype(kind) * self.m2 - k.astype(kind) * (t - self.t[row] + k)
        rows = _rows(x=self.x[row], k=k, own=self.c[row], c=c, gain=gain, t=t)
        return replace(self, moves=rows[gain > 0])

    def after(self, m: np.ndarray, changes: np.ndarray) -> Part:
        """After moves (x, in order, c and its degrees before, t) and changes of the degrees of communities (name, in order, change); with the moves of the next round."""
        new = []
        for who, c, t in ((self.x, self.c.copy(), self.t.copy()), (self.y, self.cy.copy(), self.ty.copy())):
            here, there = _found(m["x"], who)
            c[here], t[here] = m["c"][there], m["t"][there]
            here, there = _found(changes["name"], c)
            t[here] += changes["change"][there]
            new += [c, t]
        return replace(self, **dict(zip(("c", "t", "cy", "ty"), new, strict=True))).searched()


def _sides(m: np.ndarray, task: int = 0) -> np.ndarray:
    """Each move twice: by the name of the community that it leads out of, and of the one it leads into."""
    return np.concatenate([_rows(name=m[s], **{n: m[n] for n in m.dtype.names}, out=np.full(len(m), s == "own"), task=np.full(len(m), task)) for s in ("own", "c")])


def _best(sides: np.ndarray) -> np.ndarray:
    """The best move of each name, by name."""
    sides = sides[_ordered(sides["name"], -sides["gain"], sides["x"], sides["c"])]
    return sides[_starts(sides["name"])]


def _suited(m: np.ndarray, roles: np.ndarray) -> np.ndarray:
    """The best move of each node from a source to a target; roles: name (in order), out."""
    source = lambda name: roles["out"][np.searchsorted(roles["name"], name)]
    m = m[source(m["own"]) & ~source(m["c"])]
    m = m[_ordered(m["x"], -m["gain"], m["c"])]
    return m[_starts(m["x"])]


def _charged(sides: np.ndarray) -> np.ndarray:
    """With the degrees of the moves of a name before each in place of the name."""
    sides = sides[_ordered(sides["name"], -sides["gain"], sides["x"])]
    before, first = np.cumsum(sides["k"]) - sides["k"], _starts(sides["name"])
    sides["name"] = before - np.repeat(before[first], np.diff(first, append=len(sides)))
    sides.dtype.names = ("before", *sides.dtype.names[1:])
    return sides


def _accepted(charged: np.ndarray) -> np.ndarray:
    """Moves that gain whatever those before them do."""
    charged = charged[np.argsort(charged["x"], kind="stable")]
    m, before = charged[::2], charged["before"][::2] + charged["before"][1::2]
    return m[m["gain"] > m["k"].astype(m["gain"].dtype) * before]


def _changes(m: np.ndarray) -> np.ndarray:
    """name, change: by how much the moves change the degrees of communities."""
    return _summed(np.concatenate([m["own"], m["c"]]), np.concatenate([-m["k"], m["k"]]))


def _summed(names: np.ndarray, change: np.ndarray) -> np.ndarray:
    names, at = np.unique(names, return_inverse=True)
    out = np.zeros(len(names), np.int64)
    np.add.at(out, at, change)
    return _rows(name=names, change=out)


# The steps of a round with many moves: (part of the task, mail) -> (task, mail). What needs a community goes to the task of its name.


def _ask(part: Part, mail: list, tasks: int) -> Iterator:
    """The best move out of or into each community here."""
    if part is not None and len(part.moves):
        yield from _dealt(_best(_sides(part.moves, part.task)), "name", tasks)


def _answer(part: None, mail: list, tasks: int) -> Iterator:
    """Back to those who asked: is the community a source?"""
    if mail:
        rows = np.concatenate(mail)
        best = _best(rows)
        rows["out"] = best["out"][np.searchsorted(best["name"], rows["name"])]
        yield from _dealt(_rows(**{n: rows[n] for n in ("name", "out", "task")}), "task", tasks)


def _propose(part: Part, mail: list, tasks: int) -> Iterator:
    """The moves that suit, to the tasks of both communities."""
    if mail:
        roles = np.concatenate(mail)
        yield from _dealt(_sides(_suited(part.moves, roles[np.argsort(roles["name"])])), "name", tasks)


def _charge(part: None, mail: list, tasks: int) -> Iterator:
    """Back to the node."""
    if mail:
        yield from _dealt(_charged(np.concatenate(mail)), "x", tasks)


def _make(part: Part, mail: list, tasks: int) -> Iterator:
    """Moves made to the tasks of the node and its neighbours; changes of communities to all."""
    m = _accepted(np.concatenate(mail)) if mail else ()
    if len(m):
        of = np.full(len(part.x), -1)
        of[np.searchsorted(part.x, m["x"])] = np.arange(len(m))
        ends = np.flatnonzero(of[part.row] >= 0)
        meets = np.zeros((tasks, len(m)), bool)
        meets[part.task] = True
        meets[part.y[ends] % tasks, of[part.row[ends]]] = True
        places, changes = _rows(x=m["x"], c=m["c"], t=m["t"]), _changes(m)
        for t in range(tasks):
            yield t, (places[meets[t]], changes)


def _take(part: Part, mail: list, tasks: int) -> Iterator:
    """The nodes after the round."""
    if part is not None:
        if mail:
            m, changes = (np.concatenate(rows) for rows in zip(*mail, strict=True))
            part = part.after(m[np.argsort(m["x"])], _summed(changes["name"], changes["change"]))
        yield part.task, part


# The steps of a round with few moves: all tasks see all of them.


def _tell(part: Part, mail: list, tasks: int) -> Iterator:
    if part is not None and len(part.moves):
        yield from ((t, part.moves) for t in range(tasks))


def _take_all(part: Part, mail: list, tasks: int) -> Iterator:
    if part is not None:
        m = np.concatenate(mail)
        m = _accepted(_charged(_sides(_suited(m, _best(_sides(m))))))
        yield part.task, part.after(m, _changes(m))


def _settled(adjacent: DataFrame, m2: int) -> DataFrame | None:
    """x, c after the rounds of a level; None if no move gains. adjacent: x, y, w, both ways; a loop counts its weight twice."""
    context, n = adjacent.sparkSession.sparkContext, adjacent.count()
    tasks = max(1, min(context.defaultParallelism, n // LEAST_ROWS), n // MOST_ROWS)
    degrees = adjacent.groupBy(F.col("x").alias("y")).agg(F.sum("w").alias("k"))
    rows = adjacent.join(degrees, "y").select(F.pmod("x", F.lit(tasks)).cast("int").alias("task"), "x", "y", "w", "k")

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield pa.RecordBatch.from_arrays([whole["task"].chunk(0)[:1], *[pa.array([whole[c].to_numpy().tobytes()], pa.binary()) for c in ("x", "y", "w", "k")]], ["task", "x", "y", "w", "k"])

    def start(row) -> tuple[int, Part]:
        return row.task, Part.of(m2, row.task, *[np.frombuffer(v, np.int64) for v in (row.x, row.y, row.w, row.k)])

    def step(f: Callable) -> Callable:
        def run(pairs: Iterable[tuple]) -> Iterator:
            part, mail = None, []
            for _, v in pairs:
                if isinstance(v, Part):
                    part = v
                else:
                    mail.append(v)
            yield from f(part, mail, tasks)

        return run

    def sent(rdd: RDD, f: Callable) -> RDD:
        return rdd.mapPartitions(step(f)).partitionBy(tasks, int)

    def left(state: RDD) -> int:
        return state.map(lambda v: len(v[1].moves)).sum()

    shared_dir(adjacent.sparkSession)  # for checkpoints
    parts = rows.repartitionById(tasks, "task").mapInArrow(packed, "task int, x binary, y binary, w binary, k binary").rdd
    state = parts.map(start).partitionBy(tasks, int).persist(StorageLevel.MEMORY_AND_DISK)
    rounds, moves = 0, left(state)
    while moves:
        rounds += 1
        if moves <= FEW:
            mail, take = sent(state, _tell), _take_all
        else:
            roles = sent(sent(state, _ask), _answer)
            charges = sent(sent(state.union(roles), _propose), _charge)
            mail, take = sent(state.union(charges), _make), _take
        old, state = state, state.union(mail).mapPartitions(step(take), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        if rounds % KEPT == 0:
            state.checkpoint()
        moves = left(state)
        old.unpersist()
    places = state.flatMap(lambda v: zip(v[1].x.tolist(), v[1].c.tolist(), strict=True))
    out = cut(adjacent.sparkSession.createDataFrame(places, "x bigint, c bigint", verifySchema=False)) if rounds else None
    state.unpersist()
    return out


def _numbered(ids: DataFrame) -> DataFrame:
    """id, x: the place of each in their order."""
    rows = ids.orderBy("id").rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
    return cut(ids.sparkSession.createDataFrame(rows, StructType([ids.schema["id"], StructField("x", LongType())]), verifySchema=False))


def louvain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, part (least id of the community) over the simple undirected edges; a node without edges is alone."""
    e = cut(simple_edges(edges))
    ids = _numbered(cut(nodes.select("id").union(e.select("a")).union(e.select("b")).where("id is not null").distinct()))
    labels = cut(nodes.select("id").join(ids, "id").select("id", F.col("x").alias("part")))
    adjacent = cut(e.union(e.select("b", "a")).join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select("x", "y", F.lit(1).cast("bigint").alias("w")))
    m2 = adjacent.count()
    while m2 and (to := _settled(adjacent, m2)) is not None:
        labels = cut(labels.join(to.toDF("part", "to"), "part", "left").select("id", F.coalesce("to", "part").alias("part")))
        ends = adjacent.join(to.toDF("x", "cx"), "x").join(to.toDF("y", "cy"), "y")
        adjacent = cut(ends.groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("w").alias("w")))
    least = labels.groupBy("part").agg(F.min("id").alias("least"))
    return labels.join(least, "part").select("id", F.col("least").alias("part"))


def louvain_modularity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """q and number of the communities."""
    parts = cut(louvain(nodes, edges))
    return modularity(edges, parts).join(F.broadcast(parts.agg(F.countDistinct("part").alias("communities"))))

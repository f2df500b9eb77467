"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are turned into integers, floor(256 * x), so scores are exact and ties are real.
Blocks of data rows and blocks of queries are each indexed by a cover tree: a node covers
its points within a radius, its children are centres more than half that radius apart.
A pair of a query node and a data node is pruned if no pair of their points can
reach the worst k-th score among the node's queries:

    <q, r> <= <cq, cr> + Rq |cr| + Rr |cq| + Rq Rr

Pairs whose bound only equals that score are still opened, so ties go to the smaller vec_id.

Pairs of leaves that stay are compared as blocks; nothing else is. Where vectors are nearly orthogonal to each other (no cluster, bounds far
above the scores) little can be pruned, and the work is that of all leaf pairs.

Queries are taken in blocks of about ``QUERY_BLOCK`` from a written table: the driver holds one block at a time, whatever their number. Each task indexes its
rows, across Arrow batches, in trees of ``DATA_BLOCK`` rows and returns at most k rows for each query; a window over (query) with the group limit
pushed down picks the k of all tasks. With more than one block of queries the trees are built once and written, a row for each; every block reads them, and leaves out
a tree whose root can't reach the worst of its scores.

Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with
null vec_id; vectors are compared with those of their own length. Rows that share a vec_id with a
query count as its own and are no candidates; as queries they count once (the least vector). Repeated other
rows are candidates each. Scores beyond the range of a long are held at its ends. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DATA_BLOCK, QUERY_BLOCK, LEAF = 4096, 2048, 32
#: Centres that are tried at once when a node is split; rows or nodes of data that are scored at once.
_CENTRES, _SCORED = 64, 512


class Node:
    __slots__ = ("_family", "centre", "children", "norm", "points", "radius", "worst")

    def __init__(self, x: np.ndarray, points: np.ndarray, centre: int, radius: float):
        self.points, self.centre, self.radius = points, x[centre], radius
        self.norm = float(np.sqrt(x[centre] @ x[centre]))
        self.children: list[Node] = []
        self.worst = -np.inf
        self._family = None

    def __getstate__(self):
        return self.points, self.centre, self.radius, self.norm, self.children

    def __setstate__(self, state):
        self.points, self.centre, self.radius, self.norm, self.children = state
        self.worst, self._family = -np.inf, None

    def family(self) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The children, or the node itself as a leaf; their centres, radii and norms, and whether they are leaves."""
        if self._family is None:
            own = self.children or [self]
            self._family = own, np.stack([c.centre for c in own]), np.array([c.radius for c in own]), np.array([c.norm for c in own]), np.array([not c.children for c in own])
        return self._family


def cover_tree(x: np.ndarray) -> Node:
    """Cover tree of the rows of ``x``; leaves hold up to ``LEAF`` points or one place."""
    squares = np.einsum("ij,ij->i", x, x)

    def distances(centres: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares[centres][:, None] + squares[points][None] - 2 * (x[centres] @ x[points].T), 0))

    def build(centre: int, points: np.ndarray, from_centre: np.ndarray) -> Node:
        node = Node(x, points, centre, float(from_centre.max()))
        if len(points) <= LEAF or node.radius == 0:
            return node
        cover = node.radius / 2
        inside = (from_centre <= cover) | (points == centre)
        node.children.append(build(centre, points[inside], from_centre[inside]))
        rest = points[~inside]
        while len(rest):
            near = distances(rest[:_CENTRES], rest)
            chosen: list[int] = []
            for c in range(len(near)):  # centres are more than the cover apart
                if (near[chosen, c] > cover).all():
                    chosen.append(c)
            within = near[chosen] <= cover
            within[np.arange(len(chosen)), chosen] = True
            first = np.where(within.any(axis=0), within.argmax(axis=0), -1)
            for j, c in enumerate(chosen):
                node.children.append(build(int(rest[c]), rest[first == j], near[c, first == j]))
            rest = rest[first < 0]
        return node

    everything = np.arange(len(x))
    return build(0, everything, distances(everything[:1], everything)[0])


class Search:
    """k best candidates of each query over any number of data blocks."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.tree = cover_tree(x)
        self.scores = np.full((len(x), k), -np.inf)
        self.found = np.full((len(x), k), np.iinfo(np.int64).max)
        self.limit = float(np.abs(x).max(initial=0))
        self.compared = 0  # pairs of points

    def add(self, ids: np.ndarray, y: np.ndarray, tree: Node | None = None) -> None:
        # products and their sums are exact below 2^53
        self.exact = self.limit * float(np.abs(y).max(initial=0)) * y.shape[1] < 2**53
        q, r = self.tree, tree or cover_tree(y)
        top = float(q.centre @ r.centre) + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius
        if top + abs(top) * 1e-9 + 1 >= q.worst:
            self._open(q, r, ids, y)

    def _open(self, q: Node, r: Node, ids: np.ndarray, y: np.ndarray) -> None:
        """Look at all pairs of children that can still matter: pairs of leaves together, then the others, most promising first."""
        (qs, qc, qr, qn, ql), (rs, rc, rr, rn, rl) = q.family(), r.family()
        for at in range(0, len(rs), _SCORED):
            part = slice(at, at + _SCORED)
            top = qc @ rc[part].T + qr[:, None] * rn[None, part] + qn[:, None] * rr[None, part] + qr[:, None] * rr[None, part]
            top += np.abs(top) * 1e-9 + 1  # above any rounding
            go = top >= np.array([c.worst for c in qs])[:, None]
            leaves = go & ql[:, None] & rl[None, part]
            if leaves.any():
                own = [qs[i] for i in np.flatnonzero(leaves.any(axis=1)).tolist()]
                points = np.concatenate([rs[at + j].points for j in np.flatnonzero(leaves.any(axis=0)).tolist()])
                self._compare(np.concatenate([c.points for c in own]), points, ids, y)
                for c in own:
                    c.worst = float(min(self.scores[c.points, -1]))
            go &= ~(ql[:, None] & rl[None, part])
            for i, j in sorted(np.argwhere(go).tolist(), key=lambda ij: -top[ij[0], ij[1]]):
                if top[i, j] >= qs[i].worst:
                    self._open(qs[i], rs[at + j], ids, y)
        q.worst = min(c.worst for c in qs)

    def _compare(self, mine: np.ndarray, theirs: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        self.compared += len(mine) * len(theirs)
        for at in range(0, len(theirs), _SCORED):
            self._score(mine, theirs[at : at + _SCORED], ids, y)

    def _score(self, mine: np.ndarray, theirs: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        if self.exact:
            s = self.x[mine] @ y[theirs].T
        else:
            big = [[int(v) for v in row] for row in y[theirs]]
            s = np.array([[sum(int(a) * b for a, b in zip(row, other, strict=True)) for other in big] for row in self.x[mine]], object)
            s = np.clip(s, -(2**63), 2**63 - 1)
        own = self.ids[mine][:, None] == ids[theirs][None]
        s = np.where(own, -np.inf, s)
        last, last_id = self.scores[mine, -1], self.found[mine, -1]
        better = (s > last[:, None]) | ((s == last[:, None]) & (ids[theirs][None] < last_id[:, None]))
        for i in np.flatnonzero((better & ~own).any(axis=1)).tolist():
            p = mine[i]
            use = better[i] & ~own[i]
            if self.exact and use.sum() > 4 * self.k:  # more than can stay: only those up to the k-th score
                use &= s[i] >= np.partition(s[i][use], -self.k)[-self.k]
            score = np.concatenate([self.scores[p], s[i][use].astype(float)]) if self.exact else [*self.scores[p], *s[i][use]]
            found = np.concatenate([self.found[p], ids[theirs][use]])
            if self.exact:
                order = np.lexsort((found, -score))[: self.k]
                self.scores[p], self.found[p] = score[order], found[order]
            else:
                if self.scores.dtype != object:
                    self.scores = np.array([[v if v == -np.inf else int(v) for v in row] for row in self.scores], object)
                order = sorted(range(len(score)), key=lambda j: (-score[j], found[j]))[: self.k]
                self.scores[p], self.found[p] = [score[j] for j in order], found[order]


def integers(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id and v, the finite vectors as array<double> of floor(256 * x)."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, _floor)
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _floor(e):
    d = e.cast("double") * 256
    # floor() gives a long; beyond its range a double has no fraction anyway
    return F.when(F.abs(d) < 2.0**53, F.floor(d).cast("double")).otherwise(d)


def _blocks(batches):
    """(dimension, ids, vectors) of DATA_BLOCK rows of one length, gathered over batches; less at the end."""
    waiting: dict[int, list] = {}
    for batch in batches:
        lens = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for d in np.unique(lens).tolist():
            rows = batch.filter(pa.array(lens == d))
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            x = pc.list_flatten(rows.column(1)).to_numpy(zero_copy_only=False).reshape(-1, d)
            held = waiting.pop(d, None)
            if held:
                ids, x = np.concatenate([held[0], ids]), np.concatenate([held[1], x])
            whole = len(ids) // DATA_BLOCK * DATA_BLOCK
            for at in range(0, whole, DATA_BLOCK):
                yield d, ids[at : at + DATA_BLOCK], x[at : at + DATA_BLOCK]
            if whole < len(ids):
                waiting[d] = [ids[whole:], x[whole:]]
    for d, (ids, x) in waiting.items():
        yield d, ids, x


def _planted(batches):
    """(dimension, tree) of blocks of rows: ids, vectors and their cover tree, pickled."""
    for d, ids, x in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([pickle.dumps((ids, x, cover_tree(x)), pickle.HIGHEST_PROTOCOL)], pa.binary())], ["d", "tree"])


def _held(batches):
    """What ``_planted`` wrote."""
    for batch in batches:
        for d, tree in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield d, *pickle.loads(tree.as_py())


def _searcher(shared, k, blocks=_blocks):
    def run(batches):
        searches = {}
        for d, rows in shared.value.items():
            searches[d] = Search(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), k)
        for d, *block in blocks(batches):
            if d in searches:
                searches[d].add(*block)
        for s in searches.values():
            some = s.found != np.iinfo(np.int64).max
            if some.any():
                score = [int(v) for v in s.scores[some]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.ids, k)[some.ravel()]), pa.array(s.found[some]), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def top_k(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of (vec_id, v) frames made by ``integers``."""
    context = data.sparkSession.sparkContext
    queries = cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    rows, read = (data.select("vec_id", "v"), _blocks) if blocks == 1 else (cut(data.select("vec_id", "v").mapInArrow(_planted, "d bigint, tree binary"), "trees"), _held)
    passes = []
    for b in range(blocks):
        block: dict[int, list] = {}
        for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect():
            block.setdefault(len(r.v), []).append((r.vec_id, r.v))
        shared = context.broadcast(block)
        found = _best(rows.mapInArrow(_searcher(shared, k, read), "query_id bigint, vec_id bigint, score bigint"), k)
        if blocks > 1:
            found = cut(found, "found")
            shared.destroy()
        passes.append(found)
    return functools.reduce(DataFrame.union, passes)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

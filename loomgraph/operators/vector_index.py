"""Exact vector index: a persisted partition of unit vectors around pivots, searched with triangle bounds.

Rows are dealt to the nearest of at most ``PIVOTS`` pivots (rows picked by a hash of their id: they decide what is pruned, never what is
found) and, ordered by their angle to it, into blocks of about ``BLOCK`` rows. So a block knows its pivot and the least and the greatest angle to it;
no row of it can be nearer to a query than the angle between query and pivot, less the greatest (or the least less it) allows.

A search visits pairs of blocks that the bound can't exclude, best bounds first: a task holds a group of blocks of queries and reads
blocks of data one by one, each once for the whole group. Groups are few whatever the number of rows (up to ``GROUP_BLOCKS`` blocks of queries in each), so what is
shuffled grows with the data, not with its square. All data stays in executors; the driver sees the pivots and the numbers of blocks. Indexes live under a folder, by model and dimension, in numbered versions; a version counts once its
description is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut

PIVOTS, BLOCK = 1024, 1024
#: Rows of a block, neighbours by angle, that are ruled out together.
CAP = 128
#: Blocks, at most; beyond that they hold more rows. Their bounds (24 bytes each) are broadcast.
MOST_BLOCKS = 1 << 18
#: Groups of blocks of queries that data are sent to, and blocks in a group at most; beyond that there are more groups.
GROUPS, GROUP_BLOCKS = 16, 128
#: Digits of a score, what a bound is raised by for their rounding, and what each entry may put a cosine in single precision off by.
DIGITS, SLACK, SINGLE = 6, 2e-6, 1.2e-7
_BLOCKS = "block bigint, cell int, n int, low double, high double, ids array<string>, groups array<string>, v binary"
_ABOUT = "model string, dimension int, version int, n bigint, cells int, blocks bigint, grouped boolean"


@dataclass(frozen=True)
class VectorIndex:
    """One version of an index; ``pivots`` holds a unit vector in each row."""

    spark: SparkSession
    path: str
    model: str
    dimension: int
    version: int
    n: int
    grouped: bool
    pivots: np.ndarray

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks")

    @property
    def ids(self) -> DataFrame:
        return self.blocks.select(F.explode("ids").alias("id"))


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, path: str) -> list[str]:
    files, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()) if files.exists(at) else []


def _versions(spark: SparkSession, path: str, model: str) -> list[tuple[int, int, bool]]:
    """(dimension, version, complete) of the versions of a model."""
    out = []
    for d in _folders(spark, f"{path}/{model}"):
        for v in _folders(spark, f"{path}/{model}/{d}"):
            files, at = _fs(spark, f"{path}/{model}/{d}/{v}/about/_SUCCESS")
            out.append((int(d.removeprefix("d")), int(v.removeprefix("v")), files.exists(at)))
    return sorted(out)


def drop(spark: SparkSession, path: str, model: str, dimension: int | None = None) -> None:
    """Remove the indexes of a model, or those of one dimension."""
    files, at = _fs(spark, f"{path}/{model}" + ("" if dimension is None else f"/d{dimension}"))
    files.delete(at, True)


def describe(spark: SparkSession, path: str) -> DataFrame:
    """model, dimension, version, n, cells, blocks, grouped of the complete indexes under ``path``."""
    found = [f"{path}/{m}/d{d}/v{v}/about" for m in _folders(spark, path) for d, v, whole in _versions(spark, path, m) if whole]
    return spark.read.schema(_ABOUT).parquet(*found) if found else spark.createDataFrame([], _ABOUT)


def _unit(column: pa.Array, d: int) -> np.ndarray:
    x = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _placed(rows: DataFrame, d: int, shared) -> DataFrame:
    """id, grp, v (bytes of the unit vector) with cell and angle."""

    def run(batches):
        pivots = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _unit(part.column(2), d)
                a = _angles(x, pivots)
                cell = a.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(a[np.arange(len(x)), cell])], ["id", "grp", "v", "cell", "angle"])

    return rows.mapInArrow(run, "id string, grp string, v binary, cell int, angle double")


def _blocked(placed: DataFrame, size: int, parts: int) -> DataFrame:
    """Blocks of rows that are neighbours in (cell, angle)."""

    def run(batches):
        first, k, held = TaskContext.get().partitionId() << 32, 0, []

        def block():
            ids, groups, v, cells, angles = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                ([first + k], [cells[0]], [len(ids)], [angles[0]], [angles[-1]], [list(ids)], [list(groups)], [b"".join(v)]),
                (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary()), strict=True,
            )], ["block", "cell", "n", "low", "high", "ids", "groups", "v"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == size or held[0][3] != row[3]):
                    yield block()
                    held, k = [], k + 1
                held.append(row)
        if held:
            yield block()

    order = ["cell", "angle", "id"]
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _BLOCKS)


def _rows(vectors: DataFrame, group: str | None) -> DataFrame:
    return vectors.select("id", (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"), "v")


def create(vectors: DataFrame, path: str, model: str, group: str | None = None) -> VectorIndex:
    """Build a new version over (id, v array<double>[, group]); an error if the vectors differ in length, and a drop of the model's indexes of another length."""
    spark = vectors.sparkSession
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("d")).first()
    if sizes.least != sizes.d:
        raise ValueError(f"vectors of {model} have {sizes.least} to {sizes.d} entries")
    n, d = sizes.n, sizes.d or 0
    versions = _versions(spark, path, model)
    for other in {dim for dim, _, _ in versions if dim != d}:
        drop(spark, path, model, other)
    version = 1 + max((v for dim, v, _ in versions if dim == d), default=0)
    at = f"{path}/{model}/d{d}/v{version}"
    size = max(BLOCK, -(-n // MOST_BLOCKS))
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, n // size))).select("v").toArrow()["v"].combine_chunks()
    pivots = np.unique(_unit(picked, d), axis=0) if n else np.zeros((0, 0))
    placed = cut(_placed(_rows(vectors, group), d, spark.sparkContext.broadcast(pivots)))
    _blocked(placed, size, max(1, n // (64 * size), min(len(pivots), spark.sparkContext.defaultParallelism))).write.parquet(f"{at}/blocks")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{at}/blocks").count()
    spark.createDataFrame([(pivots.tobytes(),)], "v binary").coalesce(1).write.parquet(f"{at}/pivots")
    spark.createDataFrame([(model, d, version, n, len(pivots), blocks, group is not None)], _ABOUT).coalesce(1).write.parquet(f"{at}/about")
    return VectorIndex(spark, at, model, d, version, n, group is not None, pivots)


def load(spark: SparkSession, path: str, model: str, dimension: int | None = None) -> VectorIndex | None:
    """The latest complete version, or None."""
    whole = [(v, d) for d, v, done in _versions(spark, path, model) if done and dimension in (None, d)]
    if not whole:
        return None
    v, d = max(whole)
    at = f"{path}/{model}/d{d}/v{v}"
    about = spark.read.schema(_ABOUT).parquet(f"{at}/about").first()
    pivots = np.frombuffer(spark.read.schema("v binary").parquet(f"{at}/pivots").first().v).reshape(-1, d) if about.cells else np.zeros((0, 0))
    return VectorIndex(spark, at, model, d, v, about.n, about.grouped, pivots)


def ensure(vectors: DataFrame, path: str, model: str, dimension: int, group: str | None = None) -> VectorIndex:
    """The index of a model, built where there is none of this dimension; one of another dimension is dropped."""
    found = load(vectors.sparkSession, path, model, dimension)
    return found if found is not None and found.grouped >= (group is not None) else create(vectors, path, model, group)


@dataclass
class Block:
    """Rows of a block in a task."""

    ids: np.ndarray
    groups: np.ndarray
    x: np.ndarray
    single: np.ndarray

    @classmethod
    def of(cls, ids: list, groups: list, v: bytes) -> Block:
        x = np.frombuffer(v).reshape(len(ids), -1)
        return cls(np.array(ids, object), np.array(groups, object), x, x.astype(np.float32))

    @cached_property
    def caps(self) -> tuple[np.ndarray, np.ndarray]:
        """A direction for each ``CAP`` rows, and the greatest angle of one of these rows to it."""
        starts = np.arange(0, len(self.x), CAP)
        mean = np.add.reduceat(self.x, starts, axis=0)
        length = np.linalg.norm(mean, axis=1, keepdims=True)
        mean = np.where(length > 1e-9, mean / np.maximum(length, 1e-9), self.x[starts])
        cos = np.einsum("ij,ij->i", self.x, mean[np.arange(len(self.x)) // CAP])
        return mean, np.arccos(np.clip(np.minimum.reduceat(cos, starts), -1, 1))

    def part(self, rows: np.ndarray) -> Block:
        return Block(self.ids[rows], self.groups[rows], self.x[rows], self.single[rows])


def known(groups: np.ndarray) -> np.ndarray:
    return (groups != None) & (groups != "")  # noqa: E711


def scores(q: Block, r: Block, raw: bool, self_in_k: bool, by_group: bool) -> np.ndarray:
    """Rounded scores of all pairs; -inf for pairs that do not count."""
    cos = np.clip(q.x @ r.x.T, -1, 1)
    s = np.round(cos if raw else (1 + cos) / 2, DIGITS)
    if not self_in_k:
        s[q.ids[:, None] == r.ids[None]] = -np.inf
    if by_group:
        s[~((q.groups[:, None] != r.groups[None]) & known(q.groups)[:, None] & known(r.groups)[None])] = -np.inf
    return s


def above(q: Block, r: Block, least: np.ndarray, raw: bool, self_in_k: bool, by_group: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q and r, by q, and their rounded scores: all pairs that count and reach ``least`` of the row of q, and a few that just do not.

    Queries and rows that the angles to the caps of r rule out are not compared. Cosines in single precision rule out most other pairs, by a margin beyond their
    error; what is left is computed as in ``scores``.
    """
    need = (least if raw else 2 * least - 1) - 2 * SLACK
    middle, angle = r.caps
    hope = np.cos(np.maximum(0, _angles(q.x, middle) - angle)) >= need[:, None]
    near, held = np.flatnonzero(hope.any(axis=1)), np.flatnonzero(np.repeat(hope.any(axis=0), CAP)[: len(r.ids)])
    if not len(near):
        return near, near, np.zeros(0)
    if len(near) < len(q.ids) or len(held) < len(r.ids):
        i, j, s = _above(q.part(near), r.part(held), least[near], raw, self_in_k, by_group)
        return near[i], held[j], s
    return _above(q, r, least, raw, self_in_k, by_group)


def _above(q: Block, r: Block, least: np.ndarray, raw: bool, self_in_k: bool, by_group: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bound = ((least if raw else 2 * least - 1) - SLACK - SINGLE * (q.x.shape[1] + 8)).astype(np.float32)
    cos = q.single @ r.single.T
    hit = np.flatnonzero(cos.max(axis=1) >= bound)  # a maximum is cheaper than a comparison with places
    i, j = np.divmod(np.flatnonzero(cos[hit] >= bound[hit, None]), len(r.ids))
    i = hit[i]
    fine = np.ones(len(i), bool) if self_in_k else q.ids[i] != r.ids[j]
    if by_group:
        a, b = q.groups[i], r.groups[j]
        fine &= (a != b) & known(a) & known(b)
    i, j = i[fine], j[fine]
    cos = np.clip(np.einsum("ij,ij->i", q.x[i], r.x[j]), -1, 1)
    return i, j, np.round(cos if raw else (1 + cos) / 2, DIGITS)


#: Pairs of (query, block) whose bounds are computed at once.
_BOUNDS = 1 << 22


def candidate_blocks(queries: DataFrame, index: VectorIndex, floor: Callable[[Block, list | None], np.ndarray], raw: bool) -> DataFrame:
    """q, block, hope: blocks that can hold a row of a score of at least ``floor`` for a query of block q, with the best score they can hold."""
    meta = index.blocks.select("block", "cell", "low", "high").toArrow()  # 24 bytes a block: MOST_BLOCKS, and a part-filled one for each pivot
    context = index.spark.sparkContext
    bounds, pivots = context.broadcast(tuple(meta[c].to_numpy() for c in ("block", "cell", "low", "high"))), context.broadcast(index.pivots)
    if "extra" not in queries.columns:
        queries = queries.withColumn("extra", F.lit(None).cast("string"))

    def run(batches):
        ids, cells, low, high = bounds.value
        for batch in batches:
            for q, own, groups, v, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = Block.of(own, groups, v)
                angles, least = _angles(b.x, pivots.value), floor(b, more)
                step = max(1, _BOUNDS // len(b.ids))
                for at in range(0, len(ids), step):
                    part = slice(at, at + step)
                    a = angles[:, cells[part]]
                    cos = np.cos(np.minimum(np.pi, np.maximum(0, np.maximum(a - high[part], low[part] - a))))
                    hope = cos if raw else (1 + cos) / 2
                    fine = (hope + SLACK >= least[:, None]).any(axis=0)
                    if fine.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(fine.sum(), q)), pa.array(ids[part][fine]), pa.array(hope.max(axis=0)[fine])], ["q", "block", "hope"])

    return queries.select("block", "ids", "groups", "v", "extra").mapInArrow(run, "q bigint, block bigint, hope double")


def dealt(queries: DataFrame, index: VectorIndex, floor, raw: bool, extra: str | None) -> tuple[DataFrame, int]:
    """Blocks of queries and of data by the task (a number) that they meet in, those of queries first, with the queries each is for; and the number of tasks."""
    spark = index.spark
    queries = queries.withColumn("extra", F.col(extra) if extra else F.lit(None).cast("string"))
    numbers = np.sort(queries.select("block").toArrow()["block"].to_numpy())
    groups = max(1, min(len(numbers), max(GROUPS, -(-len(numbers) // GROUP_BLOCKS))))
    firsts = [int(numbers[len(numbers) * g // groups]) for g in range(1, groups)]  # neighbours are in one group: they visit much the same
    group = lambda c: sum(((F.col(c) >= f).cast("int") for f in firsts), F.lit(0))
    # few groups are dealt to several tasks each, by blocks of data
    salts = max(1, min(16, -(-2 * spark.sparkContext.defaultParallelism // groups)))
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    task = lambda c, s: (group(c) * salts + s).cast("int")
    none = F.lit(None).cast(dict(queries.dtypes)["extra"])
    pairs = candidate_blocks(queries, index, floor, raw)
    asked = pairs.groupBy(task("q", salt).alias("task"), "block").agg(F.max("hope").alias("best"), F.collect_list(F.struct("q", "hope")).alias("asked"))
    data = index.blocks.select("block", "ids", "groups", "v").join(asked, "block").select("task", (-F.col("best")).alias("at"), "ids", "groups", "v", none.alias("extra"), "asked")
    salted = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    itself = F.array(F.struct(F.col("block").alias("q"), F.lit(float("inf")).alias("hope")))
    own = salted.select(task("block", F.col("salt")).alias("task"), F.lit(float("-inf")).alias("at"), "ids", "groups", "v", "extra", itself.alias("asked"))
    return own.unionByName(data), groups * salts


def visit(queries: DataFrame, index: VectorIndex, floor, search: Callable, out: str, raw: bool = False, extra: str | None = None, shared: Callable | None = None) -> DataFrame:
    """Rows of ``search``: an object made of (Block, extra) for each block of queries, with ``add(Block)`` and ``rows()``.

    ``queries`` are blocks like those of an index, with an ``extra`` column that goes to ``floor`` and ``search``. With ``shared``, ``search`` gets a third
    argument, made anew for each task.
    """
    rows, tasks = dealt(queries, index, floor, raw, extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states, own = None, {}, ()
        for batch in batches:
            columns = [batch.column(c) for c in range(batch.num_columns)]
            for r in range(batch.num_rows):
                t, at, ids, groups, v, more, asked = (c[r].as_py() for c in columns)
                if t != now:
                    for state in states.values():
                        yield from state.rows()
                    now, states, own = t, {}, (shared(),) if shared else ()
                b = Block.of(ids, groups, v)
                if at == -np.inf:
                    states[asked[0]["q"]] = search(b, more, *own)
                else:
                    for x in asked:
                        states[x["q"]].add(b, x["hope"])
        for state in states.values():
            yield from state.rows()

    return rows.repartitionById(tasks, "task").sortWithinPartitions("task", "at").mapInArrow(run, out)


def blocks_of(queries: DataFrame, index: VectorIndex, group: str | None) -> DataFrame:
    """Blocks of query rows (id, v) that the index does not hold, around its pivots."""
    shared = index.spark.sparkContext.broadcast(index.pivots)
    return cut(_blocked(cut(_placed(_rows(queries, group), index.dimension, shared)), BLOCK, index.spark.sparkContext.defaultParallelism))  # block numbers hold only once written


class Nearest:
    """k best rows of each query of a block; of those that tie at the k-th place the first by id, or all."""

    def __init__(self, q: Block, k: int, raw: bool, self_in_k: bool, by_group: bool, ties: bool):
        self.q, self.k, self.how, self.ties = q, k, (raw, self_in_k, by_group), ties
        self.floor = np.full(len(q.ids), -np.inf)
        if by_group:
            self.floor[~known(q.groups)] = np.inf  # nothing counts for them
        self.held: list[tuple] = []
        self.size = 0
        self.compared = 0

    def add(self, r: Block, hope: float = np.inf) -> None:
        if hope + SLACK < self.floor.min():
            return
        self.compared += len(self.q.ids) * len(r.ids)
        if (self.floor > -np.inf).all():
            i, j, s = above(self.q, r, self.floor, *self.how)
            keep = s >= self.floor[i]
            i, j, s = i[keep], j[keep], s[keep]
        else:
            every = scores(self.q, r, *self.how)
            if self.k < every.shape[1]:
                self.floor = np.maximum(self.floor, -np.partition(-every, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero(np.isfinite(every) & (every >= self.floor[:, None]))
            s = every[i, j]
        if not len(i):
            return
        self.held.append((i, s, r.ids[j]))
        self.size += len(i)
        if self.size > (self.k + 1) * len(self.q.ids):
            self.reduce()

    def reduce(self, last: bool = False) -> None:
        """Keep what can be among the k best. Which of those that tie at the k-th place stay is decided at last, or when they are many: ids are slow to sort."""
        if not self.held:
            return
        i, s, ids = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids.astype(str), -s, i) if last else (-s, i))
        i, s, ids = i[order], s[order], ids[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        kth = place == self.k - 1
        self.floor[i[kth]] = np.maximum(self.floor[i[kth]], s[kth])
        keep = place < self.k if last and not self.ties else s >= self.floor[i]
        self.held = [(i[keep], s[keep], ids[keep])]
        self.size = min(int(keep.sum()), self.k * len(self.q.ids))  # ties do not bring the next turn nearer
        if not last and not self.ties and keep.sum() > 4 * self.k * len(self.q.ids):
            self.reduce(last=True)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.reduce(last=True)
        for i, s, ids in self.held:
            yield pa.RecordBatch.from_arrays([pa.array(self.q.ids[i].tolist(), pa.string()), pa.array(ids.tolist(), pa.string()), pa.array(s)], ["source", "target", "score"])


class Better:
    """For each score asked of a query: rows of a strictly better one."""

    def __init__(self, q: Block, asked: list[list[float]], raw: bool):
        self.q, self.raw, self.asked = q, raw, [(i, np.array(a)) for i, a in enumerate(asked) if a]
        self.n = [np.zeros(len(a), np.int64) for _, a in self.asked]
        self.of = {i: k for k, (i, _) in enumerate(self.asked)}
        self.least = np.array([min(a, default=np.inf) for a in asked])

    def add(self, r: Block, hope: float = np.inf) -> None:
        i, _, s = above(self.q, r, self.least, self.raw, False, False)
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for first, part in zip(starts, np.split(s, starts[1:]), strict=False):
            k = self.of[i[first]]
            self.n[k] += len(part) - np.searchsorted(np.sort(part), self.asked[k][1], "right")

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.asked:
            ids = [self.q.ids[i] for i, a in self.asked for _ in a]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(np.concatenate([a for _, a in self.asked])), pa.array(np.concatenate(self.n))], ["source", "score", "better"])


class Joined:
    """Components of what a task has linked so far: rows by numbers, dealt as their blocks come."""

    def __init__(self):
        self.parent = np.zeros(0, np.int64)
        self.last: tuple | None = None

    def numbers(self, b: Block) -> int:
        """First number of the rows of a block that is new here."""
        at = len(self.parent)
        self.parent = np.concatenate([self.parent, np.arange(at, at + len(b.ids))])
        return at

    def of_data(self, r: Block) -> int:
        """The same for a block of data, which all blocks of queries that ask for it see one after the other."""
        if self.last is None or self.last[0] is not r:
            self.last = (r, self.numbers(r))
        return self.last[1]

    def roots(self, a: np.ndarray) -> np.ndarray:
        at = a
        while True:
            up = self.parent[at]
            if (up == at).all():
                break
            at = up
        self.parent[a] = at
        return at

    def joins(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Places of the pairs that join two components, one after the other."""
        a, b = self.roots(a), self.roots(b)
        apart, fresh = np.flatnonzero(a != b), []
        parent: dict[int, int] = {}
        for k, x, y in zip(apart.tolist(), a[apart].tolist(), b[apart].tolist(), strict=True):
            while x in parent:
                x = parent[x]
            while y in parent:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                fresh.append(k)
        if parent:
            self.parent[list(parent)] = list(parent.values())
        return fresh


class Links:
    """Pairs of at least a score that join what other pairs of the task have not: fewer than the task has rows, and as connected as all pairs."""

    def __init__(self, q: Block, least: float, raw: bool, joined: Joined):
        self.q, self.least, self.raw, self.joined = q, np.full(len(q.ids), least), raw, joined
        self.first = joined.numbers(q)
        self.held: list[tuple] = []

    def add(self, r: Block, hope: float = np.inf) -> None:
        i, j, s = above(self.q, r, self.least, self.raw, False, False)
        fine = s >= self.least[i]
        i, j = i[fine], j[fine]
        if len(i) and (fresh := self.joined.joins(self.first + i, self.joined.of_data(r) + j)):
            self.held.append((self.q.ids[i[fresh]], r.ids[j[fresh]]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            source, target = (np.concatenate(c).tolist() for c in zip(*self.held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(target, pa.string())], ["source", "target"])

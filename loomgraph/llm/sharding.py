"""Sharding by histogram sort: shards of nearly equal bytes in one global order.

Rows are ordered by a 63-bit key: CRC-32 of the text, then a hash of doc_id; so equal texts
are neighbours. Each round counts the exact bytes and rows below a set of candidate
boundaries in all partitions at once (fixed-size partial sums), and probes more finely
around each wanted boundary, first between texts, then inside a group of
equal texts where the group is too large to go whole to one side. Rounds end when all boundaries are within
``TOLERANCE`` of a shard's share, or a single row is left between two probes. Then every row
goes through one exchange to its final place.

Shards are also cut into buckets of about ``BUCKET_ROWS`` rows by the same probing; the
exchange and the numbering work on buckets, whose first slots are known from the counts, so
neither a shard nor a group of copies has to fit in a task.

Null texts count as empty (eight bytes, CRC 0). Null doc_ids sort with their hash. Repeated
rows are rows; rows equal in doc_id and text take neighbouring slots. An empty table gives no rows. Extra columns are ignored
unless ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 24
#: Share of a shard's bytes by which a boundary may be off: between texts, and inside a group.
TOLERANCE, FINE = 0.005, 0.001
BUCKET_ROWS, MOST_BUCKETS, PROBES = 50_000, 4096, 64
_LOW = 31
_END = 2**63 - 1


def keyed(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, key and the ``keep`` columns."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    low = F.xxhash64("doc_id").bitwiseAND(F.lit(2**_LOW - 1))
    return df.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), crc.alias("text_crc32"),
        F.shiftleft(crc, _LOW).bitwiseOR(low).alias("key"), *keep,
    )


def _count(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows whose key is below each probe."""

    def run(batches):
        total = np.zeros((2, len(probes) + 1), np.int64)
        for batch in batches:
            key, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            at = np.searchsorted(probes, key, "right")
            np.add.at(total[0], at, size)
            np.add.at(total[1], at, 1)
        some = np.flatnonzero(total[1])
        if some.size:
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["at", "bytes", "n"])

    got = rows.select("key", "size").mapInArrow(run, "at bigint, bytes bigint, n bigint").groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    total = np.zeros((2, len(probes) + 1), np.int64)
    for r in got:
        total[:, r.at] = r["bytes"], r.n
    below = np.cumsum(total, axis=1)[:, :-1]
    return below[0], below[1]


def boundaries(rows: DataFrame, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the bucket boundaries, the shard above each, and the rows below each.

    The first boundary is 0; bucket k holds the keys from boundary k up to the next.
    """
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = int(min(max(1, MOST_BUCKETS // shards), max(1, -(-n // (shards * BUCKET_ROWS)))))
    share = total / shards
    goals = np.arange(1, shards * parts)
    target = total * goals / (shards * parts)
    main = goals % parts == 0
    slack = np.where(main, TOLERANCE * share, 0.2 * share / parts)
    fine = np.where(main, FINE * share, 0.2 * share / parts)
    known = {0: (0, 0), _END: (total, n)}
    probes = np.linspace(0, 2**32, 64 * PROBES + 1).astype(np.int64)[1:-1] << _LOW
    while len(goals) and n:
        for key, b, r in zip(probes.tolist(), *(x.tolist() for x in _count(rows, probes)), strict=True):
            known[key] = (b, r)
        keys = np.array(sorted(known))
        below = np.array([known[k][0] for k in keys.tolist()])
        count = np.array([known[k][1] for k in keys.tolist()])
        hi = np.clip(np.searchsorted(below, target, "left"), 1, len(keys) - 1)
        lo = hi - 1
        near = np.minimum(np.abs(below[lo] - target), np.abs(below[hi] - target))
        between = (keys[lo] >> _LOW << _LOW == keys[lo]) & (keys[hi] - keys[lo] >= 2**_LOW)  # no group is entered yet
        done = (near <= np.where(between, slack, fine)) | (count[hi] - count[lo] <= 1) | (keys[hi] - keys[lo] <= 1)
        if done.all():
            break
        fresh = set()
        for a, b in {(int(keys[x]), int(keys[y])) for x, y in zip(lo[~done], hi[~done], strict=True)}:
            step = 2**_LOW if b - a > 2**_LOW else 1
            span = (min(b, 2**63 - 1) - a) // step
            fresh |= {a + step * (span * k // PROBES) for k in range(1, PROBES)} | {a + step, a + step * max(1, span - 1)}
        probes = np.array(sorted(k for k in fresh if k not in known), np.int64)
        if not probes.size:
            break
    edges, shard, rows_below = [0], [0], [0]
    for g in range(1, shards * parts):
        if n:
            x, y = keys[hi[g - 1] - 1], keys[hi[g - 1]]
            best = int(min((x, y), key=lambda k: abs(known[int(k)][0] - target[g - 1])))
        else:
            best = _END
        # boundaries that meet leave empty buckets between them, which are left out; the last one names the shard
        if best == edges[-1]:
            shard[-1] = g // parts
        else:
            edges.append(best)
            shard.append(g // parts)
            rows_below.append(known[best][1] if n else 0)
    return np.array(edges, np.int64), np.array(shard, np.int32), np.array(rows_below, np.int64)


def shards(df: DataFrame, count: int = SHARDS, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the ``keep`` columns."""
    rows = cut(keyed(df), "keys")
    edges, shard, rows_below = boundaries(rows, count)
    first = {}
    for s, r in zip(shard.tolist(), rows_below.tolist(), strict=True):
        first.setdefault(s, r)
    base = rows_below - np.array([first[s] for s in shard.tolist()])
    out = keyed(df, keep) if keep else rows

    def run(batches):
        for batch in batches:
            at = np.searchsorted(edges, batch.column(3).to_numpy(zero_copy_only=False), "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(shard[at]), pa.array(base[at])], [*batch.schema.names, "bucket", "shard", "base"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    placed = out.mapInArrow(run, f"{fields}, bucket bigint, shard int, base bigint")
    slot = F.col("base") + F.row_number().over(Window.partitionBy("bucket").orderBy("key", "doc_id")) - 1
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *keep)


def write_shards(df: DataFrame, path: str, count: int = SHARDS, columns: Sequence[str] = ("text",)) -> None:
    """Write each shard's rows, in slot order, under ``path``/shard=k."""
    shards(df, count, columns).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

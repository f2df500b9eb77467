"""MinHash near-duplicate detection with circulant permutations.

Two permutations of the 32-bit universe make all signature coordinates: every shingle
goes once through the first; coordinate k is the smallest value of the second one,
circularly shifted by k (mod 2^32). Signatures are cut into bands; documents that agree in
a whole band share a bucket; candidates are confirmed on full shingle sets.

Shape of the work, for groups of any size:

* Documents with the same shingle set form a class and only its smallest doc_id goes on.
* No bucket is gathered in one task or expanded into its pairs. Members are first compared with two
  members of their bucket, the one that shares most buckets with others (the text that many near copies stem from, say) and one by chance;
  what full sets confirm is linked and contracted, and the next round looks only at buckets that still hold several components.
* What is still apart then is compared exactly, for buckets of any size: two sets that are alike share one of the
  rarest shingles of each (a prefix of n - ceil(n * percent / 100) + 1 in the order of their counts), so such shingles take the place
  of the buckets. A document with enough shingles of its own has none in common there, whatever passages it shares with others.
  After one more round all pairs of different components that share such a shingle are compared.
* Before full sets are, pairs are compared inside the join, so that those that fail are never rows. While members meet a few others only, two bits of
  each coordinate are compared, of which ``LEAST_AGREE`` places must agree (a pair of similarity 0.75 falls below it about once in a million, and is
  met again among what is still apart); in that last stage only bounds that hold for every pair decide: the places of common shingles, and bitmaps of the
  sets, which bound the number of shared shingles from above.
* A link is confirmed by two joins with the table of sets, where a member that many are compared with is one row; links
  are a few for each member of a component, whatever its size.
* Components come from hooking to the smallest neighbour, pointer jumping and contraction.

A similarity of exactly 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6.

Null, empty and blank texts have an empty set and are linked with nothing. Texts of fewer than
five words count as one shingle. Very long texts are read whole. Rows with null doc_id are
linked with nothing (component null, kept true). Rows that repeat a doc_id are expected to
repeat the text; with several texts the one with the least digest stands for the doc_id. Extra
columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, bounded, cut, slices, without, words_of

COORDINATES, BANDS = 128, 32
ROWS_PER_BAND = COORDINATES // BANDS
LEAST_AGREE = 82
#: Rounds in which members of buckets, and then of rare shingles, are compared with a few others only.
BAND_ROUNDS, SHINGLE_ROUNDS = 2, 1
#: Buckets with two members each, of 50 bytes, that are broadcast.
BROADCAST_BUCKETS = 250_000
#: Longs of the bitmap of a set.
BITMAP = 16
CHUNK_BYTES = 2 << 20
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_hashes(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Distinct 64-bit fingerprints, sorted, of the ``size``-word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
        for k in range(n):
            out = (out ^ (h[k : len(h) - n + 1 + k])) * _MULT[k % 8]
            out ^= out >> np.uint64(29)
    return np.unique(out)


def _mix_first(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _mix_second(x: np.ndarray, out: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    np.right_shift(x, 16, out=tmp)
    np.bitwise_xor(x, tmp, out=out)
    np.multiply(out, np.uint32(0x85EBCA6B), out=out)
    np.right_shift(out, 13, out=tmp)
    np.bitwise_xor(out, tmp, out=out)
    np.multiply(out, np.uint32(0xC2B2AE35), out=out)
    np.right_shift(out, 16, out=tmp)
    np.bitwise_xor(out, tmp, out=out)
    return out


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of coordinates per set; empty sets get all ones."""
    sig = np.full((len(sets), coordinates), 0xFFFFFFFF, np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return sig
    lens = np.array([len(sets[i]) for i in some])
    starts = np.cumsum(lens) - lens
    with np.errstate(over="ignore"):
        first = _mix_first((np.concatenate([sets[i] for i in some]) >> np.uint64(32)).astype(np.uint32))
        # blocks of whole sets that stay in the processor's cache
        block = 1 << 15
        at = 0
        while at < len(some):
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + block)))
            a, b = starts[at], starts[end - 1] + lens[end - 1]
            x, local = first[a:b].copy(), starts[at:end] - a
            out, tmp = np.empty_like(x), np.empty_like(x)
            rows = some[at:end]
            for k in range(coordinates):
                sig[rows, k] = np.minimum.reduceat(_mix_second(x, out, tmp), local)
                x += np.uint32(1)  # the circular shift
            at = end
    return sig


def profile(df: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set), keys (of the bands) and bits (two of each coordinate)."""

    def run(batches):
        hashes = WordHashes(seed=1)
        for batch in slices(batches, "text", CHUNK_BYTES):
            hashes.trim()
            sets = [shingle_hashes(words_of(t), hashes, size) for t in batch.column(1).to_pylist()]
            sig = signatures(sets)
            keys = band_keys(sig)
            bits = np.concatenate([np.packbits(sig >> np.uint32(k) & np.uint32(1), axis=1).view(np.int64) for k in (0, 1)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    _lists(keys),
                    _lists(bits),
                ],
                ["doc_id", "n_shingles", "set_key", "keys", "bits"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, keys array<bigint>, bits array<bigint>")


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; bands never share keys on purpose."""
    rows = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS_PER_BAND)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MULT[7], rows.shape[:2]).copy()
        for k in range(ROWS_PER_BAND):
            out = (out ^ rows[:, :, k]) * _MULT[k]
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(s.tobytes()) if len(s) else b""


def shingle_sets(df: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, set_key, the whole shingle set as a sorted array of fingerprints, and its bitmap."""

    def run(batches):
        hashes = WordHashes(seed=1)
        for batch in slices(batches, "text", CHUNK_BYTES):
            hashes.trim()
            sets = [shingle_hashes(words_of(t), hashes, size) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))), _lists(bitmaps(flat, offsets))],
                ["doc_id", "set_key", "shingles", "bitmap"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, set_key binary, shingles array<bigint>, bitmap array<bigint>")


def bitmaps(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bit for each shingle of each ragged row, in ``BITMAP`` longs."""
    width = 64 * BITMAP
    bits = np.zeros((len(offsets) - 1, width), bool)
    bits[np.repeat(np.arange(len(bits)), np.diff(offsets)), flat >> np.uint64(32) & np.uint64(width - 1)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each node of ``links`` reaches.

    Each round hooks every node to its smallest neighbour (or itself), follows the hooks to their
    ends by pointer jumping, and replaces links by links between those ends; what
    is left shrinks at least by half each round. State is cut to the shared folder.
    Only aggregations with partial sums and equi-joins; no node's links are gathered. Null ends are ignored.
    """
    both = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = both.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = cut(both.union(both.select(F.col("y"), F.col("x"))).distinct(), "edges")
    labels = None
    while True:
        hooks = edges.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to"))
        while True:
            hooks = cut(hooks, "hooks")
            further = hooks.where("x <> to").select(F.col("x").alias("to"), F.col("to").alias("end"))
            longer = cut(hooks.join(further, "to"), "longer")
            if longer.isEmpty():
                break
            hooks = hooks.join(longer.select("x", "end"), "x", "left").select("x", F.coalesce("end", "to").alias("to"))
        if labels is None:
            labels = hooks.select(F.col("x").alias("node"), F.col("to").alias("root"))
        else:
            labels = labels.join(hooks.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = cut(labels, "labels")
        edges = edges.join(hooks.toDF("x", "p"), "x").select("y", "p").join(hooks.toDF("y", "q"), "y").where("p <> q")
        edges = cut(edges.select(F.col("p").alias("x"), F.col("q").alias("y")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def _agree(x: str, y: str):
    """Coordinates, of two signatures held as ``bits``, that agree in both bits."""
    bit = lambda c, k: F.get(F.col(c), F.lit(k))
    differ = [F.bit_count(bit(x, k).bitwiseXOR(bit(y, k)).bitwiseOR(bit(x, k + 2).bitwiseXOR(bit(y, k + 2)))) for k in (0, 1)]
    return F.lit(COORDINATES) - differ[0] - differ[1]


def _rooted(keys: DataFrame, clusters: DataFrame) -> DataFrame:
    """``keys`` (bucket, rep, ...) with root, the component of rep."""
    return keys.join(clusters.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _mixed(now: DataFrame) -> DataFrame:
    """The rows of buckets with several components."""
    ends = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return cut(now.join(bounded(cut(ends.where("low <> high").select("bucket"), "mixed-buckets")), "bucket", "left_semi"), "mixed")


def _alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree well enough."""
    bits = reps.select("rep", "bits")
    pairs = pairs.join(bits.toDF("a", "x"), "a").join(bits.toDF("b", "y"), "b")
    return pairs.where(_agree("x", "y") >= LEAST_AGREE).select("a", "b")


def _ties(now: DataFrame, reps: DataFrame, turn: int) -> DataFrame:
    """a < b: members of a bucket and two members of other components of it: by chance, and in the first turn one by its popularity."""
    member = F.struct(F.xxhash64("rep", F.pmod("bucket", F.lit(4)), F.lit(turn)).alias("h"), "rep", "root")
    first = F.min(member) if turn else F.max(F.struct("popularity", -F.col("rep"), "rep", "root"))
    tops = cut(now.groupBy("bucket").agg(first.alias("c0"), F.max(member).alias("c1")), "tops")
    centres = F.array(*[F.struct(F.col(c)["rep"].alias("rep"), F.col(c)["root"].alias("root")) for c in ("c0", "c1")])
    pairs = now.join(bounded(tops, BROADCAST_BUCKETS), "bucket").select("rep", "root", F.explode(centres).alias("c")).where("c.root <> root")
    return _alike(pairs.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct(), reps)


def _all_ties(now: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """a < b: all pairs of different components that share a rare shingle, the bucket, and may be alike.

    Two members of the bucket's main component never are such a pair, so it is not compared with itself.
    """
    main = now.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    now = now.join(bounded(cut(main, "main"), BROADCAST_BUCKETS), "bucket").join(marks, "rep")
    # plain columns instead of arrays keep the condition of the join short enough to be compiled
    words = [F.get("bitmap", F.lit(k)).alias(f"m{k}") for k in range(BITMAP)]
    now = cut(now.select("bucket", "place", "rep", "root", "main", "n_shingles", *words), "members")
    few = now.where("root <> main").drop("main")
    few = few.toDF(*[f"{c}_b" for c in few.columns])
    here, there = (lambda c: F.coalesce(c, F.lit(0)), lambda c: F.coalesce(f"{c}_b", F.lit(0)))
    differ = lambda c, k: here(f"{c}{k}").bitwiseXOR(there(f"{c}{k}"))
    total = lambda counts: functools.reduce(lambda a, b: a + b, counts)
    n, n_b = here("n_shingles"), there("n_shingles")
    far = (F.col("root") != F.col("root_b")) & ((F.col("root") == F.col("main")) | (F.col("rep") < F.col("rep_b")))
    # if this is their first common shingle, enough must be left from here on to be in common
    left = F.least(n - here("place"), n_b - there("place")) * (100 + percent) >= (n + n_b) * percent
    # sets that differ in d shingles or more have (n + n_b - d) / 2 in common at most
    mapped = total([F.bit_count(differ("m", k)) for k in range(BITMAP)]) * (100 + percent) <= (n + n_b) * (100 - percent)
    pairs = now.join(few, (F.col("bucket") == F.col("bucket_b")) & left & far & mapped)
    return pairs.select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    sets = sets.select("rep", "shingles")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("shared", shared).where(F.col("shared") * 100 >= (F.size("x") + F.size("y") - F.col("shared")) * percent).select("a", "b")


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """bucket, rep, place: the shared shingles of each set of which a set alike to it must hold one, with their places in the order of counts.

    Shingles that stand in one set only come first in it and are left out; a set with a prefix full of them has no row.
    """
    rows = sets.select("rep", "n_shingles", F.explode("shingles").alias("bucket"))
    counts = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-shingles")
    shared = rows.join(bounded(counts), "bucket")
    own = Window.partitionBy("rep")
    shared = shared.select("*", F.row_number().over(own.orderBy("n", "bucket")).alias("rank"), F.count(F.lit(1)).over(own).alias("common"))
    place = F.col("n_shingles") - F.col("common") + F.col("rank") - 1
    size = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    return shared.withColumn("place", place).where(F.col("place") < size).select("bucket", "rep", "place")


def _linked(bands: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, root: the components of the members of ``bands`` (bucket, rep, popularity) by confirmed links."""
    links = clusters = None

    def confirm(pairs: DataFrame) -> DataFrame:
        nonlocal links
        found = cut(_confirmed(cut(pairs, "ties"), sets, percent), "links")
        if links is not None and found.isEmpty():
            return clusters
        links = found if links is None else links.union(found)
        return components(links)

    now = bands.withColumn("root", F.col("rep"))
    for turn in range(BAND_ROUNDS):
        clusters = confirm(_ties(now, reps, turn))
        now = _mixed(_rooted(now.drop("root"), clusters))
    apart = cut(now.select("rep").distinct(), "apart")
    alone = cut(sets.join(bounded(apart), "rep", "left_semi"), "sets-apart")
    now = _mixed(_rooted(cut(_rarest(alone, percent), "rarest"), clusters))
    for turn in range(BAND_ROUNDS, BAND_ROUNDS + SHINGLE_ROUNDS):
        clusters = confirm(_ties(now, reps, turn))
        now = _mixed(_rooted(now.drop("root"), clusters))
    return confirm(_all_ties(now, alone.select("rep", "bitmap", "n_shingles"), percent))


def near_duplicates(df: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row of ``df`` (doc_id, text)."""
    docs = cut(profile(df, size), "profiles")
    some = docs.where("n_shingles > 0 and doc_id is not null")
    # a class has a representative, and a doc_id has a class, even if it comes with several texts
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    reps = cut(classes.groupBy("rep").agg(F.min(F.struct("set_key", "n_shingles", "keys", "bits")).alias("s")).select("rep", "s.*"), "classes")
    bands = reps.select("rep", F.explode("keys").alias("bucket"))
    shared = cut(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    bands = cut(bands.join(bounded(shared), "bucket"), "bands")
    popular = bands.groupBy("rep").agg(F.sum("n").alias("popularity"))  # how many others it shares buckets with, counted for each
    bands = cut(bands.drop("n").join(popular, "rep"), "bands")
    members = cut(bands.select("rep").distinct().join(reps.select("rep", "set_key", "n_shingles"), "rep").withColumnRenamed("rep", "doc_id"), "members")
    texts = df.select("doc_id", "text").join(bounded(members.select("doc_id")), "doc_id", "left_semi")
    sets = shingle_sets(texts, size).join(members, ["doc_id", "set_key"])
    sets = sets.groupBy(F.col("doc_id").alias("rep")).agg(*[F.first(c).alias(c) for c in ("n_shingles", "shingles", "bitmap")])
    roots = _linked(bands, reps, cut(sets, "sets"), percent)
    named = reps.select("set_key", "rep").join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select("set_key", F.coalesce("root", "rep").alias("component_id"))
    out = docs.join(named, "set_key", "left")
    # an empty set has no class and links with nothing
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """The rows of ``df`` whose document is the first of its component."""
    return without(df, near_duplicates(df, percent, size).where("not kept"))

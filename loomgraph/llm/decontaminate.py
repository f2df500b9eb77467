"""Benchmark decontamination by spaced-seed hashing.

A document holds a benchmark item if, at some offset between the two, at least
``LEAST`` (10) words are equal within ``WINDOW`` (13) consecutive positions: up to three
substitutions are tolerated. Items of five to nine words must occur whole; shorter ones are
too common to tell and never match. Words are maximal runs of non-white-space with A-Z
lower-cased and ASCII punctuation stripped at both ends.

``MASKS`` say which positions of a span are hashed. Whatever three positions of a
window differ, one of the masks fits between them (checked in the tests), so every
such window gives a hit between the benchmark's hashes and the documents' hashes. Each
hit names an offset; there all words are compared and the windows are counted exactly.
Offsets of one document and item count once, however many hits name them; where words repeat so often
that hits are many times the words, offsets come from a convolution of the places.

The benchmark's hashes are broadcast in blocks of distinct items of bounded size (one item may be larger); a larger
benchmark takes more passes, never a larger broadcast, and each pass is a job of its own whose workers hold one block. Documents are read whole, each row is decided by
itself. With one block nothing is shuffled or joined; with more, documents are written once with a row number, passes write the (row, item) pairs they find, and
those are joined to the rows.

Null, empty and short texts match nothing; null and empty items are ignored. Rows are decided by their text, so rows with null or
repeated doc_id are too; a null item_id counts as one item without a name. A repeated document counts each time it occurs, items of
one id once. Extra columns, whatever their names, are ignored by ``flags`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, cut, slices, words_of

#: Positions that count, from the first: every three substitutions in 13 words leave one of them whole.
MASKS = ("110111", "1101000011", "1110001000001")
WINDOW, LEAST, SHORTEST = 13, 10, 5
#: Item text bytes of a block.
BLOCK_BYTES = 2 << 20
CHUNK_BYTES = 2 << 20
_STRIP = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_BITS = 22
#: Pairs of equal hashes that are spread out at once, and words of a document whose offsets are convolved at once.
_SPREAD, _SPAN = 1 << 21, 1 << 17
_FOLD = np.uint64(0x9E3779B97F4A7C15)


class _Stripped(WordHashes):
    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_STRIP) or word
        h = super().__missing__(bare)
        self[word] = h
        return h


def _spaced(h: np.ndarray, places: list[int]) -> np.ndarray:
    """Hash of the words at the places after each position; the span must fit."""
    n = len(h) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for p in places:
            out = (out ^ h[p : p + n]) * _FOLD
            out ^= out >> np.uint64(31)
    return out


class Items:
    """The hashed items of a block and their seeds, one table for each mask and each short length."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        hashes = _Stripped(seed=2)
        self.ids, self.words = [], []
        for item, text in rows:
            h = hashes.of(words_of(text))
            if len(h) >= SHORTEST:
                self.ids.append(item)
                self.words.append(h)
        self.longest = max(map(len, self.words), default=0)
        masks = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
        masks += [list(range(n)) for n in range(SHORTEST, LEAST)]
        self.tables = []
        for places in masks:
            short = len(places) if places[-1] + 1 == len(places) else 0
            keys, owners, offsets = [], [], []
            for k, h in enumerate(self.words):
                if (len(h) == short) if short else (len(h) >= LEAST):
                    s = _spaced(h, places)
                    keys.append(s)
                    owners.append(np.full(len(s), k))
                    offsets.append(np.arange(len(s)))
            if keys:
                keys = np.concatenate(keys)
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                seen = np.zeros(1 << _BITS, bool)
                seen[keys >> np.uint64(64 - _BITS)] = True
                self.tables.append((places, seen, keys, np.concatenate(owners)[order], np.concatenate(offsets)[order]))

    def _offsets(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sorted distinct codes of (document, item, offset between the two) of all hits."""
        out = [np.zeros(0, np.int64)]
        for places, seen, keys, owners, at in self.tables:
            h = _spaced(flat, places)
            hit = np.flatnonzero(seen[h >> np.uint64(64 - _BITS)])
            lo, hi = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
            doc = np.searchsorted(starts, hit, "right") - 1
            some = (hi > lo) & (hit + places[-1] < ends[doc])
            hit, lo, n, doc = hit[some], lo[some], (hi - lo)[some], doc[some]
            if n.sum() > _SPREAD:  # places of a hash in a document times its places in items
                order = np.lexsort((hit, lo, doc))
                hit, lo, n, doc = hit[order], lo[order], n[order], doc[order]
                edges = np.flatnonzero(np.diff(lo) | np.diff(doc)) + 1
                sizes = np.diff(np.concatenate([[0], edges, [len(hit)]]))
                many = np.repeat(sizes, sizes) * n > 1 << 12
                for a, b in zip(*(x.tolist() for x in (np.concatenate([[0], edges]), np.concatenate([edges, [len(hit)]]))), strict=True):
                    if many[a]:
                        mine, where = owners[lo[a] : lo[a] + n[a]], at[lo[a] : lo[a] + n[a]]
                        for item in np.unique(mine).tolist():
                            out.append(self._code(int(doc[a]), item, _differences(hit[a:b], where[mine == item]), len(flat)))
                hit, lo, n, doc = hit[~many], lo[~many], n[~many], doc[~many]
            upto = np.cumsum(n)
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _SPREAD, "right")))
                m = n[a:b]
                which = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                out.append(np.unique(self._code(np.repeat(doc[a:b], m), owners[which], np.repeat(hit[a:b], m) - at[which], len(flat))))
                a = b
        return np.unique(np.concatenate(out))

    def _code(self, doc, item, offset, size: int):
        return (doc * len(self.words) + item) * (size + self.longest) + offset + self.longest

    def found_in(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, once: bool = False) -> Iterator[tuple]:
        """(document, item, first word, words, equal words) of each match; documents are flat[starts:ends].

        With ``once``, the first match only of each document and item.
        """
        if not self.tables or not len(flat):
            return
        codes = self._offsets(flat, starts, ends)
        pair, offset = np.divmod(codes, len(flat) + self.longest)
        done = -1
        for both, first in zip(pair.tolist(), (offset - self.longest).tolist(), strict=True):
            if both == done:
                continue
            doc, item = divmod(both, len(self.words))
            words = self.words[item]
            a, b = max(first, starts[doc]), min(first + len(words), ends[doc])
            same = flat[a:b] == words[a - first : b - first]
            if len(words) < LEAST:
                if len(same) == len(words) and same.all():
                    yield doc, self.ids[item], a - starts[doc], len(words), len(words)
                    done = both if once else -1
                continue
            hits = np.flatnonzero(same)
            if len(hits) < LEAST:
                continue
            good = np.flatnonzero(hits[LEAST - 1 :] - hits[: len(hits) - LEAST + 1] < WINDOW)
            if good.size:
                x, y = hits[good[0]], hits[good[-1] + LEAST - 1]
                yield doc, self.ids[item], a - starts[doc] + x, y - x + 1, int(same[x : y + 1].sum())
                done = both if once else -1


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """All distinct differences of the sorted places p and the places q."""
    if len(p) * len(q) <= _SPREAD:
        return np.unique(p[:, None] - q[None])
    out = []
    back = np.zeros(int(q.max() - q.min()) + 1)
    back[q.max() - q] = 1
    for first in range(int(p[0]), int(p[-1]) + 1, _SPAN):
        a, b = np.searchsorted(p, [first, first + _SPAN])
        there = np.zeros(_SPAN)
        there[p[a:b] - first] = 1
        size = _SPAN + len(back) - 1
        n = 1 << (size - 1).bit_length()
        counts = np.fft.irfft(np.fft.rfft(there, n) * np.fft.rfft(back, n), n)[:size]
        out.append(np.flatnonzero(counts > 0.5) + first - int(q.max()))
    return np.unique(np.concatenate(out))


def _blocks(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks, and the distinct items in blocks of bounded size."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    if blocks > 1:
        items = cut(items, "items")
    of = lambda k: items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
    return blocks, ([tuple(r) for r in of(k).collect()] for k in range(blocks))


def _hashed(batches, at: int, column: int | None = None):
    """(batch, flat word hashes, starts, ends, rows) of slices of the batches; empty documents are left out of the arrays."""
    hashes = _Stripped(seed=2)
    for batch in slices(batches, f"c{at}", CHUNK_BYTES):
        hashes.trim()
        rows = [hashes.of(words_of(t)) for t in batch.column(at if column is None else column).to_pylist()]
        lens = np.array([len(r) for r in rows], np.int64)
        ends = np.cumsum(lens)
        some = np.flatnonzero(lens)
        yield batch, np.concatenate(rows), (ends - lens)[some], ends[some], some


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_equal: one row for each document, item and offset that match."""
    spark = documents.sparkSession
    names = ["doc_id", "item_id", "first_word", "n_words", "n_equal"]
    docs = documents.select(F.col("doc_id").alias("c0"), F.col("text").alias("c1"))

    def search(shared):
        def run(batches):
            items = Items(shared.value)
            for batch, flat, starts, ends, some in _hashed(batches, 1):
                found = list(items.found_in(flat, starts, ends))
                if found:
                    at, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some[list(at)])), *(pa.array([None if v is None else int(v) for v in x], pa.int64()) for x in rest)], names)

        return run

    count, blocks = _blocks(benchmark)
    passes = []
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        found = docs.mapInArrow(search(shared), ", ".join(f"{c} bigint" for c in names))
        if count > 1:
            found = cut(found, "matches")
            shared.destroy()
        passes.append(found)
    return functools.reduce(DataFrame.union, passes)


def _with_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of ``documents`` as c0, c1, ... and items array<bigint>, the ids of the items that each row holds."""
    spark = documents.sparkSession
    at = documents.columns.index("text")
    out = documents.toDF(*[f"c{k}" for k in range(len(documents.columns))]).withColumn("items", F.array().cast("array<bigint>"))

    def mark(shared):
        def run(batches):
            items = Items(shared.value)
            for batch, flat, starts, ends, some in _hashed(batches, at):
                held = batch.column(batch.num_columns - 1).to_pylist()
                for doc, item, *_ in items.found_in(flat, starts, ends, once=True):
                    held[some[doc]].append(item)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, pa.list_(pa.int64()))], batch.schema.names)

        return run

    def pairs(shared):
        def run(batches):
            items = Items(shared.value)
            for batch, flat, starts, ends, some in _hashed(batches, at, 0):
                found = [(int(some[doc]), item) for doc, item, *_ in items.found_in(flat, starts, ends, once=True)]
                if found:
                    rows, ids = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows)), pa.array(ids, pa.int64())], ["row", "item"])

        return run

    count, blocks = _blocks(benchmark)
    if count == 1:
        return out.mapInArrow(mark(spark.sparkContext.broadcast(next(blocks))), T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields]))
    rows = cut(out.drop("items").withColumn("row", F.monotonically_increasing_id()), "rows")
    texts, found = rows.select(F.col(f"c{at}"), "row"), []
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        found.append(cut(texts.mapInArrow(pairs(shared), "row bigint, item bigint"), "pairs"))
        shared.destroy()
    # a struct keeps the item without a name in the list
    held = functools.reduce(DataFrame.union, found).distinct().groupBy("row").agg(F.collect_list(F.struct("item")).alias("held"))
    items = F.coalesce(F.transform("held", lambda x: x["item"]), F.array().cast("array<bigint>"))
    return rows.join(held, "row", "left").select(*[c for c in out.columns if c != "items"], items.alias("items"))


def flags(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, kept (not contaminated), n_items, item_ids (sorted, comma-joined): one row per row of ``documents``."""
    out = _with_items(documents.select("doc_id", "text"), benchmark).select(F.col("c0").alias("doc_id"), F.array_distinct("items").alias("items"))
    n = F.size("items")
    return out.select("doc_id", (n > 0).alias("contaminated"), (n == 0).alias("kept"), n.cast("long").alias("n_items"), F.array_join(F.sort_array("items"), ",").alias("item_ids"))


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that match no item (all columns)."""
    out = _with_items(documents, benchmark).where(F.size("items") == 0)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(documents.columns)])

"""Collocations: phrases whose words stand together far more often than their parts would by chance.

Words of a language that stand ``LEAST`` times or more get numbers of 21 bits; all other words break pieces, as no phrase
that holds one can be frequent. Two or three numbers are packed into one 63-bit key, in reading order. Each task
counts the keys of a few million words at a time; keys are then partitioned by range, sorted within partitions (fixed-width
integers, so Spark's radix sort) and counted by run lengths. Three-word phrases are made only where both two-word parts can be frequent:
a bit set of fixed size over the keys of frequent pairs says so; it may let others pass, which the count then drops.

The numbered words are at most 2^21 - 1, the most frequent ones, so the dictionary that tasks hold is bounded. Where a corpus has more
frequent words than that, phrases that hold an unnumbered word are counted by their text instead, in an ordinary aggregation;
nothing is dropped.

Scores are whole numbers from decimal arithmetic of 38 digits (counts up to 10^16). Null and blank texts hold no words; a null lang is
``und``; repeated rows count each; very long texts are read in parts that end where a piece ends. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

LEAST, MOST_SHARE, TOP = 10, 50, 2000
#: Bits of a word's number; words that get one, at most.
WIDTH = 21
NUMBERED = 2**WIDTH - 1
#: Bits of the set of frequent pairs (16 MB).
PAIR_BITS = 27
CHUNK_BYTES = 4 << 20
#: Distinct words, or keys, that a task holds before it hands on their counts.
_WORDS, _KEYS = 400_000, 1 << 22
_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _texts(batches):
    """(lang, text bytes lower-cased with a line for each piece) over bounded slices of the batches of (lang, text)."""
    for batch in slices(batches, "text", CHUNK_BYTES):
        for lang, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist(), strict=True):
            if text:
                yield lang, text.lower().translate(_BREAKS)


def _parts(text: bytes):
    """The text in parts of about a chunk, cut between pieces."""
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + CHUNK_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")


def word_counts(df: DataFrame) -> DataFrame:
    """lang, word, n of all words of (lang, text) rows."""

    def run(batches):
        held: dict[str, Counter] = {}
        for lang, text in _texts(batches):
            for part in _parts(text):
                held.setdefault(lang, Counter()).update(part.split())
            if sum(map(len, held.values())) > _WORDS:
                yield _counted(held)
                held.clear()
        yield _counted(held)

    return _added(df.mapInArrow(run, "lang string, word binary, n bigint").withColumn("word", F.col("word").cast("string")), "lang", "word")


def _counted(held: dict[str, Counter], name: str = "word") -> pa.RecordBatch:
    langs, words, n = (pa.array(c, t) for c, t in (
        ([lang for lang, words in held.items() for _ in words], pa.string()), ([w for words in held.values() for w in words], pa.binary()), ([k for words in held.values() for k in words.values()], pa.int64()),
    ))
    return pa.RecordBatch.from_arrays([langs, words, n], ["lang", name, "n"])


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


class Dictionary:
    """Numbers (from 1) of the words of each language, and back; 0 is every other word."""

    def __init__(self, table: pa.Table):
        self.langs = table["lang"].to_pylist()
        self.words = [w.encode() for w in table["word"].to_pylist()]
        self.counts = np.concatenate([[0], table["n"].to_numpy()]).astype(np.int64)
        self.numbers: dict[str, _Numbers] = {}
        for k, (lang, word) in enumerate(zip(self.langs, self.words, strict=True), 1):
            self.numbers.setdefault(lang, _Numbers())[word] = k

    def encode(self, lang: str, text: bytes) -> np.ndarray:
        """The text's words as numbers, a 0 after each piece."""
        numbers, out = self.numbers.get(lang), []
        if numbers is None:
            return np.zeros(0, np.int64)
        for piece in text.split(b"\n"):
            out.extend(map(numbers.__getitem__, piece.split()))
            out.append(0)
        return np.array(out, np.int64)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


_held: dict[str, Dictionary] = {}


def _dictionary(shared) -> Dictionary:
    """The dictionary of a broadcast (name, Arrow table), built once in a Python worker."""
    name, table = shared.value
    if name not in _held:
        _held.clear()
        _held[name] = Dictionary(table)
    return _held[name]


def numbered(frequent: DataFrame, most: int = NUMBERED) -> tuple[DataFrame, bool]:
    """At most ``most`` of the frequent words (a cut table), the ones that stand most often, and whether that is all of them."""
    n, least = frequent.count(), 0
    if n <= most:
        return frequent, True
    while (head := frequent.where(F.col("n") > least)).count() > most:
        above = head.agg(F.percentile_approx("n", 1 - most / head.count(), 100_000)).first()[0]
        least = above if above > least else least + 1
    return head, False


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _packed(ids: np.ndarray, words: int, pairs: np.ndarray | None) -> np.ndarray:
    """Keys of all runs of ``words`` numbers; with ``pairs``, a bit set, only those whose two-word parts are all in it."""
    first, second = ids[:-1], ids[1:]
    two = (first << 2 * WIDTH) | (second << WIDTH)
    fine = (first > 0) & (second > 0)
    if words == 2:
        return two[fine]
    slot = _slot(two)
    fine &= (pairs[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)) > 0
    both = fine[:-1] & fine[1:]
    return (two[:-1] | ids[2:])[both]


def _keys(rows: DataFrame, shared, words: int, pairs=None) -> DataFrame:
    """key, n: counts of packed phrases by task, several rows of a key."""

    def counted(waiting):
        keys, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    def run(batches):
        dictionary, bits = _dictionary(shared), pairs.value if pairs is not None else None
        waiting, size = [], 0
        for lang, text in _texts(batches):
            for part in _parts(text):
                ids = dictionary.encode(lang, part)
                if len(ids) < words:
                    continue
                waiting.append(_packed(ids, words, bits))
                size += len(waiting[-1])
                if size > _KEYS:
                    yield counted(waiting)
                    waiting, size = [], 0
        if size:
            yield counted(waiting)

    return rows.mapInArrow(run, "key bigint, n bigint")


def _run_lengths(keys: DataFrame, shared, words: int, least: int) -> DataFrame:
    """key, lang, phrase, n, first, last (counts of its outer words) of the packed phrases that stand ``least`` times or more."""
    names = ["key", "lang", "phrase", "n", "first", "last"]

    def named(dictionary, key, n):
        ids = [key >> 2 * WIDTH, key >> WIDTH & NUMBERED, key & NUMBERED][:words]
        phrase = [b" ".join(dictionary.words[i - 1] for i in row) for row in zip(*(x.tolist() for x in ids), strict=True)]
        langs = [dictionary.langs[i - 1] for i in ids[0].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(langs, pa.string()), pa.array(phrase, pa.binary()), pa.array(n), pa.array(dictionary.counts[ids[0]]), pa.array(dictionary.counts[ids[-1]])], names)

    def run(batches):
        dictionary, last, total = _dictionary(shared), -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, n = key[at], np.add.reduceat(n, at)
            if key[0] == last:
                n[0] += total
            elif total >= least:
                yield named(dictionary, np.array([last]), np.array([total]))
            last, total = int(key[-1]), int(n[-1])
            often = n[:-1] >= least
            yield named(dictionary, key[:-1][often], n[:-1][often])
        if total >= least:
            yield named(dictionary, np.array([last]), np.array([total]))

    ordered = keys.repartitionByRange("key").sortWithinPartitions("key")
    out = ordered.mapInArrow(run, "key bigint, lang string, phrase binary, n bigint, first bigint, last bigint")
    return out.withColumn("phrase", F.col("phrase").cast("string"))


def _set_of(keys: DataFrame) -> np.ndarray:
    """Bit set of the slots of ``key``."""

    def slots(batches):
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array((slot & 63).astype(np.int32))], ["cell", "bit"])

    cells = keys.select("key").mapInArrow(slots, "cell bigint, bit int").groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(2 ** (PAIR_BITS - 6), np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out


def _unnumbered(rows: DataFrame, shared, words: int, frequent: DataFrame, least: int) -> DataFrame:
    """Phrases that hold a word without a number, counted by their text."""

    def run(batches):
        dictionary, held = _dictionary(shared), {}
        for lang, text in _texts(batches):
            numbers, counts = dictionary.numbers.get(lang, {}), held.setdefault(lang, Counter())
            for part in _parts(text):
                for piece in part.split(b"\n"):
                    w = piece.split()
                    known = [x in numbers for x in w]
                    counts.update(b" ".join(w[i : i + words]) for i in range(len(w) - words + 1) if not all(known[i : i + words]))
                if sum(map(len, held.values())) > _WORDS:
                    yield _counted(held, "phrase")
                    held.clear()
                    counts = held.setdefault(lang, Counter())
        yield _counted(held, "phrase")

    counted = rows.mapInArrow(run, "lang string, phrase binary, n bigint").withColumn("phrase", F.col("phrase").cast("string"))
    found = _added(counted, "lang", "phrase").where(F.col("n") >= least)
    parts = F.split("phrase", " ")
    found = found.withColumns({"w1": parts[0], "w2": F.element_at(parts, -1), "key": F.lit(None).cast("bigint")})
    for side, word in (("first", "w1"), ("last", "w2")):
        found = found.join(frequent.select("lang", F.col("word").alias(word), F.col("n").alias(side)), ["lang", word])
    return found.select("key", "lang", "phrase", "n", "first", "last")


def _score(a: Column, left: Column, right: Column) -> Column:
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = whole(whole(a, 16) * whole(a, 16), 32) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", whole(top, 38), whole(whole(left, 19) * whole(right, 19), 38))


def phrase_counts(df: DataFrame, least: int = LEAST, most: int = NUMBERED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, word, n) of all words; (key, lang, phrase, n, first, last) of the frequent pairs, and of the frequent triples; all cut."""
    rows = _rows(df)
    words = cut(word_counts(rows), "words")
    frequent = cut(words.where(F.col("n") >= least), "frequent")
    head, whole = numbered(frequent, most)
    context = df.sparkSession.sparkContext
    shared = context.broadcast((uuid.uuid4().hex, head.toArrow()))
    found, pairs = [], None
    for size in (2, 3):
        phrases = _run_lengths(cut(_keys(rows, shared, size, pairs), "keys"), shared, size, least)
        if not whole:
            phrases = phrases.unionByName(_unnumbered(rows, shared, size, frequent, least))
        found.append(cut(phrases, "phrases"))
        if size == 2:
            pairs = context.broadcast(_set_of(found[0].where("key is not null")))
    return words, *found


def collocations(df: DataFrame, least: int = LEAST, share: int = MOST_SHARE, top: int = TOP, most: int = NUMBERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each lang by the score of their weakest cut.

    A phrase is dropped if a longer candidate that holds its words in a row stands at least ``share`` percent as often.
    """
    words, two, three = phrase_counts(df, least, most)
    totals = _added(words, "lang")
    pairs = two.select("lang", "phrase", F.col("n").alias("a"), F.col("first").alias("l"), F.col("last").alias("r"), _score(F.col("n"), F.col("first"), F.col("last")).alias("score"))
    w = F.split("phrase", " ")
    cuts = three.select("lang", "phrase", "n", F.explode(F.array(
        F.struct(F.lit(1).alias("k"), F.concat_ws(" ", w[1], w[2]).alias("part"), F.col("first").alias("single")),
        F.struct(F.lit(2).alias("k"), F.concat_ws(" ", w[0], w[1]).alias("part"), F.col("last").alias("single")),
    )).alias("c")).select("lang", "phrase", "n", "c.*")
    weighed = cuts.join(two.select("lang", F.col("phrase").alias("part"), F.col("n").alias("m")), ["lang", "part"])
    left, right = F.when(F.col("k") == 1, F.col("single")).otherwise(F.col("m")), F.when(F.col("k") == 1, F.col("m")).otherwise(F.col("single"))
    weakest = F.min(F.struct(_score(F.col("n"), left, right).alias("score"), "k", left.alias("l"), right.alias("r")))
    triples = weighed.groupBy("lang", "phrase").agg(F.first("n").alias("a"), weakest.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    longer = cuts.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("n").alias("most"))
    alone = pairs.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = functools.reduce(DataFrame.unionByName, [alone, triples]).withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

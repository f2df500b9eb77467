"""Token ids in binary files: patched frame-of-reference blocks with an index, in the order of doc_id.

A file holds whole documents of one range of doc_ids, about ``FILE_TOKENS`` ids (one document more at most):

    header   64 bytes: magic, ids in a block, exceptions, partition, number within it, documents, ids, blocks (little-endian)
    blocks   for each: minimum (u32), width (u8), exceptions (u8), byte offset in the data (u64): the index of block starts
    patches  position in the block (u8) of each exception, then its distance from the minimum (u32)
    docs     doc_id (i64), whether it is null (u8), first id (u64; one more at the end)
    data     the blocks: distances from the minimum in ``width`` bits each, lowest bit first
    end      one line feed

Blocks have 128 ids (the last one is filled up with its minimum). The width is what the ``PERCENTILE``-th largest distance needs;
larger ones are exceptions and keep a zero in the data. Any range of ids is read from the blocks that hold it.

Rows are partitioned by range of (doc_id, hash of the text, row), so neither a repeated doc_id nor nulls (which come first) make one large
partition, and encoded where they arrive. Files are written by Spark's own writer through its commit protocol, to any file system, a file for each row; a lost
task is written again.

Where the vocabulary drops white space, texts are split there and each word is encoded once by a Python worker while it is remembered; ASCII letters and ``MARKS`` after them
apart, where its pre-tokenizer splits them. Elsewhere texts are encoded whole.

Null and empty texts have no ids but the end id. Repeated rows are documents each, in the order of their text's hash. Very long texts are encoded whole. An
empty table gives no file and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch_dir, slices

END_ID = 2
BLOCK, PERCENTILE = 128, 90
FILE_TOKENS = 2 << 20
#: Bytes of text of a partition, about, and of a chunk of it.
PARTITION_BYTES, CHUNK_BYTES = 32 << 20, 4 << 20
#: Words whose ids are kept (at most twice as many and a chunk's), and bytes of a word that is.
KEPT, LONG_WORD = 500_000, 64
#: What may follow a word without being part of it.
MARKS = ".,;:!?*#$&)]}%"
_MARKS = MARKS.encode()
MAX_VOCAB_BYTES = 64 << 20
_HEADER = struct.Struct("<8sIIqqqqqq")
_MAGIC = b"LGTOKEN1"
#: Blocks packed or opened at once.
_BLOCKS = 4096


def pack(deltas: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK whole numbers below 2^width, as rows of 16 * width bytes."""
    bits = np.unpackbits(np.ascontiguousarray(deltas, "<u4").view(np.uint8).reshape(-1, BLOCK, 4), axis=2, count=width, bitorder="little") if width else np.zeros((len(deltas), BLOCK, 0), np.uint8)
    return np.packbits(bits.reshape(len(deltas), -1), axis=1, bitorder="little")


def unpack(data: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(data), BLOCK), np.uint32)
    bits = np.unpackbits(data, axis=1, bitorder="little").reshape(len(data), BLOCK, width)
    full = np.zeros((len(data), BLOCK, 32), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0]


def to_file(ids: np.ndarray, doc_ids: np.ndarray, null: np.ndarray, starts: np.ndarray, partition: int = 0, number: int = 0, percentile: int = PERCENTILE) -> bytes:
    """The file of the documents whose ids lie one after the other in ``ids``, without its end."""
    blocks = -(-len(ids) // BLOCK)
    low, width, n_exc = np.zeros(blocks, np.uint32), np.zeros(blocks, np.uint8), np.zeros(blocks, np.uint8)
    data: list[bytes] = []
    places, values = [], []
    for at in range(0, blocks, _BLOCKS):
        some = ids[at * BLOCK : (at + _BLOCKS) * BLOCK].astype(np.uint32)
        n = -(-len(some) // BLOCK)
        short = n * BLOCK - len(some)
        if short:
            some = np.concatenate([some, np.full(short, some[(n - 1) * BLOCK :].min(), np.uint32)])
        x = some.reshape(n, BLOCK)
        part = slice(at, at + n)
        low[part] = x.min(axis=1)
        deltas = x - low[part][:, None]
        usual = np.partition(deltas, (BLOCK - 1) * percentile // 100, axis=1)[:, (BLOCK - 1) * percentile // 100]
        width[part] = np.frexp(usual.astype(float))[1]
        over = deltas >> np.minimum(width[part], 31)[:, None] > 0
        over &= (width[part] < 32)[:, None]
        n_exc[part] = over.sum(axis=1)
        places.append(np.nonzero(over)[1].astype(np.uint8))
        values.append(deltas[over].astype("<u4"))
        deltas[over] = 0
        rows: list[bytes] = [b""] * n
        for w in np.unique(width[part]).tolist():
            own = np.flatnonzero(width[part] == w)
            for k, row in zip(own.tolist(), pack(deltas[own], w), strict=True):
                rows[k] = row.tobytes()
        data.extend(rows)
    offsets = np.cumsum(width.astype(np.int64) * (BLOCK // 8)) - width.astype(np.int64) * (BLOCK // 8)
    exceptions = int(n_exc.sum(dtype=np.int64))
    return b"".join([
        _HEADER.pack(_MAGIC, BLOCK, 0, exceptions, partition, number, len(doc_ids), len(ids), blocks), low.astype("<u4").tobytes(), width.tobytes(), n_exc.tobytes(), offsets.astype("<u8").tobytes(),
        *[p.tobytes() for p in places], *[v.tobytes() for v in values], doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes(), *data,
    ])


@dataclass
class TokenFile:
    """An opened file: the index as arrays, ids on demand."""

    content: bytes

    def __post_init__(self):
        magic, block, _, exceptions, self.partition, self.number, docs, self.n_tokens, self.n_blocks = _HEADER.unpack_from(self.content)
        if magic != _MAGIC or block != BLOCK or self.content[-1:] != b"\n":
            raise ValueError("not a whole token file")
        self._at = _HEADER.size
        self.low, self.width, self.n_exc, self.block_starts = (self._take(t, self.n_blocks) for t in ("<u4", "u1", "u1", "<u8"))
        self.places, self.values = self._take("u1", exceptions), self._take("<u4", exceptions)
        self.doc_ids, self.null, self.starts = self._take("<i8", docs), self._take("u1", docs), self._take("<u8", docs + 1).astype(np.int64)
        self.data = np.frombuffer(self.content, np.uint8, len(self.content) - 1 - self._at, self._at)
        self._exc_starts = np.concatenate([[0], np.cumsum(self.n_exc, dtype=np.int64)])

    def _take(self, dtype: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.content, dtype, n, self._at)
        self._at += out.nbytes
        return out

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file; only the blocks that hold them are opened."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        out = np.concatenate([self._blocks(at, min(at + _BLOCKS, last)) for at in range(first, last, _BLOCKS)])
        return out[start - first * BLOCK : stop - first * BLOCK]

    def _blocks(self, first: int, last: int) -> np.ndarray:
        out = np.zeros((last - first, BLOCK), np.uint32)
        widths = self.width[first:last]
        for w in np.unique(widths).tolist():
            own = np.flatnonzero(widths == w)
            at = self.block_starts[first + own].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)
            out[own] = unpack(self.data[at], w)
        part = slice(self._exc_starts[first], self._exc_starts[last])
        out[np.repeat(np.arange(last - first), self.n_exc[first:last]), self.places[part]] = self.values[part]
        return (out + self.low[first:last, None]).ravel()


def _tokenizer(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(data)


def _by_words(tokenizer) -> bool:
    """Whether white space is dropped, so that a text's ids are those of its words."""
    ids = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    spaces = " \t\n\x0b\x0c\r"
    return all(ids(f"a{s}b{s}{s}1{s}") == ids("a") + ids("b") + ids("1") for s in spaces) and not any(c in t.content for t in tokenizer.get_added_tokens_decoder().values() for c in spaces)


def _plain_words(tokenizer, marks: str) -> bool:
    """Whether ASCII letters are one piece, in lower case, and marks after them another, whatever stands there; no added token is among them."""
    normal, before = tokenizer.normalizer, tokenizer.pre_tokenizer
    if normal is None or before is None or any(t.content.isalpha() or set(t.content) & set(marks) for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    pieces = lambda s: before.pre_tokenize_str(normal.normalize_str(s))
    letters = string.ascii_lowercase
    return pieces(string.ascii_uppercase) == [(letters, (0, 26))] and [at for _, at in pieces(letters + marks)] == [(0, 26), (26, 26 + len(marks))]


class Encoder(dict):
    """word -> packed ids. Words not asked for while ``KEPT`` others were are forgotten.

    A word that holds no added token is normalized, split and looked up by the library's own parts of the vocabulary, which is what its ``encode`` does, without
    offsets; ASCII letters go to the model at once.
    """

    def __init__(self, data: bytes, dtype: str):
        super().__init__()
        self.tokenizer, self.old = _tokenizer(data), {}
        self.code = "H" if np.dtype(dtype).itemsize == 2 else "I"
        self.by_words, self.plain = _by_words(self.tokenizer), _plain_words(self.tokenizer, MARKS)
        self.model, self.normalizer, self.splitter = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = self.by_words and self.normalizer is not None and self.splitter is not None

    def ids(self, text: bytes) -> bytes:
        """Ids of a text by the library's encode."""
        return self._packed(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        if self.plain and word.isalpha():
            return self._packed([t.id for t in self.model.tokenize(word.lower().decode())])
        text = word.decode("utf-8", "replace")
        if not self.parts or any(a in text for a in self.added):
            return self.ids(word)
        return self._packed([t.id for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)) for t in self.model.tokenize(piece)])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            letters = word.rstrip(_MARKS)
            ids = self[letters] + self[word[len(letters) :]] if self.plain and len(letters) < len(word) and letters.isalpha() else self._word(word)
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids

    def __call__(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.split())) if self.by_words else self.ids(text)

    def trim(self) -> None:
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(name: str, shared, dtype: str) -> Encoder:
    """The encoder of a vocabulary, kept by a Python worker from task to task."""
    if (name, dtype) not in _encoders:
        _encoders.clear()
        _encoders[name, dtype] = Encoder(shared.value, dtype)
    return _encoders[name, dtype]


def write_tokens(df: DataFrame, vocab_path: str, path: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, text_col: str = "text") -> None:
    """Encode the texts, append ``end_id`` to each, write token files under ``path`` in ascending doc_id order."""
    data = Path(vocab_path).read_bytes()
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"vocabulary of {len(data)} bytes; at most {MAX_VOCAB_BYTES} are broadcast")
    largest = max([end_id, *_tokenizer(data).get_vocab(True).values()])
    dtype = "<u2" if largest < 2**16 else "<u4"
    shared, name = df.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
    end = np.array([end_id], dtype).tobytes()

    def run(batches):
        encode = _encoder(name, shared, dtype)
        partition, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def file():
            doc_ids = pa.array([d for d, _ in held], pa.int64())
            x = [np.frombuffer(b, dtype) for _, b in held]
            starts = np.concatenate([[0], np.cumsum([len(v) for v in x])])
            content = to_file(np.concatenate(x), pc.fill_null(doc_ids, 0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), starts, partition, number)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

        for batch in slices(batches, "text", CHUNK_BYTES):
            encode.trim()
            for doc_id, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist(), strict=True):
                held.append((doc_id, encode(text) + end))
                size += len(held[-1][1]) // len(end)
                if size >= file_tokens:
                    yield file()
                    held, size, number = [], 0, number + 1
        if held:
            yield file()

    order = ["doc_id", "hash", "row"]
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    ordered = rows.repartitionByRange(max(1, -(-size // PARTITION_BYTES)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    files = ordered.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[TokenFile, np.ndarray, list]]:
    for batch in batches:
        for k in range(batch.num_rows):
            content = batch.column(0)[k].as_py()
            if content:
                f = TokenFile(content)
                yield f, f.ids(0, f.n_tokens), [None if z else d for d, z in zip(f.doc_ids.tolist(), f.null.tolist(), strict=True)]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (array<bigint>) of the token files under ``path``."""

    def run(batches):
        for f, ids, doc_ids in _documents(batches):
            lists = pa.ListArray.from_arrays(pa.array(f.starts.astype(np.int32)), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], ["doc_id", "ids"])

    return _files(spark, path).mapInArrow(run, "doc_id bigint, ids array<bigint>")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the token files under ``path``; start counts all ids before it."""

    def run(batches):
        for f, ids, doc_ids in _documents(batches):
            raw, at = memoryview(ids.astype("<u4").tobytes()), f.starts.tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, f.partition)), pa.array(np.full(n, f.number)), pa.array(doc_ids, pa.int64()), pa.array(f.starts[:-1]), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64()),
            ], ["partition", "number", "doc_id", "offset", "n_tokens", "ids_crc32"])

    docs = cut(_files(spark, path).mapInArrow(run, "partition bigint, number bigint, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"), "index")
    sizes = docs.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = sizes.withColumn("inside", before(Window.partitionBy("partition").orderBy("number")))
    parts = sizes.groupBy("partition").agg(F.sum("n").alias("n")).withColumn("first", before(Window.orderBy("partition"))).select("partition", "first")  # a row for each partition of files
    starts = within.join(parts, "partition").select("partition", "number", (F.col("first") + F.col("inside")).alias("first"))
    return docs.join(starts, ["partition", "number"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def digests(df: DataFrame, vocab_path: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from token files written for it (in the shared folder unless ``path`` is given)."""
    path = path or f"{scratch_dir(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(df, vocab_path, path, end_id)
    return read_index(df.sparkSession, path)

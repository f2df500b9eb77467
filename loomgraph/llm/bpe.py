"""Byte-level BPE by corpus-level merge replay.

The corpus is reduced to its distinct pieces (what stands between single spaces) with their counts. Those that
stand more than once, the most frequent ``SHARED_PIECES`` of them if there are more, make a table whose parts are replayed: an inverted index
holds the positions of all adjacent token pairs, filed under the rank of the token that the pair makes (pairs that make the
same token share its rank, and the leftmost goes first whichever pair it is). Ranks are applied in order to all their positions at
once; only the pairs left and right of a merge are looked up anew and filed under their new rank. (If a new pair has a lower
rank than the one just applied, it comes next, so each word sees exactly the order of the usual one-word-at-a-time algorithm.)

The table is broadcast, and texts are put together from it. A piece that is not in it, one that stands once in the corpus as a rule, is replayed
with the others of its chunk of texts.

Null and empty texts have no tokens and decode to no bytes. Very long texts are
encoded whole. Repeated rows and extra columns pass through. The vocabulary and the pattern are
parameters; the vocabulary is shipped to executors in one broadcast, after a check of its size. Cutting at spaces is right for the public
pattern; with any other one whole texts are split by it, and no table of pieces is made.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from hashlib import sha256
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ragged, slices

#: Largest vocabulary file that is broadcast.
MAX_VOCAB_BYTES = 64 << 20
#: Text bytes whose pre-tokens are replayed together.
CHUNK_BYTES = 2 << 20
#: Pieces of the shared table, and their bytes, at most.
SHARED_PIECES, SHARED_BYTES = 200_000, 8 << 20
_IDS = 1 << 18
#: White space on both sides of a space (any Unicode white space counts; too much does no harm).
_MEETS = r"[\pZ\x09-\x0d\x1c-\x1f\x{85}] [\pZ\x09-\x0d\x1c-\x1f\x{85}]"
_STOPS = (".", ",")
_NONE = np.int32(2**31 - 1)


class Ranks:
    """Vocabulary of a rank file (base64 token, rank), with all pairs that can merge."""

    def __init__(self, data: bytes):
        self.encoder = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        size = max(self.encoder.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.encoder.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.encoder[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        get = self.encoder.get
        for token, rank in self.encoder.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = np.array(values, np.int32)[order]
        self.token_lens = np.array([len(t) for t in self.tokens], np.int64)
        self.token_offsets = np.concatenate([[0], np.cumsum(self.token_lens)])
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)


@lru_cache(maxsize=2)
def _ranks(data: bytes) -> Ranks:
    return Ranks(data)


def _file(index: dict[int, list[np.ndarray]], heap: list[int], at: np.ndarray, ranks: np.ndarray) -> None:
    """Put positions into the inverted index under their ranks."""
    some = ranks != _NONE
    at, ranks = at[some], ranks[some]
    if not at.size:
        return
    order = np.argsort(ranks, kind="stable")
    at, ranks = at[order], ranks[order]
    edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    starts = [0, *edges.tolist()]
    for a, b, r in zip(starts, [*starts[1:], len(at)], ranks[starts].tolist(), strict=True):
        if r in index:
            index[r].append(at[a:b])
        else:
            index[r] = [at[a:b]]
            heapq.heappush(heap, r)


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of distinct pre-tokens: (all ids, offsets by word)."""
    n = len(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    flat = np.frombuffer(b"".join(words), np.uint8)
    size = len(flat)
    ends = np.cumsum(lens)
    starts = ends - lens
    tok = np.append(ranks.byte_ids[flat], np.int32(0))
    nxt = np.arange(1, size + 2, dtype=np.int32)
    prv = np.arange(-1, size, dtype=np.int32)
    some = lens > 0
    nxt[ends[some] - 1] = size
    prv[starts[some]] = -1
    alive = np.ones(size, bool)
    # a pre-token that is itself a token is taken whole
    whole = np.fromiter((ranks.encoder.get(w, -1) for w in words), np.int64, n)
    rank = np.full(size + 1, _NONE, np.int32)
    if size:
        is_whole = np.repeat(whole >= 0, lens)
        two = np.flatnonzero((nxt[:size] < size) & ~is_whole).astype(np.int32)
        rank[two] = ranks.rank_of(tok[two], tok[two + 1])
        alive[is_whole] = False
        first = starts[(whole >= 0) & some]
        alive[first] = True
        tok[first] = whole[(whole >= 0) & some]
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []
    here = np.flatnonzero(rank[:size] != _NONE).astype(np.int32)
    _file(index, heap, here, rank[here])
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if not at.size:
            continue
        follow = nxt[at]
        chained = follow[:-1] == at[1:]
        if chained.any():  # overlapping pairs, as in "aaa": every other one from the left
            k = np.arange(len(at))
            head = np.concatenate([[True], ~chained])
            keep = (k - np.maximum.accumulate(np.where(head, k, 0))) % 2 == 0
            at, follow = at[keep], follow[keep]
        after = nxt[follow]
        tok[at] = r
        nxt[at] = after
        inner = after < size
        prv[after[inner]] = at[inner]
        alive[follow] = False
        rank[follow] = _NONE
        rank[at] = _NONE
        before = prv[at]
        touched = np.unique(np.concatenate([at[inner], before[before >= 0]]))
        if touched.size:
            new = ranks.rank_of(tok[touched], tok[nxt[touched]])
            rank[touched] = new
            _file(index, heap, touched, new)
    counts = np.zeros(n, np.int64)
    if size:
        np.add.at(counts, np.repeat(np.arange(n), lens)[alive], 1)
    return tok[:size][alive], np.concatenate([[0], np.cumsum(counts)])


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, dict[int, str]]:
    """Pieces between single spaces of each text, their numbers, and the texts in which white space meets a space, which stay whole.

    A space always starts a new pre-token when a non-space precedes or follows it, so the pieces " word" can be split by the
    public pattern each on its own.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring_regex(texts, _MEETS))
    whole = {i: texts[i].as_py() for i in np.flatnonzero(np.asarray(odd)).tolist()}
    if whole:
        texts = pc.if_else(odd, "", texts)
    parts = pc.split_pattern(texts, " ")
    return parts, np.asarray(pc.list_value_length(parts)).astype(np.int64), whole


class Encoder:
    """Encodes texts chunk by chunk with the ids of shared pieces (piece, ids)."""

    def __init__(self, ranks: Ranks, pattern: str, shared: pa.Table | None = None):
        import regex

        self.ranks, self.search = ranks, regex.compile(pattern).finditer
        self.public = pattern == public_tokenizers.PATTERN
        self.known: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        if shared is not None and shared.num_rows:
            ids = shared["ids"].combine_chunks()
            self.known = {w: k for k, w in enumerate(shared["piece"].to_pylist())}
            self.ids = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype(np.int32)
            self.offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids)).astype(np.int64))])

    def find(self, text: str) -> list[str]:
        return [m[0] for m in self.search(text)]

    def split(self, piece: str) -> list[str]:
        """Pre-tokens of a piece that begins with a space; plain words need no pattern."""
        if piece[1:].isalpha():
            return [piece]
        if piece[-1] in _STOPS and piece[1:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.find(piece)

    def replayed(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of pre-tokens, all replayed together: (all ids, offsets by list)."""
        local: dict[str, int] = {}
        flat = [local.setdefault(w, len(local)) for words in lists for w in words]
        ids, offsets = replay([w.encode("utf-8", "surrogatepass") for w in local], self.ranks)
        values, lens = ragged(ids, offsets, np.array(flat, np.int64))
        sums = np.concatenate([[0], np.cumsum(lens)])
        return values, sums[np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined, and the number of ids of each text."""
        if not self.public:
            ids, offsets = self.replayed([self.find(t or "") for t in texts.to_pylist()])
            return ids, np.diff(offsets)
        parts, counts, whole = _cut(texts)
        coded = pc.list_flatten(parts).dictionary_encode()
        index = np.asarray(coded.indices).astype(np.int64)
        pieces = coded.dictionary.to_pylist()
        first = np.cumsum(counts) - counts  # the first piece of a text has no space before it
        known, fresh, lists = self.known, {}, []
        rows = np.empty(len(pieces), np.int64)
        base = len(self.offsets) - 1
        for k, w in enumerate(pieces):
            row = known.get(w)
            if row is None:
                row = base + len(lists)
                lists.append(self.split(" " + w))
            rows[k] = row
        rows = rows[index]
        for k, (i, at) in enumerate(zip(index[first].tolist(), first.tolist(), strict=True)):
            text = whole.get(k, pieces[i])
            row = fresh.get(text)
            if row is None:
                row = fresh[text] = base + len(lists)
                lists.append(self.find(text))
            rows[at] = row
        ids, offsets = self.replayed(lists)
        ids, offsets = np.concatenate([self.ids, ids]), np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        flat, lens = ragged(ids, offsets, rows)
        sums = np.concatenate([[0], np.cumsum(lens)])
        return flat, sums[first + counts] - sums[first]


def shared_pieces(df: DataFrame, vocab, pattern: str, text_col: str = "text") -> DataFrame | None:
    """piece, ids of the pieces of the corpus that stand more than once, the most frequent ones within the bounds; None for other patterns."""
    if pattern != public_tokenizers.PATTERN:
        return None

    def count(batches):
        for batch in slices(batches, text_col, CHUNK_BYTES):
            parts, counts, _ = _cut(batch.column(0))
            flat = pc.list_flatten(parts)
            later = np.ones(len(flat), bool)
            later[np.cumsum(counts) - counts] = False
            coded = flat.filter(pa.array(later)).dictionary_encode()
            n = np.bincount(np.asarray(coded.indices).astype(np.int64), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n)], ["piece", "n"])

    pieces = df.select(text_col).mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
    pieces = cut(pieces, "pieces")
    # counts of counts: the least count from which all pieces are within the bounds
    size = F.sum(F.octet_length("piece")).alias("bytes")
    least, held, taken = 2, 0, 0
    for r in sorted(pieces.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("pieces"), size).collect(), key=lambda r: -r.n):
        held, taken = held + r.pieces, taken + r.bytes
        if held > SHARED_PIECES or taken > SHARED_BYTES:
            least = r.n + 1
            break

    def merge(batches):
        encoder = Encoder(_ranks(vocab.value), pattern)
        for batch in slices(batches, "piece", CHUNK_BYTES):
            ids, offsets = encoder.replayed([encoder.split(" " + w) for w in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))], ["piece", "ids"])

    return cut(pieces.where(F.col("n") >= least).select("piece").mapInArrow(merge, "piece string, ids array<int>"), "merged")


def encode_texts(texts: list[str | None], ranks: Ranks, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts joined, and the number of ids of each text."""
    return Encoder(ranks, pattern).encode(pa.array(texts, pa.string()))


def _vocabulary(df: DataFrame, vocab_path: str):
    data = Path(vocab_path).read_bytes()
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"vocabulary of {len(data)} bytes; at most {MAX_VOCAB_BYTES} are broadcast")
    return df.sparkSession.sparkContext.broadcast(data)


def _shipped(df: DataFrame, vocab, pattern: str, text_col: str):
    """The table of shared pieces, bounded by ``SHARED_PIECES``, as a broadcast."""
    pieces = shared_pieces(df, vocab, pattern, text_col)
    return df.sparkSession.sparkContext.broadcast(None if pieces is None else pieces.toArrow())


def encode(df: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col`` array<int>: the token ids of ``text_col``; one row per input row.

    A column already called ``ids_col`` is replaced.
    """
    vocab = _vocabulary(df, vocab_path)
    df = df.drop(ids_col)
    shared = _shipped(df, vocab, pattern, text_col)

    def run(batches):
        encoder = Encoder(_ranks(vocab.value), pattern, shared.value)
        for batch in slices(batches, text_col, CHUNK_BYTES):
            ids, counts = encoder.encode(batch.column(batch.schema.get_field_index(text_col)))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col`` binary: the bytes of the ids; null ids give no bytes.

    Unknown and null ids raise, as in the usual libraries.
    """
    shared = _vocabulary(df, vocab_path)
    df = df.drop(out_col)

    def run(batches):
        ranks = _ranks(shared.value)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids_col))
            counts = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
            ids = pc.list_flatten(col).to_numpy(zero_copy_only=False)
            if ids.dtype.kind == "f" or ids.size and (ids.min() < 0 or ids.max() >= len(ranks.tokens)):
                raise ValueError("ids outside the vocabulary")
            flat, lens = ragged(ranks.token_bytes, ranks.token_offsets, ids.astype(np.int64))
            sums = np.concatenate([[0], np.cumsum(lens)])
            offsets = sums[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())]))


def _texts(ids: np.ndarray, counts: np.ndarray, values: np.ndarray, offsets: np.ndarray):
    """For each row of ids its joined ``values`` as bytes, made for a bounded number of ids at a time."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        first = int(ends[at] - counts[at])
        last = max(at + 1, int(np.searchsorted(ends, first + _IDS, "right")))
        flat, lens = ragged(values, offsets, ids[first : int(ends[last - 1])].astype(np.int64))
        sums = np.concatenate([[0], np.cumsum(lens)])
        cuts = sums[np.concatenate([[0], ends[at:last] - first])].tolist()
        data = flat.tobytes()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield data[a:b]
        at = last


def digests(df: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``documents``: encode, decode and digest in one pass."""
    vocab = _vocabulary(df, vocab_path)
    shared = _shipped(df, vocab, pattern, "text")

    def run(batches):
        ranks = _ranks(vocab.value)
        encoder = Encoder(ranks, pattern, shared.value)
        names = [b" %d" % k for k in range(len(ranks.tokens))]
        name_offsets = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        name_bytes = np.frombuffer(b"".join(names), np.uint8)
        for batch in slices(batches, "text", CHUNK_BYTES):
            ids, counts = encoder.encode(batch.column(1))
            written = [sha256(x[1:]).hexdigest() for x in _texts(ids, counts, name_bytes, name_offsets)]
            decoded = [sha256(x).hexdigest() for x in _texts(ids, counts, ranks.token_bytes, ranks.token_offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(written), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

"""Greedy longest-match token counts with a linear automaton.

The vocabulary is a trie over bytes. Where the trie has no way on, a failure link leads to
the node for what is left after taking greedy longest matches off the front of the
bytes read, and a precomputed number says how many pieces those matches are. So counting reads each
byte once, never goes back and never builds a piece.

A word is a maximal run outside U+0009 to U+000D and space, with one space before it (the
vocabulary's pieces begin words with a space). The vocabulary must hold every single byte and the
parts do not cross words. Null, empty and blank texts have no words. Very long texts are counted whole;
words seen before are looked up in a table of bounded size. Repeated rows and null doc_ids
are rows like others; extra columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices

MAX_VOCAB_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
#: Words whose counts are kept.
KEPT = 400_000


def read_vocabulary(data: bytes) -> list[bytes]:
    """Tokens of a rank file (base64 token, rank)."""
    return [base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()]


class Automaton:
    """Trie with failure links and popped-piece counts; node 0 is the root."""

    def __init__(self, vocabulary: list[bytes]):
        lacking = {bytes([b]) for b in range(256)} - set(vocabulary)
        if lacking:
            raise ValueError(f"{len(lacking)} single bytes are not in the vocabulary")
        self.child: list[dict[int, int]] = [{}]
        final = [False]
        parent, label = [0], [0]
        for token in vocabulary:
            node = 0
            for b in token:
                step = self.child[node].get(b)
                if step is None:
                    step = self.child[node][b] = len(self.child)
                    self.child.append({})
                    final.append(False)
                    parent.append(node)
                    label.append(b)
                node = step
            final[node] = bool(token)
        #: Node to go on from, and pieces taken off, when no child fits.
        self.fail, self.popped = [0] * len(self.child), [0] * len(self.child)
        level = list(self.child[0].values())
        while level:
            below = []
            for node in level:
                if final[node]:
                    self.fail[node], self.popped[node] = 0, 1
                else:
                    z, n, b = parent[node], 0, label[node]
                    n, z = n + self.popped[z], self.fail[z]
                    while b not in self.child[z]:
                        n, z = n + self.popped[z], self.fail[z]
                    self.fail[node], self.popped[node] = self.child[z][b], n
                below.extend(self.child[node].values())
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split of ``word``."""
        child, fail, popped = self.child, self.fail, self.popped
        node = n = 0
        for b in word:
            step = child[node].get(b)
            while step is None:
                n += popped[node]
                node = fail[node]
                step = child[node].get(b)
            node = step
        while node:
            n += popped[node]
            node = fail[node]
        return n


@lru_cache(maxsize=2)
def _automaton(data: bytes) -> Automaton:
    return Automaton(read_vocabulary(data))


class Counts(dict):
    """word -> number of pieces, with the space before it."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.count(b" " + word)
        return n


def token_counts(df: DataFrame, vocab_path: str, text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens (long): one row per row of ``df``."""
    data = Path(vocab_path).read_bytes()
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"vocabulary of {len(data)} bytes; at most {MAX_VOCAB_BYTES} are broadcast")
    shared = df.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        counts = Counts(_automaton(shared.value))
        for batch in slices(batches, text_col, CHUNK_BYTES):
            if len(counts) > KEPT:
                counts.clear()
            words, tokens = [], []
            for text in pc.cast(batch.column(1), pa.binary()).to_pylist():
                w = text.split() if text else []
                words.append(len(w))
                tokens.append(sum(map(counts.__getitem__, w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))], ["doc_id", "n_words", "n_tokens"])

    return df.select("doc_id", text_col).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")

"""Operator 8: token counts by a linear longest-match automaton.

Greedy longest-match word pieces are counted without building a piece. The vocabulary is a trie over
bytes. Every node has a failure link (where matching goes on once the longest piece that the node's
string begins with, and those after it, are popped) and the number of pieces popped on the way, both
computed once. A word is read byte by byte: a missing edge follows failure links and adds their
counts, so reading is linear in the word's length.

A word is a run of non-blank characters, read with one space before it, as byte-level vocabularies
mark the start of a word; pieces are matched from the left, the longest first, and a word that has no
such cover is one unknown token. White space itself gives no tokens. Equal words are read once per
batch and kept in a bounded table per task.

The vocabulary is a file of a public tokenizer (base64 piece and rank per line); its path is a
parameter. Only its pieces are used, not its merges. The automaton is built on the driver (its size
is that of the vocabulary) and sent to each task.

Rows: null and empty texts have 0 words and tokens; texts of any length are read whole; repeated rows
are counted each on its own. Other columns are untouched unless they have the name of a result.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.words import SPACED, pieces, small_batches, words_of

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
KEPT = 1 << 19


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """The automaton; `next` maps node * 256 + byte to a node, node 0 is the root."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: dict[int, int] = {}
        ends = [False]
        for piece in vocabulary:
            if not piece:
                continue
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.next:
                    self.next[key] = len(ends)
                    ends.append(False)
                node = self.next[key]
            ends[node] = True
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        children: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, child in self.next.items():
            children[key >> 8].append((key & 255, child))
        todo = deque([0])
        while todo:
            node = todo.popleft()
            for byte, child in children[node]:
                todo.append(child)
                if ends[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                at, count = self.fail[node], self.popped[node]
                while at >= 0 and (at << 8 | byte) not in self.next:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.next[at << 8 | byte], count

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match cover; 1 if there is none."""
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for byte in word:
            while True:
                to = step.get(node << 8 | byte)
                if to is not None:
                    node = to
                    break
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
        while node:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def _count(automaton):
    def run(batches):
        read = automaton.value.count
        known = np.zeros(0, np.uint64)
        counts = np.zeros(0, np.int64)
        for batch in pieces(batches, "text__", 4 << 20):
            words = words_of(batch["text__"], SPACED, exact=True)
            own, first, at = np.unique(words.hashes, return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            old = known[place] == own if len(known) else np.zeros(len(own), bool)
            value = np.zeros(len(own), np.int64)
            value[old] = counts[place[old]]
            fresh = np.flatnonzero(~old)
            raw = words.raw.tobytes()
            value[fresh] = [read(b" " + raw[words.start[k]:words.end[k]]) for k in first[fresh].tolist()]
            if len(known) + len(fresh) > KEPT:
                known, counts = own, value
            else:
                known, counts = np.concatenate((known, own[fresh])), np.concatenate((counts, value[fresh]))
                order = np.argsort(known)
                known, counts = known[order], counts[order]
            sums = np.concatenate(([0], np.cumsum(value[at])))
            total = sums[words.first[1:]] - sums[words.first[:-1]]
            new = {"n_words": pa.array(np.diff(words.first), pa.int64()), "n_tokens": pa.array(total, pa.int64())}
            yield pa.RecordBatch.from_arrays([batch[c] for c in batch.schema.names if c != "text__"] + list(new.values()), names=[c for c in batch.schema.names if c != "text__"] + list(new))

    return run


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` without the text column, with n_words and n_tokens."""
    small_batches(docs.sparkSession)
    automaton = docs.sparkSession.sparkContext.broadcast(LongestMatch(read_vocabulary(vocabulary)))
    kept = docs.select(*[c for c in docs.columns if c not in ("n_words", "n_tokens", text_col)], F.col(text_col).cast("string").alias("text__"))
    zero = F.lit(0).cast("bigint")
    schema = kept.drop("text__").withColumns({"n_words": zero, "n_tokens": zero}).schema
    return kept.mapInArrow(_count(automaton), schema)

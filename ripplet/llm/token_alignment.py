"""Operator 13: alignment of two tokenizers' tokens over whitespace anchors.

Contract: A is a byte-level BPE of " " + text, B a SentencePiece model of text, which adds the space itself;
special tokens are plain text. Where tokens of both end at one byte, the text is cut into groups. A and B
tokens whose bytes overlap are linked. An id pair's count is the number of documents that hold it linked.

1. Whole texts are tokenised first. The bytes of the tokens are joined and compared with the text; where
   either differs (or the text is null or empty) the document has no tokens.
2. Ends of tokens of either are stops. What lies between two stops belongs to one token of each, and is one
   link; stops of both end a group. So groups and links are worked out by sorting and searching ends, with
   arrays, in linear memory for texts of any length.
3. A document's distinct pairs, with how often each is linked, are written with its digests. Counts of
   pairs are one partial aggregate over them.
4. Counts come back to the documents: the `common` most frequent pairs as a table in each task (a stated
   bound: 17 bytes a pair), all others, if there are any, by a join on the pair. Which are which affects
   speed only; hot pairs never meet in one task.

A text that has only characters whose classes no Unicode version disputes (those below U+0250 less controls
and odd blanks) is tokenised by chunks: it is cut before each space that follows no white space, the anchors.
No token of either tokenizer crosses such a place (A's pre-tokens end there, no piece of B has a space behind
another character, and B does not rewrite text), so tokens of the chunks are those of the text, and each
anchor ends a group. Distinct new chunks of a batch are tokenised behind each other, verified and cut
together; what they give is remembered by arrays under the chunk (bounded: a worker keeps up to `REMEMBERED`
between batches, and forgets the less used half beyond it; chunks over `LONG` are not kept). Whether no token
crosses is looked up in the models, and each anchor is compared with the ends of both. If the bytes of a
chunk's tokens are not the chunk's, and for all other texts, the text is tokenised whole.

Rows: a document is a row, so repeated rows count each. Ids may be null or repeat. Texts of any length stay
whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.names import by_place, place
from ripplet.llm.words import pieces, small_batches
from ripplet.session import checkpoint_dir, cut_lineage

FOLDER = "/opt/tokenizers"
LONG = 64            # characters of the longest chunk that is remembered
REMEMBERED = 1 << 19  # chunks that a worker remembers
TOGETHER = 1 << 14   # characters of new chunks that are tokenised together
COMMON = 1 << 18     # pairs whose counts every task holds: 4.5 MB
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

# The bytes that stand for themselves in a byte-level vocabulary.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-ɏ]*")
_CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")  # up to the next space that follows no white space


def byte_of_character() -> dict[str, int]:
    """Bytes that are not printed are named by the characters from U+0100 on, in order."""
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def read_models(byte_bpe: str, pieces_model: str) -> tuple[bytes, bytes]:
    """The vocabulary files, read on the driver; about 2 MB go to the workers."""
    with open(byte_bpe, "rb") as a, open(pieces_model, "rb") as b:
        return a.read(), b.read()


class Tokenizers:
    """Both tokenizers with the bytes of each token."""

    def __init__(self, byte_bpe: bytes, pieces_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces_model)
        byte = byte_of_character()
        vocabulary = json.loads(byte_bpe)["model"]["vocab"]
        self.bytes_a = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        settings = json.loads(byte_bpe)
        by_words = settings["normalizer"] is None and settings["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.local = by_words and not any(b" " in t.lstrip(b" ") for t in self.bytes_b)  # no token crosses the end of a chunk

    def _piece(self, k: int) -> bytes:
        if self.b.is_byte(k):
            return bytes([int(self.b.id_to_piece(k)[1:-1], 16)])
        return self.b.id_to_piece(k).replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and B of each text; none where their bytes are not the text's."""
        spaced = [" " + t for t in texts]
        for text, space, found, b in zip(texts, spaced, self.a.encode_batch_fast(spaced, add_special_tokens=False), self.b.encode(texts, num_threads=1)):
            a, raw = found.ids, space.encode()
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            yield (a, b) if same else ([], [])


class Found(NamedTuple):
    """What pieces of text give: numbers of ids of A, of B, of groups and of links (4 rows), groups as text with `;` behind each, and the links of all pieces one after the other."""

    numbers: np.ndarray
    groups: list[str]
    links: np.ndarray


class Aligner:
    """Groups and links of tokens from where they end, by arrays."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.size_a, self.size_b = (np.array([len(t) for t in tokens]) for tokens in (tokenizers.bytes_a, tokenizers.bytes_b))
        self.written = [f"{k}{mark}" for tokens, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for k in range(len(tokens)) for mark in marks]
        self.width = np.array([len(w) for w in self.written])

    def cut(self, a: list[int], b: list[int], ends: np.ndarray) -> Found | None:
        """The pieces that end at these bytes; None if a token crosses one of the ends."""
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = self.size_a[ids_a].cumsum(), self.size_b[ids_b].cumsum()
        stops = np.sort(np.concatenate((ends_a, ends_b)))  # between two stops lies what one token of A and one of B have in common
        stops = stops[np.diff(stops, prepend=-1) > 0]
        in_a, in_b = np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops)
        shared = (ends_a[in_a] == stops) & (ends_b[in_b] == stops)
        at = np.searchsorted(stops, ends)
        if not (shared[at] & (stops[at] == ends)).all():
            return None
        upto = np.stack((in_a[at] + 1, in_b[at] + 1, shared.cumsum()[at], at + 1))
        last_a, last_b = in_a[shared], in_b[shared]  # of each group
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        order = np.empty(len(a) + len(b), np.int64)  # of all ids, a group's of A before its of B
        ids_a_marked, ids_b_marked = 2 * ids_a, 2 * (len(self.size_a) + ids_b)
        ids_a_marked[last_a] += 1
        ids_b_marked[last_b] += 1
        order[np.arange(len(a)) + np.repeat(last_b + 1 - n_b, n_a)] = ids_a_marked
        order[np.arange(len(b)) + np.repeat(last_a + 1, n_b)] = ids_b_marked
        text = "".join(map(self.written.__getitem__, order.tolist()))
        high = self.width[order].cumsum()[upto[0] + upto[1] - 1].tolist()
        groups = [text[i:j] for i, j in zip([0, *high], high)]
        return Found(np.diff(upto, axis=1, prepend=0), groups, ids_a[in_a] * len(self.size_b) + ids_b[in_b])

    def whole(self, text: str) -> Found:
        """A text as one piece; zeros if it has no tokens."""
        (a, b), = self.tokenizers.encode([text])
        return self.cut(a, b, np.array([len(text.encode()) + 1])) if a else Found(np.zeros((4, 1), np.int64), [""], np.zeros(0, np.int64))

    def chunks(self, chunks: list[str]) -> Iterator[Found]:
        """Chunks (each without its space) in order, many tokenised behind each other; where that fails, each alone."""
        for together in _packed(chunks):
            text = " ".join(together)
            (a, b), = self.tokenizers.encode([text])  # both add the first space
            sizes = map(len, together if text.isascii() else [c.encode() for c in together])
            found = self.cut(a, b, (np.fromiter(sizes, np.int64, len(together)) + 1).cumsum()) if a else None
            if found is None:
                yield from map(self.whole, together)
            else:
                yield found


def _packed(chunks: list[str]) -> Iterator[list[str]]:
    """Some chunks at a time; what ends in blanks ends a text and stays alone, as before another chunk its blanks could be other tokens."""
    some, size = [], 0
    for chunk in chunks:
        alone = not chunk or chunk[-1].isspace()
        if some and (alone or size > TOGETHER):
            yield some
            some, size = [], 0
        if alone:
            yield [chunk]
        else:
            some.append(chunk)
            size += len(chunk) + 1
    if some:
        yield some


def chunks_of(text: str) -> list[str]:
    """A text cut before each space that follows no white space; the space at the head of each chunk is left out."""
    if text[0] != " " and not any(blanks in text for blanks in ("  ", "\n ", "\t ", "\r ")):
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(" " + text)]


class Chunks:
    """Chunks of plain texts, numbered and remembered with what they give.

    Once more than `size` are known, the less used half is forgotten. Which are known affects speed only.
    """

    def __init__(self, tokenizers: Tokenizers, size: int = REMEMBERED):
        self.aligner, self.size = Aligner(tokenizers), size
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers, self.uses = np.zeros((4, 0), np.int32), np.zeros(0, np.int32)
        self.starts, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _add(self, found: list[Found]) -> None:
        if not found:
            return
        numbers = np.concatenate([f.numbers for f in found], axis=1)
        self.numbers = np.concatenate((self.numbers, numbers.astype(np.int32)), axis=1)
        self.groups += chain.from_iterable(f.groups for f in found)
        self.starts = np.concatenate((self.starts, self.starts[-1] + numbers[3].cumsum()))
        self.links = np.concatenate((self.links, *(f.links for f in found)))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' chunks in order, and how many each text has; a text that is not plain is one, one without tokens none.

        They hold until the next call; `forget` is to follow.
        """
        cut = [chunks_of(t) if t and self.aligner.tokenizers.local and _PLAIN.fullmatch(t) else [] for t in texts]
        new = list(dict.fromkeys([chunk for chunk in chain.from_iterable(cut) if chunk not in self.known]))
        short, long = [c for c in new if len(c) <= LONG], [c for c in new if len(c) > LONG]
        # in the order in which they are tokenised, so each keeps its place
        self.known.update(zip(short, range(len(self.known), len(self.known) + len(short))))
        self._add(list(self.aligner.chunks(short)))
        beside = dict(zip(long, range(len(self.known), len(self.known) + len(long))))
        self._add(list(self.aligner.chunks(long)))
        numbered = [list(map(self.known.get, chunks)) for chunks in cut]
        if beside:
            numbered = [[beside[c] if k is None else k for k, c in zip(own, chunks)] for own, chunks in zip(numbered, cut)]
        count = np.array([len(own) for own in numbered], np.int64)
        places = np.fromiter(chain.from_iterable(numbered), np.int64, int(count.sum()))
        bad = np.zeros(len(texts), bool)
        bad[np.repeat(np.arange(len(texts)), count)[self.numbers[0, places] == 0]] = True
        whole = np.flatnonzero(bad | (count == 0)).tolist()
        for k in whole:
            found = self.aligner.whole(texts[k])
            numbered[k] = [len(self.groups)] if found.numbers[0, 0] else []
            if numbered[k]:
                self._add([found])
        if whole:
            count = np.array([len(own) for own in numbered], np.int64)
            places = np.fromiter(chain.from_iterable(numbered), np.int64, int(count.sum()))
        return places, count

    def links_of(self, places: np.ndarray) -> np.ndarray:
        """The links of these chunks one after the other."""
        often = self.numbers[3, places].astype(np.int64)
        return self.links[np.repeat(self.starts[places] - often.cumsum() + often, often) + np.arange(often.sum())]

    def forget(self, places: np.ndarray) -> None:
        """Drop what is not remembered: long chunks, whole texts, and the less used half if there are too many."""
        n = len(self.known)
        self.uses = np.concatenate((self.uses, np.zeros(n - len(self.uses), np.int32)))
        self.uses += np.bincount(places[places < n], minlength=n).astype(np.int32)
        if n > self.size:
            keep = np.sort(np.argpartition(-self.uses, self.size // 2)[:self.size // 2])
            chunks = list(self.known)
            self.known = {chunks[k]: i for i, k in enumerate(keep.tolist())}
            self.links = self.links_of(keep)
            self.groups = [self.groups[k] for k in keep.tolist()]
            self.numbers, self.uses = self.numbers[:, keep], self.uses[keep] // 2
            self.starts = np.concatenate(([0], self.numbers[3].cumsum(dtype=np.int64)))
        elif len(self.groups) > n:
            del self.groups[n:]
            self.numbers, self.starts, self.links = self.numbers[:, :n].copy(), self.starts[:n + 1].copy(), self.links[:self.starts[n]].copy()


_PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())]))
_ALIGNED = pa.schema([
    ("row", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups", pa.string()), ("groups_sha256", pa.string()), ("pairs", _PAIRS),
])
_ALIGNED_SQL = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<struct<a: int, b: int, times: int>>"
_WORKER: dict[int, Chunks] = {}


def _worker(models) -> Chunks:
    """Tokenizers of this Python worker and what it remembers, kept while it lives."""
    key = hash(models)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Chunks(Tokenizers(*models))
    return _WORKER[key]


def _listed(a: np.ndarray, b: np.ndarray, often: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pairs as a list for each row; `ends` has where each row's begin, and the end."""
    entries = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in (a, b, often)], fields=list(_PAIRS.value_type))
    return pa.ListArray.from_arrays(ends.astype(np.int32), entries)


def _pairs(links: np.ndarray, count: np.ndarray, ids_a: int, ids_b: int) -> pa.Array:
    """Distinct links of each row and how often each comes; `count` is how many links a row has."""
    code, often = np.unique(np.repeat(np.arange(len(count)), count) * (ids_a * ids_b) + links, return_counts=True)
    own, link = np.divmod(code, ids_a * ids_b)
    return _listed(*np.divmod(link, ids_b), often, np.searchsorted(own, np.arange(len(count) + 1)))


def aligned_documents(models, keep_groups: bool):
    """Per document its digests and distinct linked pairs; `row` numbers the rows of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _worker(models.value)
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "text"):
            places, count = chunks.of([t or "" for t in batch.column(1).to_pylist()])
            ends = np.concatenate(([0], count.cumsum()))
            written = list(map(chunks.groups.__getitem__, places.tolist()))
            groups = ["".join(written[i:j])[:-1] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            sums = [np.diff(np.concatenate(([0], n[places].cumsum(dtype=np.int64)))[ends]) for n in chunks.numbers]
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            pairs = _pairs(chunks.links_of(places), sums[3], len(chunks.aligner.size_a), len(chunks.aligner.size_b))
            chunks.forget(places)
            n = batch.num_rows
            columns = [np.arange(row, row + n), batch.column(0), *sums, groups if keep_groups else pa.nulls(n, pa.string()), digests]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _ALIGNED)] + [pairs], schema=_ALIGNED)
            row += n

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, docs, best): how many documents hold a linked pair, and whether that is the most of all pairs of `a`."""
    counts = cut_lineage(aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.count("*").alias("docs")))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each id of A: bounded by the vocabulary
    return counts.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _looked_up(common):
    """Add up the common pairs of each document; the others are handed on, as are all columns but the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = common.value
        for batch in batches:
            pairs = batch.column(batch.num_columns - 1)
            count = pairs.value_lengths().fill_null(0).to_numpy()
            a, b, often = (c.to_numpy().astype(np.int64) for c in pairs.flatten().flatten())
            code, owner = a << 32 | b, np.repeat(np.arange(len(count)), count)
            at = np.minimum(np.searchsorted(keys, code), max(len(keys) - 1, 0))
            known = keys[at] == code if len(keys) else np.zeros(len(code), bool)
            sums = np.zeros((2, len(count)), np.int64)
            if known.any():
                np.add.at(sums[0], owner[known], (often * best[at])[known])
                np.add.at(sums[1], owner[known], (often * docs[at])[known])
            rest = _listed(a[~known], b[~known], often[~known], np.searchsorted(owner[~known], np.arange(len(count) + 1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sums[0]), pa.array(sums[1]), rest],
                names=[*batch.schema.names[:-1], "n_best", "count_sum", "rest"],
            )

    return run, _ALIGNED_SQL.replace("pairs ", "n_best long, count_sum long, rest ")


def align_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = f"{FOLDER}/byte_bpe_50k.json",
    pieces_model: str = f"{FOLDER}/piece_bpe_32k.model", keep_groups: bool = True, common: int = COMMON,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and `groups` as text if asked for, for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = docs.columns
    texts = by_place(docs).select(F.col(f"c{place(columns, id_col)}").cast("long").alias("id"), F.col(f"c{place(columns, text_col)}").cast("string").alias("text"))
    models = spark.sparkContext.broadcast(read_models(byte_bpe, pieces_model))
    path = os.path.join(checkpoint_dir(spark), f"aligned-{uuid.uuid4().hex}")
    texts.mapInArrow(aligned_documents(models, keep_groups), _ALIGNED_SQL).write.parquet(path)
    aligned = spark.read.schema(_ALIGNED_SQL).parquet(path)

    counts = cut_lineage(pair_counts(aligned))
    most = counts.orderBy(F.desc("docs"), "a", "b").limit(common).toArrow()
    code = most["a"].to_numpy().astype(np.int64) << 32 | most["b"].to_numpy().astype(np.int64)
    order = np.argsort(code)
    held = spark.sparkContext.broadcast((code[order], most["docs"].to_numpy()[order], most["best"].to_numpy(zero_copy_only=False)[order]))
    run, schema = _looked_up(held)
    sums = aligned.mapInArrow(run, schema)
    total = lambda name, more=F.lit(0): (F.col(name) + F.coalesce(more, F.lit(0))).cast("long").alias(name)
    kept = [F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links"]
    digests = ["groups_sha256", *(["groups"] if keep_groups else [])]
    if most.num_rows < common:  # the table holds all pairs
        return sums.select(*kept, total("n_best"), total("count_sum"), *digests)
    rest = aligned.select(*[F.col("row") if c == "row" else F.lit(None).cast(aligned.schema[c].dataType).alias(c) for c in aligned.columns[:-1]], "pairs")
    rest = rest.mapInArrow(run, schema).select("row", F.inline("rest")).join(counts, ["a", "b"])
    more = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
    more.write.parquet(path + "-rest")
    more = spark.read.schema(more.schema).parquet(path + "-rest")  # Spark knows its size: mostly little, and then no row is moved for it
    return sums.join(more, "row", "left").select(*kept, total("n_best", F.col("more_best")), total("count_sum", F.col("more_sum")), *digests)

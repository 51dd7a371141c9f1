"""Words of whole texts as hash arrays, straight from Arrow's UTF-8 buffers.

A word is a maximal run of word bytes; every byte of a non-ASCII character is one, so runs of
bytes are runs of characters. Word hashes are 64-bit polynomials over ASCII-lowered bytes. Texts
are handled in pieces of about a megabyte cut between words, so that memory follows the batch, not
some multiple of its longest text. Null texts are empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

PIECE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_ORDER = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def byte_class(pattern: str) -> np.ndarray:
    """A table of the bytes whose ASCII-lowered characters match `pattern`; bytes from 0x80 always do."""
    one = re.compile(pattern)
    return np.array([b >= 0x80 or one.fullmatch(chr(_LOWER[b])) is not None for b in range(256)])


SPACED = byte_class(r"[^\x20\x09-\x0D]")
ALPHANUMERIC = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b, np.uint64)))) for b in (_BASE, inverse))


@dataclass(frozen=True)
class Words:
    """Words of some texts: those of text i are first[i] to first[i + 1]; start and end are byte places in `raw`."""

    raw: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i]:self.first[i + 1]]

    def word(self, k: int) -> bytes:
        return _LOWER[self.raw[self.start[k]:self.end[k]]].tobytes()


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_string()).fill_null("") if len(texts) else pa.array([], pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[places[0]:places[-1]], places - places[0]


def words_of(texts: pa.Array, table: np.ndarray, exact: bool = False) -> Words:
    """The words of each text; with `exact` their hashes tell upper from lower case."""
    raw, offsets = raw_bytes(texts)
    total = len(raw)
    inside = table[raw]
    begins = np.zeros(total + 1, bool)
    begins[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if total else inside
    opens = inside & (begins[:-1] | ~before)
    after = np.concatenate((inside[1:], [False])) if total else inside
    closes = inside & (begins[1:] | ~after)
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        stop = max(int(np.searchsorted(start, start[k] + PIECE)), k + 1)
        low, high = int(start[k]), int(end[stop - 1])
        up, down = _powers(1 << max(20, (high - low).bit_length()))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[raw[low:high] if exact else _LOWER[raw[low:high]]] * up[:high - low], out=sums[1:])
        hashes[k:stop] = mix((sums[end[k:stop] - low] - sums[start[k:stop] - low]) * down[start[k:stop] - low])
        k = stop
    return Words(raw, offsets, hashes, start, end, np.searchsorted(start, offsets).astype(np.int64))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` consecutive words (none if there are fewer); order counts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        total += hashes[k:k + n] * _ORDER[k % 64] + np.uint64(k // 64)
    return mix(total)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct word n-grams; a shorter text is one gram, an empty one has none."""
    if not len(hashes):
        return hashes
    return np.unique(gram_hashes(hashes, min(size, len(hashes))))


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Let Spark hand texts to Python in batches of at most `limit` bytes (a longer text stays alone).

    Its own bound of 64 MB is held several times over, in the JVM and in each worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    current = re.fullmatch(r"(\d+)b?", spark.conf.get(key, None) or "")
    if current is None or int(current[1]) > limit:
        spark.conf.set(key, f"{limit}b")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `limit` bytes (a longer text stays alone)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows and texts.nbytes <= limit:
            yield batch
            continue
        _, offsets = raw_bytes(texts)
        k = 0
        while k < batch.num_rows:
            stop = max(int(np.searchsorted(offsets, offsets[k] + limit, side="right")) - 1, k + 1)
            yield batch.slice(k, stop - k)
            k = stop

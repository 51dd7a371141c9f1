"""Operator 5: secret scans by sliding-window Shannon entropy per character class.

Base spans come from three patterns over the whole text (assign, access, hex), leftmost and not
overlapping within a kind; matches that are too short are dropped. The method adds spans of kind
"entropy": in every candidate string (a run of [A-Za-z0-9+/_.=-] of `window` characters or more) each
maximal run of one character class is walked by a window whose entropy is kept up by incremental
counts, one character in and one out. Windows at or over the class's threshold are united. The
classes are hexadecimal digits of one case and the base64 alphabet; runs of letters or of digits alone
are inside base64 and allowed as plain words and numbers. Allow rules suppress what is no secret: by
the whole candidate string addresses and file names, by the stretch plain words and identifiers (hardly
any digit, or one case only), plain numbers, and ascending or repeated sequences. An entropy span
inside a base span is not reported again.

Texts that hold no key word, no "AKIA" and no long run are recognised on the byte arrays of a whole
batch, so the patterns run on few texts. Places are code points, ends exclusive.

Rows: a null text is empty; it has no spans, and its base digest is that of the empty string. Rows
with repeated ids are scanned each on its own. Other columns are untouched unless they have the name
of a result (in any case), which replaces them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.names import by_place, place, with_results
from ripplet.llm.words import pieces, raw_bytes, small_batches

# Fixed patterns of the contract.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "entropy"]
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

_CANDIDATE = np.isin(np.arange(256), [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Character classes with the entropy (bits a character) that a window of 20 random characters reaches nearly always.
CLASSES = [("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 2.75), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7)]
WINDOW = 20
_SHARE = [0.0] + [k * float(np.log2(k)) for k in range(1, 4096)]


def window_entropies(text: str, window: int):
    """(start, bits a character) of every window, from counts changed by one character in and one out."""
    counts: dict[str, int] = {}
    total = 0.0
    for k, char in enumerate(text):
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += _SHARE[n + 1] - _SHARE[n]
        if k >= window:
            old = text[k - window]
            n = counts[old]
            counts[old] = n - 1
            total += _SHARE[n - 1] - _SHARE[n]
        if k >= window - 1:
            yield k - window + 1, float(np.log2(window)) - total / window


# Endings by which a candidate string is the name of a file.
_FILE = re.compile(r"\.(?:html?|php|jsp?|css|png|jpe?g|gif|svg|webp|ico|pdf|txt|md|py|json|xml|csv|zip|gz|mp[34])\.*\Z", re.IGNORECASE)
_HOST = re.compile(r"(?:www\.|[a-z0-9.-]+\.(?:com|org|net|edu|gov|io)(?:/|\Z))", re.IGNORECASE)


def named(candidate: str, before: str) -> bool:
    """Whether a candidate string is an address or a file, going by it all and by what stands before it."""
    if before.endswith(("@", ":")) and (candidate.startswith("//") or before.endswith("@")):
        return True
    return _HOST.match(candidate) is not None or _FILE.search(candidate) is not None


def allowed(token: str) -> bool:
    """Whether a high-entropy stretch is no secret."""
    digits = sum(c.isdigit() for c in token)
    letters = [c for c in token if c.isalpha()]
    if not letters or digits < 2:
        return True
    if re.search(r"[A-Za-z]{12,}", token) and digits < 4 and (token.islower() or token.isupper()):
        return True
    steps = [ord(b) - ord(a) for a, b in zip(token, token[1:])]
    return max(steps.count(s) for s in (-1, 0, 1)) * 2 > len(steps)


def entropy_spans(text: str, start: int, end: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans within the candidate string text[start:end]."""
    found: list[tuple[int, int]] = []
    if named(text[start:end], text[max(start - 1, 0):start]):
        return found
    for _, members, least in CLASSES:
        for run in members.finditer(text, start, end):
            if run.end() - run.start() < window:
                continue
            spans: list[list[int]] = []
            for at, bits in window_entropies(run[0], window):
                if bits >= least:
                    a, b = run.start() + at, run.start() + at + window
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
            found += [(a, b) for a, b in spans if not allowed(text[a:b])]
    found.sort()
    merged: list[tuple[int, int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % WINDOW)


def all_spans(text: str) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    found = list(base)
    for run in _RUN.finditer(text):
        for a, b in entropy_spans(text, run.start(), run.end()):
            if not any(x <= a and b <= y for _, x, y in base):
                found.append(("entropy", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def may_hold(texts: pa.Array) -> np.ndarray:
    """Which texts have a key word or a long candidate run; only those can have spans."""
    raw, offsets = raw_bytes(texts)
    may = np.zeros(len(offsets) - 1, bool)
    inside = np.concatenate(([0], _CANDIDATE[raw].view(np.int8), [0]))
    edge = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    places = [edge[edge[:, 1] - edge[:, 0] >= WINDOW, 0]]  # a run may go on into the next text: mark all that it reaches
    last = [edge[edge[:, 1] - edge[:, 0] >= WINDOW, 1] - 1]
    low = _LOWER[raw].tobytes()
    for word in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"):
        at = low.find(word)
        while at >= 0:
            places.append(np.array([at]))
            last.append(np.array([at]))
            at = low.find(word, at + len(word))
    first = np.searchsorted(offsets, np.concatenate(places), side="right") - 1
    final = np.searchsorted(offsets, np.concatenate(last), side="right") - 1
    change = np.zeros(len(may) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, final + 1, -1)
    return np.cumsum(change)[:-1] > 0


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    parts, at = [], 0
    for _, a, b in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:]


def _scan(column: str, redact: bool, mark: str):
    def run(batches):
        for batch in pieces(batches, column):
            texts = batch[column]
            may = may_hold(texts)
            n, spans, digest, clean = np.zeros((3, len(may)), np.int64), [""] * len(may), [hashlib.sha256(b"").hexdigest()] * len(may), {}
            for i in np.flatnonzero(may).tolist():
                text = texts[i].as_py()
                found = all_spans(text)
                if not found:
                    continue
                spans[i] = joined(found)
                base = [s for s in found if s[0] != "entropy"]
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                for k in range(3):
                    n[k, i] = sum(s[0] == KINDS[k] for s in base)
                clean[i] = redacted(text, found, mark)
            new = {"n_assign": pa.array(n[0]), "n_access": pa.array(n[1]), "n_hex": pa.array(n[2]), "base_sha256": pa.array(digest), "spans": pa.array(spans)}
            if redact:
                whole = pa.array([clean[i] for i in sorted(clean)], pa.string())
                take = np.full(len(may), -1, np.int64)
                take[sorted(clean)] = np.arange(len(clean))
                found_rows = pa.array(take >= 0)
                picked = whole.take(pa.array(np.maximum(take, 0), mask=take < 0))
                new[column] = pa.compute.if_else(found_rows, picked, texts.cast(pa.string()))
            names = list(dict.fromkeys([*batch.schema.names, *new]))
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch[c] for c in names], names=names)

    return run


RESULTS = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def scan_secrets(docs: DataFrame, text_col: str = "text", redact: bool = False, mark: str = "[secret]") -> DataFrame:
    """`docs` with n_assign, n_access, n_hex, base_sha256 and spans; with `redact` the text has `mark` for every span."""
    small_batches(docs.sparkSession)
    text = f"c{place(docs.columns, text_col)}"
    rows = by_place(docs).withColumn(text, F.col(text).cast("string"))
    zero, empty = F.lit(0).cast("bigint"), F.lit("")
    schema = rows.withColumn(text, F.lit(None).cast("string")).withColumns({"n_assign": zero, "n_access": zero, "n_hex": zero, "base_sha256": empty, "spans": empty}).schema
    return with_results(rows.mapInArrow(_scan(text, redact, mark), schema), docs.columns, RESULTS)

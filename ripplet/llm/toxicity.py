"""Operator 3: toxicity by noisy-channel deobfuscation.

A character model (trigrams over the bytes of all words of the whole corpus) and a channel that
says how a letter may have been written (leetspeak, repeated, or with separators between letters)
give each suspicious token a lattice of readings; Viterbi picks the cheapest. Plain words and
restored readings together are looked up in a lexicon of words whose document log-odds for label 1
were learned from the training rows, and a logistic function of their number and weights is the
score.

1. Every task counts trigrams of its words; the sums are at most 64^3 rows.
2. The lexicon is counted over the words of at most `most_labelled` training documents (those with
   the smallest hash of their id; a parameter), which bounds it. Words need `support` toxic documents and `odds`.
3. One pass scores every document. Suspicious tokens are found on byte arrays: a look-alike beside a
   letter or another look-alike, separators inside, three equal letters, or three single characters in
   a row. Numbers are none: a token needs a letter or two look-alikes that are no digits. Runs count as
   three characters at most; what is longer than 48 is restored in overlapping stretches. Readings are
   kept per task in a bounded cache. Of rows of characters, of stretches and of tokens with several
   separators every part of at least 3 letters is looked up.
4. The logistic weights are fitted on the measures of the same bounded sample of training rows.

Rows: null and empty texts have no words and get the score of harmless text. Null ids are never
training rows. Labels other than 0 and 1 are not used; repeated labels or ids count as often as they
occur. Without both labels every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.quality_classifier import held_out
from ripplet.llm.words import ALPHANUMERIC, SPACED, Words, pieces, small_batches, words_of
from ripplet.session import cut_lineage

# Which letters a look-alike may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
SEPARATORS = " .-_*~'"
LONGEST = 48
SHORTEST = 3
EDGES = ".,;:!?\"'()[]{}#%&*|"
PLAIN_EDGES = "".join(c for c in EDGES if c not in LOOK_ALIKES)
SYMBOLS = 64
_ALPHABET = np.full(256, 28, np.int64)  # 0 is a word's edge, 1 to 26 letters, 27 digits, 28 others, from 32 non-ASCII bytes
_ALPHABET[48:58] = 27
_ALPHABET[65:91] = _ALPHABET[97:123] = np.arange(1, 27)
_ALPHABET[128:] = 32 + (np.arange(128, 256) & 31)
_ALPHABET[9:14] = _ALPHABET[32] = 0
_LETTER = ((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122) & (np.arange(256) < 128) | (np.arange(256) >= 128)
_ALIKE = np.isin(np.arange(256), [ord(c) for c in LOOK_ALIKES if ord(c) < 128])
_APART = np.isin(np.arange(256), [ord(c) for c in SEPARATORS if c != " "])
_SIGN = _ALIKE & ~((np.arange(256) >= 48) & (np.arange(256) <= 57))
_LIKE, _APART_CLASS = re.escape("".join(LOOK_ALIKES)), re.escape(SEPARATORS.strip())
_MIXED = re.compile(rf"[^\W\d_][{_LIKE}]|[{_LIKE}][^\W\d_]|[{_LIKE}](?<!\d)[{_LIKE}]|[{_LIKE}][{_LIKE}](?<!\d)|[€£]|([^\W\d_])\1\1")
_INNER = re.compile(rf"(?<=[^\W_{_APART_CLASS}]|[{_LIKE}])[{_APART_CLASS}]+(?=[^\W_]|[{_LIKE}])")
_LETTERS, _SIGNS = re.compile(r"[^\W\d_]"), re.compile("[" + re.escape("".join(c for c in LOOK_ALIKES if not c.isdigit())) + "]")
_RUN = re.compile(r"(.)\1{3,}", re.S)
_PARTS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def trigram_counts(raw: np.ndarray) -> np.ndarray:
    symbols = np.concatenate(([0, 0], _ALPHABET[raw], [0]))
    return np.bincount(symbols[:-2] * SYMBOLS * SYMBOLS + symbols[1:-1] * SYMBOLS + symbols[2:], minlength=SYMBOLS ** 3)


def _count(batches):
    total = np.zeros(SYMBOLS ** 3, np.int64)
    for batch in pieces(batches, "text"):
        words = words_of(batch["text"], SPACED)
        total += trigram_counts(words.raw)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["code", "n"])


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(third | first two), with each shorter history as the prior of the longer one."""
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    single = (cube.sum((0, 1)) + 1) / (cube.sum() + SYMBOLS)
    pair = (cube.sum(0) + 8 * single) / (cube.sum((0, 2)) + 8)[:, None]
    triple = (cube + 8 * pair) / (cube.sum(2) + 8)[:, :, None]
    return -np.log(triple)


class Restorer:
    """Viterbi over the readings of a token; keeps the readings of tokens it has seen."""

    def __init__(self, costs: np.ndarray, most: int = 200_000):
        self.costs, self.most, self.known = costs.tolist(), most, {}

    @staticmethod
    def readings(char: str, times: int) -> list[tuple[str, float]]:
        if char.isalpha():
            return [(char * times, 0.0), (char, 1.5)] if times == 2 else [(char, 1.0), (char * 2, 1.5)] if times > 2 else [(char, 0.0)]
        found = [(char * times, 3.0 * times)]
        if char in SEPARATORS:
            found.append(("", 0.1 * times))
        for letter in LOOK_ALIKES.get(char, ""):
            found.append((letter, 0.5 + 0.5 * (times > 1)))
            if times > 1:
                found.append((letter * 2, 1.0))
        if char in "!|+$" or not char.isalnum():
            found.append(("", 2.5))
        return found

    def restore(self, token: str) -> str:
        if token in self.known:
            return self.known[token]
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        at = 0
        while at < len(token):
            char = token[at]
            end = at + 1
            while end < len(token) and token[end] == char:
                end += 1
            longer: dict[tuple[int, int], tuple[float, str]] = {}
            for letters, price in self.readings(char, end - at):
                symbols = [int(s) for s in _ALPHABET[np.frombuffer(letters.encode(), np.uint8)]]
                for (a, b), (cost, text) in paths.items():
                    cost += price
                    for s in symbols:
                        cost += self.costs[a][b][s]
                        a, b = b, s
                    best = longer.get((a, b))
                    if best is None or (cost, text + letters) < best:
                        longer[a, b] = cost, text + letters
            paths, at = longer, end
        best = min((cost + self.costs[a][b][0], text) for (a, b), (cost, text) in paths.items())[1]
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[token] = best
        return best


def _candidates(token: str) -> list[tuple[str, bool]]:
    """(token, parts) for the ways to read a token, without and with the look-alikes at its edges; none if it hides nothing."""
    out = []
    for core in dict.fromkeys((token.strip(EDGES), token.strip(PLAIN_EDGES))):
        core = _RUN.sub(r"\1\1\1", core)
        if len(core) < SHORTEST or not _LETTERS.search(core) and len(_SIGNS.findall(core)) < 2:
            continue
        apart = len(_INNER.findall(core))
        if not apart and not _MIXED.search(core):
            continue
        if len(core) <= LONGEST:
            out.append((core, apart > 1))
        else:  # whatever is no longer than LONGEST is whole in one of them
            out += [(core[at:at + 2 * LONGEST], True) for at in range(0, max(len(core) - LONGEST, 1), LONGEST)]
    return out


def suspicious(words: Words) -> list[tuple[int, str, bool]]:
    """(text, token, parts) for every token that may hide a word, or with parts several."""
    raw = words.raw
    if not len(raw):
        return []
    low = np.concatenate((raw, np.zeros(4, np.uint8)))
    low = np.where((low >= 65) & (low <= 90), low + 32, low).astype(np.uint8)
    letter, alike, apart, sign = _LETTER[low], _ALIKE[low], _APART[low], _SIGN[low]
    n = len(raw)
    part, after = letter | alike, slice(1, n + 1)
    flag = alike[:n] & letter[after] | letter[:n] & alike[after] | alike[:n] & alike[after] & (sign[:n] | sign[after])
    flag |= letter[:n] & (low[:n] < 128) & (low[:n] == low[1:n + 1]) & (low[:n] == low[2:n + 2])
    flag |= (low[:n] == 0xC2) & (low[after] == 0xA3) | (low[:n] == 0xE2) & (low[after] == 0x82) & (low[2:n + 2] == 0xAC)
    text_of = np.repeat(np.arange(len(words)), np.diff(words.first))
    out = []
    size = words.end - words.start
    holds = lambda flags: (lambda sums: sums[words.end] > sums[words.start])(np.concatenate(([0], np.cumsum(flags))))
    hot = holds(flag) | holds(part[:n] & apart[after]) & holds(apart[:n] & part[after])
    for k in np.flatnonzero(hot & holds(letter[:n] | sign[:n]) & (size >= SHORTEST)).tolist():
        out += [(int(text_of[k]), token, parts) for token, parts in _candidates(words.word(k).decode())]
    single = (size == 1) & (letter[words.start] | alike[words.start]) | (size == 2) & (raw[words.start] >= 128)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
    for a, b in edge.reshape(-1, 2).tolist():
        for text in np.unique(text_of[a:b]).tolist():
            x, y = max(a, int(words.first[text])), min(b, int(words.first[text + 1]))
            for at in range(x, max(y - 2, x), LONGEST // 2):
                stop = min(at + LONGEST, y)
                if stop - at >= 3:
                    out.append((text, " ".join(words.word(k).decode() for k in range(at, stop)), True))
    return out


def hidden_words(words: Words, restorer: Restorer) -> tuple[list[int], list[str]]:
    """(text, word) for the words that suspicious tokens turn out to be; words that stand there plainly are none."""
    texts, found = [], []
    for text, token, several in suspicious(words):
        plain = restorer.restore(token)
        if plain == token:
            continue
        plain = plain.strip(EDGES)
        parts = {plain}
        if several:
            parts |= {plain[i:j] for i in range(len(plain)) for j in range(i + SHORTEST, len(plain) + 1)}
        for part in parts.difference(_PARTS.split(token)):
            if part:
                texts.append(text)
                found.append(part)
    return texts, found


def _word_rows(words_plain: Words, raw_words: Words, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """(text, word hash) of all plain and restored words, in no order."""
    text_of = np.repeat(np.arange(len(words_plain)), np.diff(words_plain.first))
    texts, found = hidden_words(raw_words, restorer)
    extra = words_of(pa.array(found, pa.large_string()), ALPHANUMERIC)
    owner = np.repeat(np.array(texts, np.int64), np.diff(extra.first)) if texts else np.zeros(0, np.int64)
    whole = np.diff(extra.first)[np.repeat(np.arange(len(extra)), np.diff(extra.first))] == 1 if texts else np.zeros(0, bool)
    return np.concatenate((text_of, owner[whole])), np.concatenate((words_plain.hashes, extra.hashes[whole]))


def _lexicon_counts(chosen, costs):
    """Per task the number of chosen documents of each label that hold a word."""
    def run(batches):
        ids, label = chosen.value
        restorer = Restorer(costs.value)
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal held, size
            if held:
                rows = np.concatenate(held)
                words, at = np.unique(rows[0::2], return_inverse=True)
                toxic = np.bincount(at, weights=rows[1::2].astype(np.float64), minlength=len(words)).astype(np.int64)
                every = np.bincount(at, minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(toxic), pa.array(every)], names=["word", "toxic", "docs"])
            held, size = [], 0

        def wanted():
            for batch in batches:
                own = batch["id"].fill_null(0).to_numpy()
                at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
                keep = (ids[at] == own) if len(ids) else np.zeros(len(own), bool)
                yield batch.filter(pa.array(keep & batch["id"].is_valid().to_numpy(zero_copy_only=False)))

        for batch in pieces(wanted(), "text"):
            if not batch.num_rows:
                continue
            mark = label[np.searchsorted(ids, batch["id"].to_numpy())]
            text, word = _word_rows(words_of(batch["text"], ALPHANUMERIC), words_of(batch["text"], SPACED), restorer)
            order = np.lexsort((word, text))
            text, word = text[order], word[order]
            first = np.ones(len(word), bool)
            first[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
            held.append(np.stack((word[first], mark[text[first]].astype(np.uint64)), axis=1).ravel())
            size += int(first.sum())
            if size > 1 << 21:
                yield from flush()
        yield from flush()

    return run


def _measure(lexicon, costs):
    """Number, sum and largest weight of the distinct lexicon words of each text, and their share of its words."""
    def run(batches):
        known, weight = lexicon.value
        maybe = np.zeros(1 << 20, bool)
        maybe[known >> np.uint64(44)] = True
        restorer = Restorer(costs.value)
        for batch in pieces(batches, "text"):
            plain = words_of(batch["text"], ALPHANUMERIC)
            text, word = _word_rows(plain, words_of(batch["text"], SPACED), restorer)
            near = np.flatnonzero(maybe[word >> np.uint64(44)])
            text, word = text[near], word[near]
            at = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
            hit = known[at] == word if len(known) else np.zeros(len(word), bool)
            text, at = text[hit], at[hit]
            n = len(plain)
            times = np.bincount(text, minlength=n)
            both = np.unique(text * np.int64(max(len(known), 1)) + at)
            text, at = both // max(len(known), 1), both % max(len(known), 1)
            kinds = np.bincount(text, minlength=n)
            total = np.bincount(text, weights=weight[at], minlength=n)
            largest = np.zeros(n)
            np.maximum.at(largest, text, weight[at])
            x = np.stack((np.log1p(kinds), np.log1p(times), total, largest), axis=1)
            yield pa.RecordBatch.from_arrays([
                batch["id"], pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 4, pa.int32()), pa.array(x.ravel(), pa.float64())),
            ], names=["id", "x"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights and, last, the constant."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w)), x.T @ (y - p) / len(x) - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _score(model):
    def run(batches):
        w = model.value
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(-1, 4)
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(score, pa.float64())], names=["id", "score"])

    return run


def character_costs(texts: DataFrame) -> np.ndarray:
    """The character model of all texts (column text)."""
    sums = texts.select("text").mapInArrow(_count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS ** 3, np.int64)
    counts[sums["code"].to_numpy()] = sums["n"].to_numpy()
    return trigram_costs(counts)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 5, fold: int = 0, most_labelled: int = 20_000, support: int = 5, odds: float = 3.0,
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of `docs`; rows of the fold are never learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"), folds, fold))
    sample = own.orderBy(F.xxhash64("id"), "id", "label").limit(most_labelled).toArrow()
    ids, at = np.unique(sample["id"].to_numpy().astype(np.int64), return_index=True)
    label = sample["label"].to_numpy().astype(np.int64)[at]
    broadcast = spark.sparkContext.broadcast

    costs = broadcast(character_costs(texts))
    counts = texts.mapInArrow(_lexicon_counts(broadcast((ids, label)), costs), "word long, toxic long, docs long")
    toxic, clean = float(label.sum()), float(len(label) - label.sum())
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("docs") - F.col("toxic") + 0.5) / (clean + 1))
    words = (
        counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
        .where(F.col("toxic") >= support).withColumn("weight", weight).where(F.col("weight") >= odds)
        .select("word", "weight").toArrow()
    )
    known = words["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    lexicon = broadcast((known[order], words["weight"].to_numpy().astype(np.float64)[order]))
    rows = cut_lineage(texts.mapInArrow(_measure(lexicon, costs), "id long, x array<double>"))

    if 0 < label.sum() < len(label):
        chosen = spark.createDataFrame(sample)
        seen = rows.join(chosen, "id").select("x", "label").toArrow()
        x = seen["x"].combine_chunks().flatten().to_numpy().reshape(-1, 4) if len(seen) else np.zeros((0, 4))
        y = seen["label"].to_numpy() if len(seen) else np.zeros(0)
        w = fit_logistic(x, y) if 0 < y.sum() < len(y) else np.zeros(5)
    else:
        w = np.zeros(5)
    return rows.mapInArrow(_score(broadcast(w)), "id long, score double").select(
        F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

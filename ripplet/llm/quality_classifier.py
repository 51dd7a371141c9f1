"""Operator 2: quality classifier by Bradley-Terry pairwise ranking.

Every document becomes a short row of text measures in one pass over its whole text; only those
rows are shuffled, to meet their labels. A preference pair is a document labelled 1 and one labelled
0: the probability that the first is preferred is the logistic function of the difference of their
scores, and scores are linear in standardised measures and their squares. The weights minimise the
logistic loss over the pairs' feature differences (Newton steps, ridge). A document is kept when its
score is at least the training scores' quantile at the share of label 0, which maps to 0.5.

Fitting uses at most `most_labelled` labelled rows, those with the smallest hash of their id, and
`pairs_each` preference pairs for each of them; both are parameters. Everything else covers all rows.

Rows: null and empty texts get the score of a text without words. A null id is never a training
row. Labels other than 0 and 1 (null included) are not used; repeated labels or ids count as often
as they occur. If one of the two labels is absent, every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.llm.words import SPACED, Words, gram_hashes, pieces, small_batches, words_of
from ripplet.session import cut_lineage

_RANGE = np.arange(256)
_CLASSES = np.array([
    (_RANGE >= 65) & (_RANGE <= 90), (_RANGE >= 97) & (_RANGE <= 122), (_RANGE >= 48) & (_RANGE <= 57), _RANGE >= 128,
    np.isin(_RANGE, [ord(c) for c in ".,;:'\"()-"]), np.isin(_RANGE, [ord(c) for c in "!?"]),
    np.isin(_RANGE, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]), _RANGE == ord("|"), _RANGE == 10,
])
MEASURES = 18


def measures(words: Words) -> np.ndarray:
    """A row per text: character classes, lengths, repetition of words, neighbours and five-grams."""
    out = np.zeros((len(words), MEASURES), np.float64)
    lengths = (words.end - words.start).astype(np.float64)
    grams = gram_hashes(words.hashes, 5)
    for i in range(len(words)):
        raw = words.raw[words.offsets[i]:words.offsets[i + 1]]
        if not len(raw):
            continue
        classes = _CLASSES @ np.bincount(raw, minlength=256)
        out[i, :9] = classes / len(raw)
        a, b = int(words.first[i]), int(words.first[i + 1])
        n = b - a
        if not n:
            continue
        own = words.hashes[a:b]
        _, held = np.unique(own, return_counts=True)
        five = grams[a:max(a, b - 4)]
        size = lengths[a:b]
        letters = max(1.0, classes[0] + classes[1] + classes[3])
        out[i, 9:] = (
            np.log1p(n), len(held) / n, held.max() / n, float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0,
            len(np.unique(five)) / len(five) if len(five) else 1.0, np.log1p(size.mean()), np.log1p(size.std()),
            classes[0] / letters, classes[8] / n,
        )
    return out


def _measure(batches):
    for batch in pieces(batches, "text"):
        rows = measures(words_of(batch["text"], SPACED))
        flat = pa.array(rows.ravel(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [batch["id"], pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * MEASURES, pa.int32()), flat)], names=["id", "x"],
        )


def _expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / scale, -8, 8)
    return np.concatenate((z, z * z), axis=1)


def fit_pairs(better: np.ndarray, worse: np.ndarray, pairs_each: int, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Bradley-Terry weights: rows of `better` are preferred to rows of `worse`, each row in `pairs_each` pairs or more."""
    draw = np.random.default_rng(11)
    n = max(len(better), len(worse)) * pairs_each
    left, right = np.resize(draw.permutation(len(better)), n), draw.integers(0, len(worse), n)
    d = better[left] - worse[right]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (1 - p) / n - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return w


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == fold, F.lit(False))


def _score(model):
    def run(batches):
        centre, scale, weights, threshold = model.value
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(-1, MEASURES)
            raw = _expand(x, centre, scale) @ weights - threshold
            score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(score, pa.float64())], names=["id", "score"])

    return run


def fit_quality(rows: DataFrame, labels: DataFrame, folds: int, fold: int, most_labelled: int, pairs_each: int) -> tuple:
    """(centre, scale, weights, threshold) from measured rows (id, x) and labels (id, label) outside the fold."""
    own = labels.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"), folds, fold))
    sample = rows.where(~held_out(F.col("id"), folds, fold)).join(own, "id").orderBy(F.xxhash64("id"), "id", "label").limit(most_labelled).toArrow()
    x = sample["x"].combine_chunks().flatten().to_numpy().reshape(-1, MEASURES) if len(sample) else np.zeros((0, MEASURES))
    y = sample["label"].to_numpy() if len(sample) else np.zeros(0, int)
    if not 0 < y.sum() < len(y):
        return np.zeros(MEASURES), np.ones(MEASURES), np.zeros(2 * MEASURES), 0.0
    order = np.lexsort(x.T)  # equal input gives equal weights, however the rows arrive
    x, y = x[order], y[order]
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = _expand(x, centre, scale)
    weights = fit_pairs(z[y == 1], z[y == 0], pairs_each)
    return centre, scale, weights, float(np.quantile(z @ weights, 1 - y.mean(), method="midpoint"))


def _measured(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut_lineage(texts.mapInArrow(_measure, "id long, x array<double>"))
    return rows, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 3, fold: int = 1, most_labelled: int = 20_000, pairs_each: int = 5,
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of `docs`; rows of the fold are never learned from."""
    rows, own = _measured(docs, labels, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(rows, own, folds, fold, most_labelled, pairs_each))
    return rows.mapInArrow(_score(model), "id long, score double").select(
        F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _keep(model):
    def run(batches):
        centre, scale, weights, threshold = model.value
        for batch in pieces(batches, "text__"):
            raw = _expand(measures(words_of(batch["text__"], SPACED)), centre, scale) @ weights - threshold
            yield batch.filter(pa.array(raw >= 0))

    return run


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 3, fold: int = 1, most_labelled: int = 20_000, pairs_each: int = 5,
) -> DataFrame:
    """The rows of `docs` that are predicted 1, judged where they are: texts are read again, never shuffled."""
    rows, own = _measured(docs, labels, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(rows, own, folds, fold, most_labelled, pairs_each))
    state = docs.withColumn("text__", F.col(text_col).cast("string")).drop(text_col)
    return state.mapInArrow(_keep(model), state.schema).select(*[F.col("text__").alias(c) if c == text_col else F.col(c) for c in docs.columns])

import random

import numpy as np
import pytest

from ripplet.llm.quality_classifier import fit_pairs, keep_good, quality_scores
from ripplet.llm.toxicity import Restorer, hidden_words, toxicity_scores, trigram_costs, trigram_counts
from ripplet.llm.words import SPACED, words_of
from tests.llm.data import documents, prose, row, rows

import pyarrow as pa

INSULTS = ["blockhead", "nitwit", "scoundrel"]


def labelled(n=400):
    draw = random.Random(4)
    data, labels = [], []
    for k in range(n):
        good, toxic = draw.random() < 0.7, draw.random() < 0.3
        words = prose(k, draw.randrange(40, 90)).split()
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
        text = " ".join(words) + "." if good else " ".join(w.upper() for w in words[:12] for _ in range(5)) + "!"
        data.append(row(k, text))
        labels.append((k, int(good), int(toxic)))
    return data, labels


LABELS = "doc_id long, quality int, toxic int"


def accuracy(found, truth):
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"]]
    assert len(held) > 40
    return sum(a == b for a, b in held) / len(held)


def test_held_out_quality(spark):
    data, labels = labelled()
    found = quality_scores(documents(spark, data), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert accuracy(found, {i: q for i, q, _ in labels}) > 0.95


def test_held_out_toxicity(spark):
    data, labels = labelled()
    found = toxicity_scores(documents(spark, data), spark.createDataFrame(labels, LABELS), support=3).collect()
    assert len(found) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert accuracy(found, {i: t for i, _, t in labels}) > 0.95


def test_labels_of_the_fold_are_never_used(spark):
    data, labels = labelled(150)
    docs, first = documents(spark, data), spark.createDataFrame(labels, LABELS)
    held = {r["doc_id"] for r in quality_scores(docs, first).collect() if r["held_out"]}
    other = [(i, 1 - q, t) if i in held else (i, q, t) for i, q, t in labels]
    score = lambda l: {r["doc_id"]: r["score"] for r in quality_scores(docs, l).collect()}
    assert score(first) == pytest.approx(score(spark.createDataFrame(other, LABELS)))


@pytest.mark.parametrize("function", [quality_scores, toxicity_scores])
def test_awkward_rows_and_no_labels(spark, function):
    docs, none = documents(spark), spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 7, 7)], LABELS)
    found = function(docs, none).collect()
    assert len(found) == len(rows()) and {r["score"] for r in found} == {0.5} and {r["predicted"] for r in found} == {1}
    assert function(documents(spark, []), none).collect() == []


def test_keep_good_agrees_with_the_scores(spark):
    data, labels = labelled(200)
    docs, marks = documents(spark, data + [row(None, None), row(900, "")]), spark.createDataFrame(labels, LABELS)
    good = sorted(str(r["doc_id"]) for r in quality_scores(docs, marks).where("predicted = 1").collect())
    kept = keep_good(docs, marks)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == good and kept.columns == docs.columns


def test_pairs_give_the_order():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 3))
    w = fit_pairs(x[x[:, 0] > 0.2], x[x[:, 0] < -0.2], 4)
    assert w[0] > 5 * max(abs(w[1]), abs(w[2]))


@pytest.mark.parametrize("hidden", ["n1tw1t", "nitwiiiit", "n.i.t.w.i.t", "n i t w i t", "N!tw1t", "b l 0 c k h e a d", "5coundrel", "sc0undre1"])
def test_restored(hidden):
    text = " ".join(INSULTS * 50 + prose(1, 200).split())
    restorer = Restorer(trigram_costs(trigram_counts(words_of(pa.array([text]), SPACED).raw)))
    _, found = hidden_words(words_of(pa.array([f"you {hidden} there".lower()]), SPACED), restorer)
    assert set(found) & set(INSULTS)
    _, none = hidden_words(words_of(pa.array(["plain words only, 12 and 3.5!", None, ""]), SPACED), restorer)
    assert none == []


@pytest.mark.parametrize("hidden, word", [
    ("worthle55", "worthless"), ("idio7", "idiot"), ("a$$", "ass"), ("@$$", "ass"), ("!d1ot", "idiot"), ("1.d.1.0.7", "idiot"), ("s--t--u--p--i--d", "stupid"),
    ("st.up.id", "stupid"), ("stu-pid", "stupid"), ("stu" + 300 * "u" + "pid", "stupid"), ("y.o.u.s.t.u.p.i.d.o.n.e", "stupid"), ("(n1tw1t)!", "nitwit"),
    ("-".join("we all know that you are one " * 4 + "stupid").replace("- -", "-"), "stupid"),
])
def test_restored_at_edges_between_separators_and_in_long_tokens(hidden, word):
    text = " ".join(["worthless", "idiot", "ass", "stupid", "nitwit", "you", "one"] * 50 + prose(1, 200).split())
    restorer = Restorer(trigram_costs(trigram_counts(words_of(pa.array([text]), SPACED).raw)))
    _, found = hidden_words(words_of(pa.array([f"you {hidden} there"]), SPACED), restorer)
    assert word in found
    for plain in ("idiot! (stupid) stupid.", "In 2023, 3.5 or 1,000-2,000; 12+3 at 10:45"):
        assert not set(hidden_words(words_of(pa.array([plain]), SPACED), restorer)[1]) & {"worthless", "idiot", "ass", "stupid", "nitwit"}


def test_viterbi_finds_the_cheapest_reading():
    text = " ".join(INSULTS * 20 + prose(1, 100).split())
    costs = trigram_costs(trigram_counts(words_of(pa.array([text]), SPACED).raw))
    restorer = Restorer(costs)

    def readings(token):
        out, at = [("", 0.0)], 0
        while at < len(token):
            end = at + 1
            while end < len(token) and token[end] == token[at]:
                end += 1
            out = [(a + b, x + y) for a, x in out for b, y in restorer.readings(token[at], end - at)]
            at = end
        return out

    from ripplet.llm.toxicity import _ALPHABET

    def price(word):
        s = [0, 0] + [int(_ALPHABET[b]) for b in word.encode()] + [0]
        return sum(costs[s[k], s[k + 1], s[k + 2]] for k in range(len(s) - 2))

    for token in ("n1tw1t", "b10ckh3ad", "s5c0un", "t..1!"):
        assert restorer.restore(token) in {w for w, c in readings(token) if c + price(w) < min(c + price(w) for w, c in readings(token)) + 1e-9}

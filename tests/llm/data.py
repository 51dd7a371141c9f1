"""Small tables with awkward rows: nulls, empty and long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

WORDS = "river stone ember cloud meadow lantern harbor thistle copper willow saddle marble ocean pepper violet walnut".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, topic string, host string"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 0.25, "x", "y", "z")


def rows():
    base = prose(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    far = " ".join(words[:60] + prose(2, 60).split())
    return [
        row(1, base), row(2, base.upper()), row(3, near), row(4, far), row(5, None), row(6, ""), row(7, " \n\t "), row(8, "one two"),
        row(9, "One\tTWO"), row(10, prose(3, 20_000), None, None), row(11, prose(3, 20_000) + " tail", "de", "b"), row(12, "é ü — ß"),
        row(13, "same line\n" * 50), row(13, "same line\n" * 50), row(14, "same line\n" * 51), row(None, base), row(None, "alone here"),
        row(15, prose(4, 30), "de", "b"), row(16, prose(5, 30), "fr", "b"), row(17, prose(6, 30), "fr", None),
    ]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)

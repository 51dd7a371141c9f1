"""Text measures and bounded projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE_CHARS = 280


# The characters that count as whitespace.
WHITESPACE = (
    r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, in which astral characters count two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(utf16_length(text) / F.lit(4.0)).cast("bigint")


def collapse(text: Column) -> Column:
    """Whitespace runs become one blank."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def bounded(text: Column, maximum: int = SIGNATURE_CHARS) -> Column:
    return F.substring(collapse(text), 1, maximum)


def signature(declaration: Column) -> Column:
    return bounded(F.substring_index(declaration, "{", 1))


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, "").otherwise("s"))

"""Repository path classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path patterns of test, declaration and configuration files.
TEST_FOLDER = r"(^|/)__tests__(/|$)"
TEST_FILE = r"\.(test|spec)\.[cm]?[jt]sx?$"
DECLARATION_FILE = r"\.d\.[cm]?ts$"
CONFIG_FILE = r"(^|/)(tsconfig|next\.config|vite\.config|vitest\.config|eslint\.config)"


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def is_test_path(path: Column) -> Column:
    clean = normalize_path(path)
    return clean.rlike(TEST_FOLDER) | clean.rlike(TEST_FILE)


def file_kind(path: Column) -> Column:
    return (
        F.when(is_test_path(path), "test")
        .when(path.rlike(DECLARATION_FILE), "declaration")
        .when(path.rlike(CONFIG_FILE), "config")
        .otherwise("source")
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last dot suffix of the base name; a leading dot alone is not an extension."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")

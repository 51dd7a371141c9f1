"""Find and read source files. Walking and reading happen in tasks, one root or file per row."""

from __future__ import annotations

import json
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.session import ship

# Folders never entered, file endings read and the size limit in bytes.
EXCLUDED_FOLDERS = (
    ".git", ".next", ".nuxt", ".output", ".turbo", ".ripplet", "node_modules", "dist", "build", "coverage",
    "out", "generated", ".cache", ".parcel-cache",
)
SOURCE_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
MAX_BYTES = 2_000_000

NO_PROJECT_FILE = "There is no tsconfig.json; default settings apply."


def assert_inside(root: str, candidate: str) -> None:
    relative = os.path.relpath(candidate, root)
    if relative == ".." or relative.startswith(".." + os.sep) or os.path.isabs(relative):
        raise ValueError(f"Outside of {root}: {candidate}")


def _entries(folder: str, root: str):
    """(path from root, kept) below a folder; links are never followed, a skipped folder counts once."""
    with os.scandir(folder) as listing:
        for entry in listing:
            relative = os.path.relpath(entry.path, root).replace(os.sep, "/")
            if entry.is_symlink():
                yield relative, False
            elif entry.is_dir():
                if entry.name in EXCLUDED_FOLDERS:
                    yield relative, False
                else:
                    yield from _entries(entry.path, root)
            else:
                good = entry.is_file() and os.path.splitext(entry.name)[1].lower() in SOURCE_ENDINGS
                yield relative, good and entry.stat(follow_symlinks=False).st_size <= MAX_BYTES


def discover(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, path, kept) of everything met below the given roots."""

    def walk(batches):
        for batch in batches:
            for root in batch["root"]:
                found = list(_entries(root, root))
                yield pd.DataFrame({"root": root, "path": [p for p, _ in found], "kept": [bool(k) for _, k in found]})

    ship(spark)
    real = [(os.path.realpath(r),) for r in roots]
    listed = spark.createDataFrame(real, "root string").repartition(max(1, len(real)))
    return listed.mapInPandas(walk, "root string, path string, kept boolean")


def read_files(found: DataFrame) -> DataFrame:
    """(root, path, content) of the kept files, read where their rows lie."""

    def read(batches):
        for batch in batches:
            for root, path in zip(batch["root"], batch["path"]):
                target = os.path.realpath(os.path.join(root, path))
                assert_inside(root, target)
                with open(target, encoding="utf-8", errors="replace", newline="") as handle:
                    yield pd.DataFrame({"root": [root], "path": [path], "content": [handle.read()]})

    # The list is tiny beside the contents, so it is spread before reading.
    spark = found.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = found.filter("kept").select("root", "path").repartition(tasks, "path")
    return spread.mapInPandas(read, "root string, path string, content string")


def root_hash(root: str) -> str:
    import hashlib

    return hashlib.sha256(os.path.realpath(root).encode()).hexdigest()[:16]


def repository_key(root: str) -> str:
    return "repository:" + os.path.realpath(root).replace("\\", "/").lower()


def project_warnings(root: str) -> list[str]:
    return [] if os.path.isfile(os.path.join(root, "tsconfig.json")) else [NO_PROJECT_FILE]


# Strings, comments and commas before a closing bracket, as settings files may hold them.
SETTINGS_TEXT = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*[\s\S]*?\*/')
LAST_COMMA = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])')
PATTERN_SCHEMA = "pattern string, turn int, target string"


def _settings(path: str) -> dict:
    """A settings file as it is written, with comments and last commas; an absent or broken one is empty."""
    try:
        with open(path, encoding="utf-8-sig") as handle:
            text = SETTINGS_TEXT.sub(lambda m: m[0] if m[0].startswith('"') else " ", handle.read())
        read = json.loads(LAST_COMMA.sub(lambda m: m[1] or "", text))
        return read if isinstance(read, dict) else {}
    except (OSError, ValueError):
        return {}


def project_patterns(root: str) -> list[tuple[str, int, str]]:
    """(pattern, turn, target) of the path patterns of a project, targets from the root; turn -1 is the base folder.

    Settings that a file extends (by a relative path) hold where it has none of its own; both kinds of path
    are relative to the file that states them. Targets outside of the root name no indexed file.
    """
    found: dict[str, tuple[str, object]] = {}
    todo, seen = [os.path.join(os.path.realpath(root), "tsconfig.json")], set()
    while todo:
        path = os.path.realpath(todo.pop(0))
        if path in seen:
            continue
        seen.add(path)
        settings, folder = _settings(path), os.path.dirname(path)
        options = settings.get("compilerOptions")
        for key, kind in (("baseUrl", str), ("paths", dict)):
            if isinstance(options, dict) and isinstance(options.get(key), kind):
                found.setdefault(key, (folder, options[key]))
        more = settings.get("extends") or []
        for name in reversed([more] if isinstance(more, str) else more):
            if isinstance(name, str) and name.startswith("."):
                todo.append(os.path.join(folder, name if name.endswith(".json") else name + ".json"))
    base = os.path.join(*found["baseUrl"]) if "baseUrl" in found else None
    folder, patterns = found.get("paths", (root, {}))
    rows = [(p, k, os.path.join(base or folder, t)) for p, targets in patterns.items() if isinstance(targets, list) for k, t in enumerate(targets) if isinstance(t, str)]
    rows += [("*", -1, os.path.join(base, "*"))] if base else []
    real = os.path.realpath(root)
    named = [(p, k, os.path.relpath(os.path.normpath(t), real).replace(os.sep, "/")) for p, k, t in rows]
    return [(p, k, t) for p, k, t in named if t != ".." and not t.startswith("../") and p.count("*") <= 1]


def excluded_count(found: DataFrame) -> int:
    return found.agg(F.count_if(~F.col("kept")).alias("n")).head().n

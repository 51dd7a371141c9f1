"""Read-only git: the current commit and the diff text between two states."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MAX_DIFF_BYTES = 20 * 1024 * 1024


@dataclass(frozen=True)
class GitDiff:
    raw: str
    base_ref: str
    head_ref: str

    def frame(self, spark: SparkSession, diff_id: str) -> DataFrame:
        return spark.createDataFrame([(diff_id, self.raw)], "diff_id string, raw string")


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=True)
    if len(done.stdout) > MAX_DIFF_BYTES:
        raise ValueError("Git output exceeds 20 MiB.")
    return done.stdout.decode("utf-8", errors="replace")


def commit_of(root: str) -> str:
    try:
        return _git(root, "rev-parse", "HEAD").strip()
    except (subprocess.CalledProcessError, OSError):
        return "uncommitted"


def _has_parent(root: str) -> bool:
    try:
        _git(root, "rev-parse", "HEAD^")
        return True
    except subprocess.CalledProcessError:
        return False


def read_diff(root: str, base: str | None = None, head: str | None = None) -> GitDiff:
    """Diff of base and head; without them of the work tree, or of the last commit when it is clean."""
    for ref in (base, head):
        if ref and ref.startswith("-"):
            raise ValueError("A git reference must not start with a dash.")
    if base or head:
        refs = [base or "HEAD", *([head] if head else [])]
        names = (base or "HEAD", head or "worktree")
    elif _git(root, "status", "--porcelain").strip():
        refs, names = ["HEAD"], ("HEAD", "worktree")
    elif _has_parent(root):
        refs, names = ["HEAD^", "HEAD"], ("HEAD^", "HEAD")
    else:
        return GitDiff("", "HEAD", "HEAD")
    return GitDiff(_git(root, "diff", "--unified=0", "--find-renames", *refs, "--"), *names)

"""What a result was made from: code, packages, engine, data, splits, seeds."""

from __future__ import annotations

import hashlib
import importlib.metadata
import os
import platform
import subprocess
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .contract import Section, case_fingerprint

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")
#: Settings of the engine that can change a plan.
SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.master")


def _git(*words: str) -> bytes | None:
    try:
        done = subprocess.run(["git", *words], capture_output=True, check=False)
    except OSError:  # no git here
        return None
    return done.stdout if done.returncode == 0 else None


def code_state() -> dict:
    """Commit, whether the tree differs from it, and digests of the differences and of untracked files (their names and bytes). All null outside a repository."""
    commit = _git("rev-parse", "HEAD")
    if commit is None:
        return dict.fromkeys(("git_commit", "git_worktree_dirty", "git_diff_sha256", "git_untracked_files", "git_untracked_sha256"))
    diff, listed = _git("diff", "HEAD", "--binary") or b"", _git("ls-files", "--others", "--exclude-standard", "-z") or b""
    names = sorted(n for n in listed.split(b"\0") if n)
    digest = hashlib.sha256()
    for name in names:
        link = os.path.islink(name)
        digest.update(name + b"\0" + (b"link" if link else b"file") + b"\0")
        if link:
            digest.update(os.readlink(name))
        elif os.path.isfile(name):
            with open(name, "rb") as file:
                digest.update(hashlib.file_digest(file, "sha256").digest())
    return {"git_commit": commit.decode().strip(), "git_worktree_dirty": bool(diff or names), "git_diff_sha256": hashlib.sha256(diff).hexdigest() if diff else None, "git_untracked_files": len(names), "git_untracked_sha256": digest.hexdigest() if names else None}


def _version(package: str) -> str:
    try:
        return importlib.metadata.version(package)
    except importlib.metadata.PackageNotFoundError:
        return "not installed"


def holdout_kind(case: Section) -> str:
    if not case.holdout.enabled:
        return "none: retrospective development evaluation"
    return "kept by its owner" if case.data.adapter == "tabular" else "public benchmark, sealed by convention"


def provenance(spark: SparkSession, case: Section, *, dataset_fingerprint: str, split_hashes: dict[str, str], runtime_seconds: float) -> dict:
    return code_state() | {
        "timestamp": datetime.now(UTC).isoformat(), "python": sys.version, "packages": {p: _version(p) for p in PACKAGES}, "operating_system": platform.platform(), "engine": {s: spark.conf.get(s, None) for s in SETTINGS},
        "case_spec_hash": case_fingerprint(case), "dataset_fingerprint": dataset_fingerprint, "split_manifest_hashes": split_hashes, "seeds": case.evaluation.seeds, "command_line": sys.argv, "runtime_seconds": runtime_seconds,
        "cpu_count": os.cpu_count(), "holdout": holdout_kind(case),
    }

"""Who has looked at a holdout, and how often.

A holdout is known by the checksum of its data set, so a copy of the file has the same history. Its history is a folder with one file
for each access; the file's number is the access's, and a store that creates a file only once settles who was first. There
is no lock and no file that is appended to, so the folder may lie in an object store.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .sources import sinks

#: How often an access is tried again that another one has overtaken.
TRIES = 100


def history(spark: SparkSession, folder: str, checksum: str) -> list[dict]:
    """The accesses so far, first to last."""
    return sinks.read_events(spark, f"{folder}/{checksum}")


def request_access(spark: SparkSession, folder: str, checksum: str, allowed: int, *, actor: str, purpose: str, case_fingerprint: str, reason: str = "") -> dict:
    """Records an access and returns it. Beyond ``allowed`` accesses a reason is needed, otherwise PermissionError and no record."""
    if allowed < 1:
        raise ValueError("a holdout allows one access at least")
    for _ in range(TRIES):
        number = len(history(spark, folder, checksum)) + 1
        beyond = number > allowed
        if beyond and not reason.strip():
            raise PermissionError(f"access {number} to a holdout that allows {allowed} needs a reason")
        entry = {"number": number, "at": datetime.now(UTC).isoformat(), "actor": actor, "purpose": purpose, "case": case_fingerprint, "beyond_limit": beyond, "reason": reason if beyond else None}
        if sinks.append_event(spark, f"{folder}/{checksum}", number, entry):
            return entry
    raise RuntimeError("the history of the holdout does not stand still")

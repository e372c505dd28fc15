"""Version registry as an append-only event table.

Every event row carries the state it leads to, so the current state of a
registry is its latest row: one combining aggregate, no replay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslab.functions.versions import check_version_id
from obslab.operators.skew import salted_join

INITIAL = "initial"
EVENT_SCHEMA = "registry string, seq bigint, action string, active_version string, previous_version string"


def version_state(events: DataFrame, keys: Sequence[str] = ("registry",)) -> DataFrame:
    """Active and previous version per registry: the row with the highest sequence number."""
    return events.groupBy(*keys).agg(
        F.max_by(F.struct("active_version", "previous_version"), "seq").alias("state"),
        F.max("seq").alias("seq"),
        F.count(F.lit(1)).alias("n_events"),
    ).select(*keys, "state.*", "seq", "n_events")


def stale_candidates(candidates: DataFrame, state: DataFrame, keys: Sequence[str] = ("registry",)) -> DataFrame:
    """Candidates whose base is no longer the active version; without events it is ``initial``."""
    active = F.coalesce("active_version", F.lit(INITIAL))
    return (
        salted_join(candidates, state.select(*keys, "active_version"), keys, "left")
        .withColumn("active_version", active)
        .withColumn("stale", F.col("base_version") != F.col("active_version"))
    )


def adopt(state: dict, version: str, base: str) -> dict:
    """The next state after adopting ``version``; refused when its base is not active any more."""
    check_version_id(version)
    active = state.get("active_version") or INITIAL
    if version == INITIAL:
        raise ValueError("use roll_back to return to an earlier version")
    if base != active:
        raise ValueError(f"stale candidate: its base {base!r} is not the active version {active!r}")
    return {"action": "adopt", "active_version": version, "previous_version": active}


def roll_back(state: dict) -> dict:
    """The next state after a return: active and previous swap, so two returns undo each other."""
    if not state.get("previous_version"):
        raise ValueError("there is no previous version")
    return {
        "action": "roll_back",
        "active_version": state["previous_version"],
        "previous_version": state.get("active_version") or INITIAL,
    }

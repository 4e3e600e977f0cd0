"""Reads of a journal at a fixed high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def event_range(events: DataFrame, after: int, upto: int) -> DataFrame:
    """Events of (after, upto]; the bounds reach the scan."""
    return events.filter((F.col("sequence") > after) & (F.col("sequence") <= upto))


def high_water(events: DataFrame) -> DataFrame:
    return events.groupBy("session").agg(F.max("sequence").alias("high_water"))


def request_view(events: DataFrame, active: DataFrame) -> DataFrame:
    """Snapshot and delta of every session, from one plan and so one state of the files.

    active: (session, snapshot_id, pointer_version, covered_event_end), one row a session. A session without one has a
    covered end of 0 and all events as delta. Over tables that are bucketed by session nothing is shuffled.
    """
    marked = high_water(events).join(active, "session", "left")
    marked = marked.select("session", "snapshot_id", F.coalesce("pointer_version", F.lit(0)).alias("pointer_version"), F.coalesce("covered_event_end", F.lit(0)).alias("covered_event_end"), "high_water")
    return marked.join(events, "session").filter("sequence > covered_event_end AND sequence <= high_water")


def frozen_view(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events a job compiles: from its own base to its own target, whatever the pointer says now."""
    return events.join(jobs.select("session", "job_id", "base_coverage", "target"), "session").filter("sequence > base_coverage AND sequence <= target")


def page(table: DataFrame, key: str, last: str | None, size: int = 128) -> DataFrame:
    """Keyset pagination: the next rows by key."""
    rest = table if last is None else table.filter(F.col(key) > last)
    return rest.orderBy(key).limit(size)


def metric_counts(wanted: DataFrame, metrics: DataFrame, kind: str, profile: str) -> DataFrame:
    """Stored counts of the wanted ids; ids without one are left out."""
    known = metrics.filter((F.col("artifact_kind") == kind) & (F.col("profile") == profile))
    return wanted.join(known.select(F.col("artifact_id").alias("event_id"), F.col("token_count").alias("stored_count")), "event_id")

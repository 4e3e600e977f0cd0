"""Aggregates over the journal's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.prelude import EVENT_TYPES


def session_event_counts(events: DataFrame) -> DataFrame:
    """(session, event_type, n) with a row for each of the four types, zero where a session has none."""
    counts = events.groupBy("session").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES])
    return counts.unpivot("session", list(EVENT_TYPES), "event_type", "n")


def first_by_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """All rows with ``duplicate``: false for the first of its key in the order."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("duplicate", n > 1)


def safe_ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(empty))


def ledger_summary(records: DataFrame, by: str = "session") -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    out = records.groupBy(by).agg(
        n("retained").alias("retained"), n("approximate").alias("approximate"), n("released").alias("released"),
        F.count_if(F.col("status") != "retained").alias("loss"), F.sum("before_tokens").alias("before_tokens"), F.sum("after_tokens").alias("after_tokens"),
    )
    return out.withColumn("compression_ratio", safe_ratio(F.col("after_tokens"), F.col("before_tokens"), 1.0))


def merge_envelope(capsules: DataFrame, sources: DataFrame) -> DataFrame:
    """What a merged capsule of each session covers: range, highest level, sorted distinct sources."""
    rank = F.array_position(F.array(*map(F.lit, ("micro", "episode", "task", "global"))), F.col("level"))
    spans = capsules.groupBy("session").agg(F.min("covered_event_start").alias("start"), F.max("covered_event_end").alias("end"), F.max_by("level", rank).alias("level"))
    ids = sources.groupBy("session").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source_event_ids"))
    return spans.join(ids, "session")


def accumulate(entries: DataFrame) -> DataFrame:
    """COO entries (graph, row, col, value) with duplicates summed and exact zeros dropped."""
    return entries.groupBy("graph", "row", "col").agg(F.sum("value").alias("value")).filter("value <> 0")


def matrix_norms(entries: DataFrame) -> DataFrame:
    """(graph, row_norm, max_abs): the infinity norm and the largest magnitude."""
    rows = entries.groupBy("graph", "row").agg(F.sum(F.abs("value")).alias("s"), F.max(F.abs("value")).alias("m"))
    return rows.groupBy("graph").agg(F.max("s").alias("row_norm"), F.max("m").alias("max_abs"))


def reduction_text(candidates: Column, reduced: Column) -> Column:
    """Percent with two digits, rounded down; INVALID for a negative count or a reduction of nothing."""
    h = F.floor(F.least(candidates, reduced) * 10000 / candidates)
    text = F.format_string("%d.%02d%%", F.floor(h / 100), h % 100)
    return F.when((candidates < 0) | (reduced < 0), "INVALID").when(candidates == 0, F.when(reduced == 0, "0.00%").otherwise("INVALID")).otherwise(text)


def most_recent(accesses: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """(key, latest) of the keys that a map of ``most`` entries holds after all accesses: the ones used last, ties by key."""
    return accesses.groupBy(key).agg(F.max(at).alias("latest")).orderBy(F.desc("latest"), key).limit(most)

"""Validity of journal, job and snapshot rows, as boolean expressions or zero-row queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.prelude import CANDIDATE_STATES, WORKING_STATES

#: The legal (event type, role, hook) triples.
TRIPLES = (
    ("USER_MESSAGE", "USER", "ON_LLM_REQUEST"),
    ("ASSISTANT_MESSAGE", "ASSISTANT", "ON_AGENT_DONE"),
    ("TOOL_CALL", "TOOL", "ON_USING_LLM_TOOL"),
    ("TOOL_RESULT", "TOOL", "ON_LLM_TOOL_RESPOND"),
)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def legal_triple(kind="event_type", role="role", hook="source_hook") -> Column:
    return any_of([(F.col(kind) == k) & (F.col(role) == r) & (F.col(hook) == h) for k, r, h in TRIPLES])


def job_conditionals() -> Column:
    """True if a job's nullable columns agree with its state."""
    state, base = F.col("state"), F.col("base_snapshot_id")
    errors = [F.col(c).isNull() for c in ("error_stage", "error_code", "error_message")]
    leased = F.col("lease_owner").isNotNull() & (F.col("lease_epoch") >= 1) & F.col("lease_expires_at").isNotNull()
    free = F.col("lease_owner").isNull() & F.col("lease_expires_at").isNull()
    must = lambda when, then, other: F.when(when, then).otherwise(other)
    return all_of([
        all_of(errors) | ~any_of(errors),
        must(base.isNull(), F.col("base_pointer_version") == 0, F.col("base_pointer_version") >= 1),
        must(state.isin(*WORKING_STATES), leased, free),
        state.isin(*CANDIDATE_STATES) == F.col("candidate_snapshot_id").isNotNull(),
        ~state.isin("RETRY_WAIT", "FAILED") | ~any_of(errors),
        (state == "RETRY_WAIT") == F.col("next_retry_at").isNotNull(),
        (state == "COMMITTED") == F.col("committed_at").isNotNull(),
    ])


def snapshot_state() -> Column:
    """True if a snapshot's audit and commit time agree with its state."""
    passed = F.col("committed_at").isNotNull() & F.col("mechanical_passed") & (F.col("semantic_status") != "failed") & (F.size("failure_codes") == 0)
    return F.when(F.col("state") == "COMMITTED", passed).otherwise(F.col("committed_at").isNull())


def distinct_array(column: str | Column) -> Column:
    return F.size(F.array_distinct(column)) == F.size(column)


def contained(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def delta_contiguity(view: DataFrame) -> DataFrame:
    """(session, contiguous) of a view with rows (session, sequence, covered_event_end, high_water): the delta is C+1..H."""
    n, c, h = F.col("sequence"), F.max("covered_event_end"), F.max("high_water")
    whole = (F.min(n) == c + 1) & (F.max(n) == h) & (F.count("*") == h - c) & (F.count_distinct(n) == F.count("*"))
    return view.groupBy("session").agg(whole.alias("contiguous"))


def view_error(view: DataFrame) -> DataFrame:
    """(session, error_code) of a read view: NONE, or why it may not be used."""
    null, c = F.col("snapshot_id").isNull(), F.col("covered_event_end")
    code = (
        F.when(null & ((c != 0) | (F.col("pointer_version") != 0)), "BOOTSTRAP_INVALID")
        .when(~null & (F.col("pointer_version") < 1), "POINTER_INVALID")
        .when(~null & (c > F.col("high_water")), "COVERAGE_BEYOND_HIGH_WATER")
        .otherwise("NONE")
    )
    return view.select("session", code.alias("error_code")).distinct()


def gaps(events: DataFrame) -> DataFrame:
    """Events that don't follow the one before: zero rows for a sound journal."""
    before = F.lag("sequence").over(Window.partitionBy("session").orderBy("sequence"))
    return events.withColumn("previous", before).filter(F.col("previous").isNotNull() & (F.col("sequence") != F.col("previous") + 1))


def missing_sources(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return expected.join(present, key, "left_anti")


def relation_entries_exceed(relations: DataFrame, limit: int) -> DataFrame:
    """(graph, exceeds): whether the sum of squared term counts is over the limit."""
    return relations.groupBy("graph").agg((F.sum(F.col("n_terms") * F.col("n_terms")) > limit).alias("exceeds"))


def ledger_errors(records: DataFrame) -> DataFrame:
    """Ledger rows that may not be stored: a required one not retained, an empty identity, a negative count, a repeated source item."""
    key = ["source_capsule_id", "kind", "item_id"]
    n = F.count("*").over(Window.partitionBy(*key))
    empty = any_of([F.length(F.trim(F.col(k))) == 0 for k in key])
    return records.withColumn("copies", n).filter((F.col("required") & (F.col("status") != "retained")) | empty | (F.col("before_tokens") < 0) | (F.col("after_tokens") < 0) | (F.col("copies") > 1))


#: Fixed value: larger numbers in a trace are shown as this with a plus.
TRACE_LIMIT = 1_000_000


def trace_labels(trace: Column, configured: str) -> dict[str, Column]:
    """What is shown of an engine's trace (a struct; null: no trace): labels that carry no content."""
    mode, outcome, retries = trace["mode"], trace["outcome"], trace["adaptive_retry_count"]
    passed = trace["required_passed"].eqNullSafe(True) & trace["provenance_passed"].eqNullSafe(True)
    state = (
        F.when(trace.isNull(), "NONE").when(~mode.eqNullSafe(configured), "UNVERIFIED").when((mode == "OFF") | (outcome == "OFF"), "NONE").when(outcome == "DEGRADED_RAW", "DEGRADED_RAW")
        .when((mode == "SHADOW") | ~outcome.eqNullSafe("ACTIVE") | ~passed | retries.isNull(), "UNVERIFIED").when(retries > 0, "REFINED").otherwise("VERIFIED")
    )
    missing = lambda c: F.when(trace.isNull(), "UNAVAILABLE").otherwise(c)
    number = lambda k: missing(F.when(trace[k].isNull() | (trace[k] < 0), "INVALID").when(trace[k] > TRACE_LIMIT, f"{TRACE_LIMIT}+").otherwise(trace[k].cast("string")))
    share = lambda k: F.when(trace[k], "PASS").when(~trace[k], "FAIL").otherwise("UNKNOWN")
    n, less = trace["candidate_count"], F.least(trace["candidate_count"], trace["reduced_count"])
    parts = F.floor(less * 10_000 / n)
    ratio = F.when(n.isNull() | (n < 0) | trace["reduced_count"].isNull() | (trace["reduced_count"] < 0), "INVALID").when(n == 0, F.when(trace["reduced_count"] == 0, "0.00%").otherwise("INVALID"))
    ratio = ratio.otherwise(F.format_string("%d.%02d%%", F.floor(parts / 100), parts % 100))
    return {
        "state": state, "stable_code": F.when(trace.isNull(), "CONTEXT_TRACE_UNAVAILABLE").otherwise(F.coalesce(trace["error_code"], F.lit("NONE"))), "candidate_count": number("candidate_count"),
        "reduced_count": number("reduced_count"), "recovery_count": number("adaptive_retry_count"), "reduction_ratio": missing(ratio), "required_coverage": share("required_passed"), "provenance_coverage": share("provenance_passed"),
    }

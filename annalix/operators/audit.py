"""Publication audits: one boolean a failure code, from a few aggregates over tagged tables of all candidates at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import materialise
from .checks import any_of

#: Failure codes in order.
CODES = (
    "EMPTY_COMPILER_OUTPUT", "SESSION_KEY_MISMATCH", "BASE_SNAPSHOT_MISMATCH", "TARGET_MISMATCH", "COVERAGE_GAP", "CAPSULE_MEMBERSHIP_MISMATCH", "SNAPSHOT_ANCHOR_MISMATCH",
    "INVALID_CAPSULE_COVERAGE", "UNSUPPORTED_ACTIVE_SEMANTIC", "MISSING_PRIOR_SEMANTIC", "MISSING_REQUIRED_ANCHOR", "MECHANICAL_NOT_PASSED", "SOURCE_COVERAGE_NOT_FULL",
    "ANCHOR_RECALL_NOT_FULL", "UNSUPPORTED_CRITICAL_CLAIMS", "QUALITY_COVERAGE_GAP", "TOKEN_CEILING_EXCEEDED",
)
#: Kinds whose items may be superseded or retracted.
TRANSITIONABLE = ("goal", "constraint", "progress", "open_loop", "preference", "emotional_context", "decision")
SEMANTIC = (*TRANSITIONABLE, "entity", "dependency")


@dataclass(frozen=True)
class Candidates:
    """Inputs, a row or more for each session.

    heads: session, snapshot_session, base_snapshot_id, expected_base, covered_event_end, source_high_water_mark, target, base_coverage,
    capsule_ids, anchor_ids, mechanical_passed, token_cost, ceiling. capsules: session, capsule_session, capsule_id, ordinal, start, end,
    sources, mechanical_passed, source_coverage, anchor_recall, unsupported, gap, token_cost. items and prior_items: session, kind, item_id,
    text, sources, status, ordinal. prior_capsules: session, sources. events: session, event_id, sequence.
    """

    heads: DataFrame
    capsules: DataFrame
    items: DataFrame
    prior_capsules: DataFrame
    prior_items: DataFrame
    events: DataFrame


def semantic_records(items: DataFrame) -> DataFrame:
    """(session, stable_id, sources, status, supports_transition) of all semantic items; anchors are not among them."""
    movable = F.col("kind").isin(*TRANSITIONABLE)
    return items.filter(F.col("kind").isin(*SEMANTIC)).select("session", F.col("item_id").alias("stable_id"), "sources", F.when(movable, F.col("status")).otherwise("active").alias("status"), movable.alias("supports_transition"))


def _tagged(parts: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame:
    """Rows of several tables under one another, with the name of each in ``what``; columns that a table lacks are null."""
    out = [df.select(F.lit(what).alias("what"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]) for what, df in parts.items()]
    return reduce(DataFrame.unionByName, out)


def _sourced(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select("session", *keep, F.explode_outer("sources").alias("source"))


def _provenance(c: Candidates) -> DataFrame:
    """(session, claims, unsupported, stray, lost): from one table of sources, what knows them and what cites them, summed by claim, by item and by session."""
    records, prior = semantic_records(c.items), semantic_records(c.prior_items).filter("status = 'active'")
    live = records.filter("status = 'active'").withColumn("moved", F.lit(False))
    moved = records.filter("supports_transition AND status IN ('superseded', 'retracted')").withColumn("moved", F.lit(True))
    anchors = c.items.filter("kind = 'anchor' AND status = 'active'").select("session", F.col("item_id").alias("stable_id"), "sources", F.lit(False).alias("moved"))
    claim = lambda rows, anchor: _sourced(rows.select("session", "stable_id", "moved", "sources", F.size("sources").alias("n_sources")), "stable_id", "moved", "n_sources").withColumn("anchor", F.lit(anchor))
    parts = {
        "event": c.events.select("session", F.col("event_id").alias("source")), "prior": _sourced(c.prior_capsules).filter("source IS NOT NULL"),
        "capsule": _sourced(c.capsules).filter("source IS NOT NULL"), "claim": claim(live.unionByName(moved), False).unionByName(claim(anchors, True)),
    }
    rows = _tagged(parts, {"session": "long", "source": "string", "stable_id": "string", "moved": "boolean", "anchor": "boolean", "n_sources": "int"})
    same = Window.partitionBy("session", "source")
    known = F.col("source").isNotNull() & F.bool_or(F.col("what").isin("event", "prior")).over(same)
    fresh = F.col("source").isNotNull() & F.bool_or(F.col("what") == "event").over(same)
    cited = rows.withColumn("known", known).withColumn("fresh", fresh).filter("what IN ('claim', 'capsule')")
    claims = cited.groupBy("session", "what", "stable_id", "moved", "anchor", "n_sources").agg(F.count_if(~F.col("known")).alias("unknown"), F.bool_or("fresh").alias("fresh"))
    before = prior.select("session", F.lit("prior").alias("what"), "stable_id", "supports_transition")
    both = claims.withColumn("supports_transition", F.lit(None).cast("boolean")).unionByName(before, allowMissingColumns=True)
    # An item's transition counts only if the prior item may move.
    is_claim, bad = F.col("what") == "claim", (F.col("n_sources") == 0) | (F.col("unknown") > 0)
    stays, goes = is_claim & ~F.col("moved"), is_claim & F.col("moved")
    items = both.groupBy("session", "stable_id").agg(
        F.bool_or(F.coalesce("supports_transition", F.lit(False))).alias("movable"), F.bool_or(F.col("what") == "prior").alias("had"),
        F.count_if(stays).alias("n_stays"), F.count_if(stays & bad).alias("bad_stays"), F.count_if(goes).alias("n_goes"), F.count_if(goes & bad).alias("bad_goes"),
        F.bool_or(stays & ~F.col("anchor")).alias("kept"), F.bool_or(goes & (F.col("unknown") == 0) & F.col("fresh")).alias("kept_moved"),
        F.sum(F.when(F.col("what") == "capsule", F.col("unknown")).otherwise(0)).alias("stray"),
    )
    on = F.when(F.col("movable"), 1).otherwise(0)
    kept = F.coalesce("kept", F.lit(False)) | (F.col("movable") & F.coalesce("kept_moved", F.lit(False)))
    return items.groupBy("session").agg(
        F.sum(F.col("n_stays") + on * F.col("n_goes")).alias("claims"), F.sum(F.col("bad_stays") + on * F.col("bad_goes")).alias("unsupported"),
        F.sum("stray").alias("stray"), F.count_if(F.col("had") & ~kept).alias("lost"),
    )


def _anchors(c: Candidates) -> DataFrame:
    """(session, anchors_before, anchors_lost, own_anchors): prior anchors against those of now, item by item."""
    same = {"session": "long", "item_id": "string", "text": "string", "sources": "array<string>", "status": "string", "ordinal": "long"}
    active = lambda rows: rows.filter("kind = 'anchor' AND status = 'active'")
    rows = _tagged({"old": active(c.prior_items), "new": active(c.items)}, same)
    old = rows.groupBy("session", "item_id", "text", "sources", "status").agg(
        F.count_if(F.col("what") == "old").alias("had"), F.count_if(F.col("what") == "new").alias("has"), F.collect_list(F.when(F.col("what") == "new", F.struct("ordinal", "item_id"))).alias("own"),
    )
    own = F.transform(F.array_sort(F.flatten(F.collect_list("own"))), lambda x: x["item_id"])
    return old.groupBy("session").agg(F.sum("had").alias("anchors_before"), F.sum(F.when(F.col("has") == 0, F.col("had")).otherwise(0)).alias("anchors_lost"), own.alias("own_anchors"))


def validate(c: Candidates) -> DataFrame:
    """(session, passed, failure_codes, source_coverage, anchor_recall, coverage_gap, unsupported_critical_claims).

    Written down part by part, and whole: inputs that are stored by session need no shuffle, so all sorts and aggregates of an audit, and of
    what reads its report, would else be held by one task at a time, each with a page of memory at least.
    """
    ordered = lambda k: F.transform(F.array_sort(F.collect_list(F.struct("ordinal", k))), lambda x: x[k])
    caps = c.capsules.groupBy("session").agg(
        ordered("capsule_id").alias("own_capsules"), F.bool_or(F.col("start") > F.col("end")).alias("bad_order"), F.max("end").alias("last_end"),
        F.min("capsule_session").alias("least_session"), F.max("capsule_session").alias("largest_session"), F.bool_and("mechanical_passed").alias("all_mechanical"), F.min("source_coverage").alias("declared_coverage"),
        F.min("anchor_recall").alias("declared_recall"), F.sum("unsupported").alias("declared_unsupported"), F.sum("gap").alias("declared_gap"), F.sum("token_cost").alias("capsule_cost"),
    )
    seen = c.events.groupBy("session").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("*").alias("n"), F.count_distinct("sequence").alias("n_seq"), F.count_distinct("event_id").alias("n_ids"))

    r = c.heads
    for name, part in (("capsules", caps), ("seen", seen), ("provenance", _provenance(c)), ("anchors", _anchors(c))):
        r = r.join(materialise(part, f"audit-{name}"), "session", "left")
    n = lambda k, d=0: F.coalesce(k, F.lit(d))
    other = lambda k: n(k != F.col("snapshot_session"), False)
    strings = F.array().cast("array<string>")
    want = F.col("target") - F.col("base_coverage")
    whole = (want > 0) & (n("n") == want) & (n("n_seq") == want) & (n("n_ids") == want) & (F.col("first") == F.col("base_coverage") + 1) & (F.col("last") == F.col("target"))
    missing = F.greatest(want - n("n_seq"), F.lit(0))
    coverage = F.least(F.coalesce(F.try_divide(n("claims") - n("unsupported"), n("claims")), F.lit(1.0)), n("declared_coverage", 0.0))
    recall_own = F.coalesce(F.try_divide(n("anchors_before") - n("anchors_lost"), n("anchors_before")), F.lit(1.0))
    recall = F.least(recall_own, n("declared_recall", 0.0))
    critical, gap = F.greatest(n("unsupported"), n("declared_unsupported")), F.greatest(missing, n("declared_gap"))
    tests: dict[str, Column] = {
        "EMPTY_COMPILER_OUTPUT": F.col("own_capsules").isNull(),
        "SESSION_KEY_MISMATCH": other(F.col("least_session")) | other(F.col("largest_session")),
        "BASE_SNAPSHOT_MISMATCH": ~F.col("base_snapshot_id").eqNullSafe(F.col("expected_base")),
        "TARGET_MISMATCH": (F.col("covered_event_end") != F.col("target")) | (F.col("source_high_water_mark") != F.col("target")),
        "COVERAGE_GAP": ~F.coalesce(whole, F.lit(False)),
        "CAPSULE_MEMBERSHIP_MISMATCH": F.col("capsule_ids") != F.coalesce("own_capsules", strings),
        "SNAPSHOT_ANCHOR_MISMATCH": F.col("anchor_ids") != F.coalesce("own_anchors", strings),
        "INVALID_CAPSULE_COVERAGE": n("bad_order", False) | n(F.col("last_end") > F.col("target"), False),
        "UNSUPPORTED_ACTIVE_SEMANTIC": (n("unsupported") > 0) | (n("stray") > 0),
        "MISSING_PRIOR_SEMANTIC": n("lost") > 0,
        "MISSING_REQUIRED_ANCHOR": recall_own < 1,
        "MECHANICAL_NOT_PASSED": ~F.col("mechanical_passed") | ~n("all_mechanical", True),
        "SOURCE_COVERAGE_NOT_FULL": coverage < 1,
        "ANCHOR_RECALL_NOT_FULL": recall < 1,
        "UNSUPPORTED_CRITICAL_CLAIMS": critical > 0,
        "QUALITY_COVERAGE_GAP": n("declared_gap") > 0,
        "TOKEN_CEILING_EXCEEDED": any_of([F.col("ceiling") < 0, F.col("token_cost") > F.col("ceiling"), n("capsule_cost") > F.col("ceiling")]),
    }
    codes = F.array_compact(F.array(*[F.when(tests[k], k) for k in CODES]))
    report = r.select("session", (F.size(codes) == 0).alias("passed"), codes.alias("failure_codes"), coverage.alias("source_coverage"), recall.alias("anchor_recall"), gap.alias("coverage_gap"), critical.alias("unsupported_critical_claims"))
    return materialise(report, "audit")


def quality_floor(reports: DataFrame, records: DataFrame) -> DataFrame:
    """Released items other than summaries fail a report with QUALITY_COVERAGE_GAP."""
    released = records.groupBy("session").agg(F.count_if((F.col("status") == "released") & (F.col("kind") != "narrative_summary")).alias("n"))
    n = F.coalesce("n", F.lit(0))
    both = F.array_union("failure_codes", F.array(F.lit("QUALITY_COVERAGE_GAP")))
    codes = F.filter(F.array(*map(F.lit, CODES)), lambda c: F.array_contains(F.when(n > 0, both).otherwise(F.col("failure_codes")), c))
    return reports.join(released, "session", "left").select("session", (F.size(codes) == 0).alias("passed"), codes.alias("failure_codes"), "source_coverage", "anchor_recall", F.greatest("coverage_gap", n).alias("coverage_gap"), "unsupported_critical_claims")


def loss_audit(claims: DataFrame, anchors: DataFrame, events: DataFrame) -> DataFrame:
    """(session, duplicates, unsupported, missing_anchors, source_coverage, passed) of the older audit."""
    texts = claims.filter("status = 'active'").groupBy("session", "text").agg(F.count("*").alias("n")).groupBy("session").agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    ids = events.select("session", F.col("event_id").alias("source")).distinct()
    bad = claims.filter("status = 'active'").join(ids, ["session", "source"], "left_anti").groupBy("session").agg(F.count("*").alias("unsupported"))
    lone = anchors.filter("status = 'active'").join(ids, ["session", "source"], "left_anti").groupBy("session").agg(F.count("*").alias("missing_anchors"))
    cover = claims.filter("status = 'active'").groupBy("session").agg(F.avg(F.when(F.col("source").isNotNull(), 1.0).otherwise(0.0)).alias("source_coverage"))
    out = events.select("session").distinct()
    for p in (texts, bad, lone, cover):
        out = out.join(p, "session", "left")
    n = lambda k: F.coalesce(k, F.lit(0))
    out = out.select("session", n("duplicates").alias("duplicates"), n("unsupported").alias("unsupported"), n("missing_anchors").alias("missing_anchors"), F.coalesce("source_coverage", F.lit(1.0)).alias("source_coverage"))
    return out.withColumn("passed", (F.col("duplicates") + F.col("unsupported") + F.col("missing_anchors") == 0) & (F.col("source_coverage") == 1.0))

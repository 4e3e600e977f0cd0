from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, audit, checks, compiler, mutations, windows
from ..sources import Store, read
from ..sources.journal import items_of
from ..sources.prelude import EVENT_TYPES, OPEN_STATES
from ..sources.scratch import materialise
from .join_queries import _MISSING, missing, owned_metrics
from .predicate_queries import LEDGER, ledger
from .registry import query


def candidates(s: Store) -> audit.Candidates:
    """Each session's snapshot as a candidate over its first segment as the prior state, with one fault for every session modulo 19.

    0 none, 1 empty output, 2 wrong base, 3 wrong target, 4 a missing event, 5 capsule ids, 6 anchor ids, 7 capsule range,
    8 an unknown source, 9 a lost claim, 10 a lost anchor, 11 not mechanical, 12 coverage, 13 recall, 14 unsupported, 15 gap, 16 ceiling, 17 session, 18 none.
    """
    fault = F.col("session") % 19
    sessions = s.audited.groupBy("session").agg(F.max("covered").alias("covered"))
    caps = s.audited.groupBy("capsule_id", "session", "segment").agg(  # each event is the source of an item
        F.min("sequence").alias("covered_event_start"), F.max("sequence").alias("covered_event_end"), F.sum("token_count").alias("token_cost"), F.array_sort(F.collect_set("event_id")).alias("sources")
    )
    items = items_of(s.audited).withColumn("sources", F.array("source")).withColumnRenamed("sequence", "ordinal")
    prior_items = items.filter("segment = 0")
    now = items.filter((fault != 1) & ~((fault == 9) & (F.col("segment") == 0) & (F.col("kind") != "anchor")) & ~((fault == 10) & (F.col("kind") == "anchor") & (F.col("segment") == 0)))
    now = now.withColumn("sources", F.when((fault == 8) & (F.col("segment") == 1), F.array(F.lit("nowhere"))).otherwise(F.col("sources")))
    made = caps.filter(fault != 1).select(
        "session", F.when(fault == 17, -1).otherwise(F.col("session")).alias("capsule_session"), "capsule_id", F.col("segment").alias("ordinal"), F.col("covered_event_start").alias("start"),
        F.when(fault == 7, F.col("covered_event_end") + 100).otherwise(F.col("covered_event_end")).alias("end"), "sources", (fault != 11).alias("mechanical_passed"),
        F.when(fault == 12, 0.5).otherwise(1.0).alias("source_coverage"), F.when(fault == 13, 0.5).otherwise(1.0).alias("anchor_recall"),
        F.when(fault == 14, 1).otherwise(0).alias("unsupported"), F.when(fault == 15, 1).otherwise(0).alias("gap"), "token_cost",
    )
    ordered = lambda k, by: F.transform(F.array_sort(F.collect_list(F.struct(by, k))), lambda x: x[k])
    ids = made.groupBy("session").agg(ordered("capsule_id", "ordinal").alias("capsule_ids"), F.sum("token_cost").alias("token_cost"))
    marks = now.filter("kind = 'anchor'").groupBy("session").agg(ordered("item_id", "ordinal").alias("anchor_ids"))
    none = F.array().cast("array<string>")
    extra = lambda n: F.when(fault == n, F.array(F.lit("x"))).otherwise(none)
    heads = sessions.join(ids, "session", "left").join(marks, "session", "left").select(
        "session", F.col("session").alias("snapshot_session"), F.when(fault == 2, "other").otherwise("base").alias("base_snapshot_id"), F.lit("base").alias("expected_base"), F.col("covered").alias("covered_event_end"),
        F.when(fault == 3, F.col("covered") + 1).otherwise(F.col("covered")).alias("source_high_water_mark"), F.col("covered").alias("target"), F.lit(2).cast("long").alias("base_coverage"),
        F.concat(F.coalesce("capsule_ids", none), extra(5)).alias("capsule_ids"), F.concat(F.coalesce("anchor_ids", none), extra(6)).alias("anchor_ids"), F.lit(True).alias("mechanical_passed"),
        F.coalesce("token_cost", F.lit(0)).alias("token_cost"), F.when(fault == 16, 1).otherwise(10_000_000).alias("ceiling"),
    )
    events = s.audited.filter("sequence > 2").filter(~((fault == 4) & (F.col("sequence") == 3))).select("session", "event_id", "sequence")
    return audit.Candidates(materialise(heads, "heads"), made, now, caps.filter("segment = 0").select("session", "sources"), prior_items, events)


_CODES = """CASE session % 19 WHEN 1 THEN 'EMPTY_COMPILER_OUTPUT,MISSING_PRIOR_SEMANTIC,MISSING_REQUIRED_ANCHOR,SOURCE_COVERAGE_NOT_FULL,ANCHOR_RECALL_NOT_FULL' WHEN 2 THEN 'BASE_SNAPSHOT_MISMATCH' WHEN 3 THEN 'TARGET_MISMATCH'
 WHEN 4 THEN 'COVERAGE_GAP,UNSUPPORTED_ACTIVE_SEMANTIC,SOURCE_COVERAGE_NOT_FULL,UNSUPPORTED_CRITICAL_CLAIMS' WHEN 5 THEN 'CAPSULE_MEMBERSHIP_MISMATCH' WHEN 6 THEN 'SNAPSHOT_ANCHOR_MISMATCH' WHEN 7 THEN 'INVALID_CAPSULE_COVERAGE'
 WHEN 8 THEN 'UNSUPPORTED_ACTIVE_SEMANTIC,SOURCE_COVERAGE_NOT_FULL,UNSUPPORTED_CRITICAL_CLAIMS' WHEN 9 THEN 'MISSING_PRIOR_SEMANTIC' WHEN 10 THEN 'MISSING_REQUIRED_ANCHOR,ANCHOR_RECALL_NOT_FULL' WHEN 11 THEN 'MECHANICAL_NOT_PASSED'
 WHEN 12 THEN 'SOURCE_COVERAGE_NOT_FULL' WHEN 13 THEN 'ANCHOR_RECALL_NOT_FULL' WHEN 14 THEN 'UNSUPPORTED_CRITICAL_CLAIMS' WHEN 15 THEN 'QUALITY_COVERAGE_GAP' WHEN 16 THEN 'TOKEN_CEILING_EXCEEDED' WHEN 17 THEN 'SESSION_KEY_MISMATCH' ELSE '' END"""
#: Of every candidate: its active items, those of its third event and of its second capsule, and its capsules.
_CANDIDATES = """(SELECT m.session, i.*, c.capsules FROM marks m JOIN (SELECT session, count(*) AS claims, count(*) FILTER (WHERE sequence = 3) AS third, count(*) FILTER (WHERE segment = 1) AS second FROM items WHERE status = 'active' GROUP BY session) i USING (session)
 JOIN (SELECT session, count(*) AS capsules FROM capsules GROUP BY session) c USING (session) WHERE m.covered >= 3)"""


@query("aud_01", f"SELECT session, session % 19 IN (0, 18) AS passed, {_CODES} AS failure_codes FROM marks WHERE covered >= 3")
def aud_01(spark, sf_dir):
    """All codes of every candidate."""
    return audit.validate(candidates(Store(spark, sf_dir))).select("session", "passed", F.array_join("failure_codes", ",").alias("failure_codes"))


@query("aud_04", f"""SELECT session, CASE session % 19 WHEN 1 THEN 0.0::DOUBLE WHEN 4 THEN (claims - third) / claims WHEN 8 THEN (claims - second) / claims WHEN 12 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END::DOUBLE AS source_coverage,
 CASE session % 19 WHEN 1 THEN 0.0 WHEN 10 THEN 0.0 WHEN 13 THEN 0.5 ELSE 1.0 END::DOUBLE AS anchor_recall, CASE session % 19 WHEN 4 THEN 1 WHEN 15 THEN capsules ELSE 0 END::BIGINT AS coverage_gap,
 CASE session % 19 WHEN 4 THEN third WHEN 8 THEN second WHEN 14 THEN capsules ELSE 0 END::BIGINT AS unsupported_critical_claims FROM {_CANDIDATES}""")
def aud_04(spark, sf_dir):
    """The figures of the report: the worse of what a candidate declares and what is found."""
    report = audit.validate(candidates(Store(spark, sf_dir)))
    return report.select("session", "source_coverage", "anchor_recall", "coverage_gap", "unsupported_critical_claims")


#: The first code that each fault alone brings about, in the order of the codes.
_FAULTS = {1: "EMPTY_COMPILER_OUTPUT", 2: "BASE_SNAPSHOT_MISMATCH", 3: "TARGET_MISMATCH", 4: "COVERAGE_GAP", 5: "CAPSULE_MEMBERSHIP_MISMATCH", 6: "SNAPSHOT_ANCHOR_MISMATCH", 7: "INVALID_CAPSULE_COVERAGE", 8: "UNSUPPORTED_ACTIVE_SEMANTIC", 9: "MISSING_PRIOR_SEMANTIC", 10: "MISSING_REQUIRED_ANCHOR", 11: "MECHANICAL_NOT_PASSED", 12: "SOURCE_COVERAGE_NOT_FULL", 13: "ANCHOR_RECALL_NOT_FULL", 14: "UNSUPPORTED_CRITICAL_CLAIMS", 15: "QUALITY_COVERAGE_GAP", 16: "TOKEN_CEILING_EXCEEDED", 17: "SESSION_KEY_MISMATCH"}
_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in _FAULTS.items())


@query("aud_01_first", f"SELECT session, CASE session % 19 {_CASES} ELSE 'NONE' END AS first_code FROM marks WHERE covered >= 3")
def aud_01_first(spark, sf_dir):
    return audit.validate(candidates(Store(spark, sf_dir))).select("session", F.coalesce(F.get("failure_codes", F.lit(0)), F.lit("NONE")).alias("first_code"))


@query("aud_02", "SELECT session, item_id AS stable_id, status, kind NOT IN ('entity', 'dependency') AS supports_transition FROM items WHERE kind <> 'anchor'")
def aud_02(spark, sf_dir):
    return audit.semantic_records(Store(spark, sf_dir).items.withColumn("sources", F.array("source"))).drop("sources")


@query("aud_03", LEDGER + """SELECT m.session, m.session % 19 = 0 AND coalesce(n, 0) = 0 OR m.session % 19 = 18 AND coalesce(n, 0) = 0 AS passed FROM marks m
LEFT JOIN (SELECT session, count(*) FILTER (WHERE status = 'released' AND kind <> 'narrative_summary') AS n FROM led GROUP BY session) r USING (session) WHERE covered >= 3""")
def aud_03(spark, sf_dir):
    s = Store(spark, sf_dir)
    return audit.quality_floor(audit.validate(candidates(s)), ledger(s)).select("session", "passed")


@query("aud_05", "SELECT session, CASE WHEN session % 19 NOT IN (0, 18) THEN 'REJECTED' WHEN session % 2 = 0 THEN 'AUDITED' ELSE 'SKIPPED' END AS semantic_status FROM marks WHERE covered >= 3")
def aud_05(spark, sf_dir):
    """The semantic auditor is external: a column comes in, and is asked only of candidates that passed."""
    s = Store(spark, sf_dir)
    external = s.marks.filter("session % 2 = 0").select("session", F.lit("AUDITED").alias("verdict"))
    report = audit.validate(candidates(s)).join(external, "session", "left")
    return report.select("session", F.when(~F.col("passed"), "REJECTED").otherwise(F.coalesce("verdict", F.lit("SKIPPED"))).alias("semantic_status"))


@query("aud_06", """SELECT j.session, coalesce(d, 0) AS duplicates, coalesce(u, 0) AS unsupported, coalesce(a, 0) AS missing_anchors FROM (SELECT DISTINCT session FROM covered WHERE sequence <> 3) j
LEFT JOIN (SELECT session, count(*) FILTER (WHERE n > 1) AS d FROM (SELECT session, text, count(*) AS n FROM items WHERE status = 'active' AND kind NOT IN ('anchor', 'dependency', 'entity') GROUP BY ALL) GROUP BY session) x USING (session)
LEFT JOIN (SELECT session, count(*) AS u FROM items WHERE status = 'active' AND sequence = 3 AND kind NOT IN ('anchor', 'dependency', 'entity') GROUP BY session) y USING (session)
LEFT JOIN (SELECT session, count(*) AS a FROM items WHERE status = 'active' AND sequence = 3 AND kind = 'anchor' GROUP BY session) z USING (session)""")
def aud_06(spark, sf_dir):
    s = Store(spark, sf_dir)
    claims = s.items.filter("kind NOT IN ('anchor', 'dependency', 'entity')")
    return audit.loss_audit(claims, s.items.filter("kind = 'anchor'"), s.covered.filter("sequence <> 3")).select("session", "duplicates", "unsupported", "missing_anchors")


@query("comp_03", "SELECT 'cap:' || sha256(session || chr(0) || min(sequence) || chr(0) || max(sequence)) AS capsule_id, session, min(sequence) AS covered_event_start, max(sequence) AS covered_event_end, count(*) AS claims, sum(greatest(1, length(content) // 4))::BIGINT AS token_cost FROM journal GROUP BY session")
def comp_03(spark, sf_dir):
    """One capsule a session with a claim for each event; ids are stable, not random."""
    first, last = F.min("sequence"), F.max("sequence")
    rows = Store(spark, sf_dir).journal.groupBy("session").agg(first.alias("covered_event_start"), last.alias("covered_event_end"), F.count("*").alias("claims"), F.sum(F.greatest(F.lit(1), F.floor(F.length("content") / 4))).alias("token_cost"))
    parts = [F.col(c).cast("string") for c in ("session", "covered_event_start", "covered_event_end")]
    return rows.withColumn("capsule_id", scalars.stable_id("cap:", *parts))


@query("comp_02", "SELECT 'cap-' || session || '-' || segment AS capsule_id, count(*) AS quotes FROM items WHERE kind = 'anchor' GROUP BY session, segment")
def comp_02(spark, sf_dir):
    """Capsules from extracted spans: those that quote their event, counted by capsule. The extracting model is external."""
    s = Store(spark, sf_dir)
    spans = s.items.filter("kind = 'anchor'").select("capsule_id", "text", F.col("source").alias("event_id"))
    quoted = spans.join(s.journal.select("event_id", "content"), "event_id").filter(F.contains("content", "text"))
    return quoted.groupBy("capsule_id").agg(F.count("*").alias("quotes"))


@query("comp_02_table", "SELECT 'cap-' || session || '-' || segment AS capsule_id, count(*) AS quotes, min(sequence) AS first, max(sequence) AS last FROM items WHERE kind = 'anchor' GROUP BY session, segment")
def comp_02_table(spark, sf_dir):
    """The same by a table function over each session's spans in order."""
    s = Store(spark, sf_dir)
    spans = s.items.filter("kind = 'anchor'").select("session", "sequence", "capsule_id", "text").join(s.journal.select("session", "sequence", "content"), ["session", "sequence"])
    return compiler.compile_spans(spans).filter("quotes > 0").select("capsule_id", "quotes", "first", "last")


def _compiled(s: Store):
    """Capsules from the segments of what is not covered, with a claim for each event, and whether each is whole."""
    cut = windows.segment_sessions(s.delta, windows.Caps(3, 4096))
    claims = cut.join(s.delta.select("session", "sequence", "event_id"), "session").filter("sequence BETWEEN start AND end")
    parts = [F.col(c).cast("string") for c in ("session", "start", "end")]
    made = claims.groupBy("session", "segment", "start", "end", "tokens", "reason").agg(F.count("*").alias("claims"))
    return made.withColumn("capsule_id", scalars.stable_id("cap:", *parts, digits=24)).withColumn("complete", F.col("claims") == F.col("end") - F.col("start") + 1)


def _validated(s: Store, made=None):
    """(session, passed, capsules, first, last): segments are whole, leave no gap, and reach from the mark to the end of the delta."""
    made = _compiled(s) if made is None else made
    ranges = made.groupBy("session").agg(F.bool_and("complete").alias("whole"), F.count("*").alias("capsules"), F.min("start").alias("first"), F.max("end").alias("last"), F.sum("claims").alias("claims"))
    marks = s.marks.select("session", "high_water", "covered")
    passed = F.col("whole") & (F.col("first") == F.col("covered") + 1) & (F.col("last") == F.col("high_water")) & (F.col("claims") == F.col("last") - F.col("first") + 1)
    return ranges.join(marks, "session").select("session", passed.alias("passed"), "capsules", "first", "last")


@query("comp_01", "SELECT session, true AS passed, covered + 1 AS first, high_water AS last FROM marks")
def comp_01(spark, sf_dir):
    """Delta to candidate: units, segments, one scaffold capsule a segment, and the validation of the whole."""
    return _validated(Store(spark, sf_dir)).select("session", "passed", "first", "last")


@query("comp_01_capsules")
def comp_01_capsules(spark, sf_dir):
    return _compiled(Store(spark, sf_dir))


@query("comp_04", "SELECT m.session, coalesce(p.pointer_version, 0) - m.session % 2 AS expected, CASE WHEN m.session % 2 = 0 THEN 'COMMITTED' ELSE 'SUPERSEDED' END AS outcome FROM marks m LEFT JOIN pointers p USING (session)")
def comp_04(spark, sf_dir):
    """The whole loop: delta, compile, validate, swap. Odd sessions started from a pointer that has moved since."""
    s = Store(spark, sf_dir)
    reports = _validated(s)
    base = s.marks.join(s.pointers, "session", "left").select("session", (F.coalesce("pointer_version", F.lit(0)) - F.col("session") % 2).alias("expected"))
    proposals = base.join(reports.select("session", "last"), "session").select("session", F.concat_ws("-", F.lit("snap"), "session", "last").alias("snapshot_id"), "expected")
    return mutations.publish(s.pointers, proposals, reports).select("session", "expected", "outcome")


@query("back_01", f"SELECT m.artifact_kind, m.artifact_id, strlen(coalesce(j.content, 'Summary of ' || m.artifact_id))::BIGINT AS bytes FROM ({_MISSING}) m LEFT JOIN journal j ON m.artifact_kind = 'EVENT' AND j.event_id = m.artifact_id QUALIFY row_number() OVER (PARTITION BY m.session ORDER BY kind_rank, sort_major, sort_minor, artifact_id) <= 2")
def back_01(spark, sf_dir):
    """The next two artifacts of each session without a count, with the text to count."""
    from pyspark.sql import Window

    s = Store(spark, sf_dir)
    order = Window.partitionBy("session").orderBy("kind_rank", "sort_major", "sort_minor", "artifact_id")
    batch = missing(s).withColumn("n", F.row_number().over(order)).filter("n <= 2")
    texts = s.journal.select(F.lit("EVENT").alias("artifact_kind"), F.col("event_id").alias("artifact_id"), "content")
    text = F.coalesce("content", F.concat(F.lit("Summary of "), "artifact_id"))
    return batch.join(texts, ["artifact_kind", "artifact_id"], "left").select("artifact_kind", "artifact_id", scalars.utf8_bytes(text).alias("bytes"))


_OPEN = ", ".join(f"'{x}'" for x in OPEN_STATES)


@query("obs_01", f"""SELECT m.session, CASE WHEN s.snapshot_id IS NULL THEN 'EMPTY' ELSE '1-' || s.covered_event_end END AS covered_range, m.high_water, d.delta_range, u.users, a.assistants,
 coalesce(j.state, 'NONE') AS job_state, coalesce(j.error_code, 'NONE') AS retry_code, coalesce(k.n, 0) AS metrics
FROM marks m LEFT JOIN snapshots s USING (session)
LEFT JOIN (SELECT session, min(sequence) || '-' || max(sequence) AS delta_range FROM delta GROUP BY session) d USING (session)
LEFT JOIN (SELECT session, count(*) FILTER (WHERE event_type = 'USER_MESSAGE') AS users FROM journal GROUP BY session) u USING (session)
LEFT JOIN (SELECT session, count(*) FILTER (WHERE event_type = 'ASSISTANT_MESSAGE') AS assistants FROM journal GROUP BY session) a USING (session)
LEFT JOIN (SELECT * FROM jobs WHERE state IN ({_OPEN})) j USING (session)
LEFT JOIN (SELECT session, count(*) AS n FROM (SELECT j.session FROM metrics m JOIN journal j ON m.artifact_kind = 'EVENT' AND j.event_id = m.artifact_id UNION ALL SELECT c.session FROM metrics m JOIN capsules c ON m.artifact_kind = 'CAPSULE' AND c.capsule_id = m.artifact_id) GROUP BY session) k USING (session)""")
def obs_01(spark, sf_dir):
    s = Store(spark, sf_dir)
    n = lambda t: F.count_if(F.col("event_type") == t)
    counts = s.journal.groupBy("session").agg(n(EVENT_TYPES[0]).alias("users"), n(EVENT_TYPES[1]).alias("assistants"))
    delta = s.delta.groupBy("session").agg(F.concat_ws("-", F.min("sequence"), F.max("sequence")).alias("delta_range"))
    jobs = s.jobs.filter(F.col("state").isin(*OPEN_STATES)).select("session", "state", "error_code")
    metrics = owned_metrics(s).groupBy("session").agg(F.count("*").alias("n"))
    out = s.marks.join(s.snapshots.select("session", "covered_event_end"), "session", "left")
    for part in (delta, counts, jobs, metrics):
        out = out.join(part, "session", "left")
    return out.select(
        "session", F.coalesce(F.concat(F.lit("1-"), "covered_event_end"), F.lit("EMPTY")).alias("covered_range"), "high_water", "delta_range", "users", "assistants",
        F.coalesce("state", F.lit("NONE")).alias("job_state"), F.coalesce("error_code", F.lit("NONE")).alias("retry_code"), F.coalesce("n", F.lit(0)).alias("metrics"),
    )


@query("obs_03", """SELECT job_id, CASE WHEN mode <> 'ACTIVE' OR outcome NOT IN ('ACTIVE', 'DEGRADED_RAW') THEN CASE WHEN mode = 'ACTIVE' AND outcome = 'OFF' THEN 'NONE' ELSE 'UNVERIFIED' END WHEN outcome = 'DEGRADED_RAW' THEN 'DEGRADED_RAW'
 WHEN session % 3 = 0 THEN 'UNVERIFIED' WHEN attempt_count > 0 THEN 'REFINED' ELSE 'VERIFIED' END AS state, coalesce(error_code, 'NONE') AS stable_code, target || '' AS candidate_count,
 CASE WHEN base_coverage > 0 OR target > 0 THEN (least(base_coverage, target) * 10000 // target) // 100 || '.' || lpad(((least(base_coverage, target) * 10000 // target) % 100)::VARCHAR, 2, '0') || '%' END AS reduction_ratio,
 CASE session % 3 WHEN 0 THEN 'FAIL' ELSE 'PASS' END AS required_coverage, CASE session % 5 WHEN 0 THEN 'UNKNOWN' ELSE 'PASS' END AS provenance_coverage
 FROM (SELECT *, CASE session % 7 WHEN 6 THEN 'SHADOW' ELSE 'ACTIVE' END AS mode, CASE state WHEN 'CANCELLED' THEN 'OFF' WHEN 'FAILED' THEN 'DEGRADED_RAW' WHEN 'PENDING' THEN 'SHADOW' ELSE 'ACTIVE' END AS outcome FROM jobs)""".replace("WHEN session % 3 = 0 THEN 'UNVERIFIED' WHEN attempt", "WHEN session % 3 = 0 OR session % 5 = 0 THEN 'UNVERIFIED' WHEN attempt"))
def obs_03(spark, sf_dir):
    """Traces of the context engine, one a job, as the status lines show them."""
    n, state = F.col("session"), F.col("state")
    outcome = F.when(state == "CANCELLED", "OFF").when(state == "FAILED", "DEGRADED_RAW").when(state == "PENDING", "SHADOW").otherwise("ACTIVE")
    trace = F.struct(
        F.when(n % 7 == 6, "SHADOW").otherwise("ACTIVE").alias("mode"), outcome.alias("outcome"), F.col("error_code"), F.col("target").alias("candidate_count"), F.col("base_coverage").alias("reduced_count"),
        (n % 3 != 0).alias("required_passed"), F.when(n % 5 != 0, True).alias("provenance_passed"), F.col("attempt_count").alias("adaptive_retry_count"),
    )
    shown = checks.trace_labels(trace, "ACTIVE")
    return Store(spark, sf_dir).jobs.select("job_id", *[shown[k].alias(k) for k in ("state", "stable_code", "candidate_count", "reduction_ratio", "required_coverage", "provenance_coverage")])


@query("map_01", "SELECT session, latest FROM (SELECT session, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest, row_number() OVER (ORDER BY max(ts) DESC, session) AS n FROM (SELECT user_id AS session, ts FROM events) GROUP BY session) WHERE n <= 64")
def map_01(spark, sf_dir):
    """The sessions that a map of 64 still holds after all events: those used last."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts")
    return aggregates.most_recent(events, "session", "ts", 64).select("session", F.date_format("latest", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("latest"))


@query("host_01", "SELECT session, event_id, rank * 1000 + sequence AS place FROM (SELECT session, event_id, sequence, CASE WHEN sequence = max(sequence) OVER (PARTITION BY session) THEN 3 WHEN sequence = 1 THEN 0 END AS rank FROM journal) WHERE rank IS NOT NULL")
def host_01(spark, sf_dir):
    """What of a native message list stays around a projection: the first (opaque) message before it and the current one after."""
    from pyspark.sql import Window

    last = F.max("sequence").over(Window.partitionBy("session"))
    rank = F.when(F.col("sequence") == last, 3).when(F.col("sequence") == 1, 0)
    rows = Store(spark, sf_dir).journal.select("session", "event_id", "sequence", rank.alias("rank")).filter("rank IS NOT NULL")
    return rows.select("session", "event_id", (F.col("rank") * 1000 + F.col("sequence")).alias("place"))


@query("comp_01_faults", "SELECT session, session % 5 NOT IN (1, 2, 3) AS passed FROM marks")
def comp_01_faults(spark, sf_dir):
    """Candidates of which three fifths are faulty: the first segment is lost, a claim is cited twice, or the last segment ends too early."""
    s = Store(spark, sf_dir)
    n = F.col("session") % 5
    made = _compiled(s).join(s.marks.select("session", "high_water"), "session").filter(~((n == 1) & (F.col("segment") == 0)))
    made = made.withColumn("claims", F.col("claims") + F.when((n == 2) & (F.col("segment") == 0), 1).otherwise(0))
    made = made.withColumn("end", F.col("end") - F.when((n == 3) & (F.col("end") == F.col("high_water")), 1).otherwise(0))
    return s.marks.select("session").join(_validated(s, made), "session", "left").select("session", F.coalesce("passed", F.lit(False)).alias("passed"))

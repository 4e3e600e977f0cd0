from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render
from ..operators import checks, scans
from ..sources import Store
from .registry import query
from .scan_queries import _VIEW


@query("pred_01", "SELECT event_type, role, source_hook, (event_type, role, source_hook) IN (('USER_MESSAGE','USER','ON_LLM_REQUEST'), ('ASSISTANT_MESSAGE','ASSISTANT','ON_AGENT_DONE')) AS legal, count(*) AS n FROM (SELECT event_type, CASE WHEN sequence % 7 = 0 THEN 'TOOL' ELSE role END AS role, source_hook FROM journal) GROUP BY ALL")
def pred_01(spark, sf_dir):
    spoiled = Store(spark, sf_dir).journal.withColumn("role", F.when(F.col("sequence") % 7 == 0, "TOOL").otherwise(F.col("role")))
    return spoiled.groupBy("event_type", "role", "source_hook", checks.legal_triple().alias("legal")).agg(F.count("*").alias("n"))


def _full_jobs(s: Store):
    """Jobs with the columns that the rules are about; every seventh session's is spoiled."""
    n = F.col("session")
    return s.jobs.select(
        "*",
        F.when(n % 3 != 0, F.concat(F.lit("snap-"), n)).alias("base_snapshot_id"),
        F.when(n % 3 != 0, n % 3).otherwise(F.when(n % 7 == 0, 1).otherwise(0)).alias("base_pointer_version"),
        F.when(F.col("state").isin("READY_TO_COMMIT", "COMMITTED", "SUPERSEDED"), F.lit("cand")).alias("candidate_snapshot_id"),
        F.when(F.col("error_code").isNotNull(), F.lit("COMPILING")).alias("error_stage"),
        F.when(F.col("error_code").isNotNull() & (n % 7 != 1), F.lit("timed out")).alias("error_message"),
        F.when(F.col("state") == "COMMITTED", F.col("created_at")).alias("committed_at"),
    )


@query("pred_02", """SELECT job_id, state,
  (error_code IS NULL OR session % 7 <> 1) AND (session % 3 <> 0 OR session % 7 <> 0) AS valid FROM jobs""")
def pred_02(spark, sf_dir):
    return _full_jobs(Store(spark, sf_dir)).select("job_id", "state", checks.job_conditionals().alias("valid"))


@query("pred_03", "SELECT snapshot_id, session % 4 <> 1 AND session % 5 <> 1 AS valid FROM snapshots")
def pred_03(spark, sf_dir):
    n = F.col("session")
    made = Store(spark, sf_dir).snapshots.select(
        "snapshot_id", F.lit("COMMITTED").alias("state"), F.when(n % 4 != 1, F.lit("2026-01-01")).alias("committed_at"), F.lit(True).alias("mechanical_passed"),
        F.when(n % 5 == 1, "failed").otherwise("passed").alias("semantic_status"), F.array().cast("array<string>").alias("failure_codes"),
    )
    return made.select("snapshot_id", checks.snapshot_state().alias("valid"))


@query("pred_04", "SELECT session, count(DISTINCT source) = count(source) AS all_distinct, count(source) AS n FROM items GROUP BY session")
def pred_04(spark, sf_dir):
    sources = Store(spark, sf_dir).items.groupBy("session").agg(F.collect_list("source").alias("s"))
    return sources.select("session", checks.distinct_array("s").alias("all_distinct"), F.size("s").cast("long").alias("n"))


@query("pred_05", "SELECT capsule_id, string_agg(item_id, ',' ORDER BY sequence, item_id) AS active FROM items WHERE status = 'active' AND kind <> 'dependency' GROUP BY capsule_id")
def pred_05(spark, sf_dir):
    items = Store(spark, sf_dir).items.filter("kind <> 'dependency'").groupBy("capsule_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "item_id", "status"))).alias("i"))
    active = F.transform(F.filter("i", lambda x: x["status"] == "active"), lambda x: x["item_id"])
    return items.select("capsule_id", F.array_join(active, ",").alias("active")).filter("active <> ''")


def _view(s: Store):
    return scans.request_view(s.journal, s.active)


@query("pred_06", f"SELECT DISTINCT session, CASE WHEN snapshot_id IS NULL AND (covered_event_end <> 0 OR pointer_version <> 0) THEN 'BOOTSTRAP_INVALID' WHEN snapshot_id IS NOT NULL AND pointer_version < 1 THEN 'POINTER_INVALID' WHEN snapshot_id IS NOT NULL AND covered_event_end > high_water THEN 'COVERAGE_BEYOND_HIGH_WATER' ELSE 'NONE' END AS error_code FROM ({_VIEW})")
def pred_06(spark, sf_dir):
    return checks.view_error(_view(Store(spark, sf_dir)))


@query("pred_07", f"SELECT session, min(sequence) = max(covered_event_end) + 1 AND max(sequence) = max(high_water) AND count(*) = max(high_water) - max(covered_event_end) AS contiguous FROM (SELECT * FROM ({_VIEW}) WHERE session % 5 <> 0 OR sequence % 3 <> 0) GROUP BY session")
def pred_07(spark, sf_dir):
    broken = _view(Store(spark, sf_dir)).filter("session % 5 <> 0 OR sequence % 3 <> 0")
    return checks.delta_contiguity(broken)


@query("pred_08", f"SELECT session, event_id, sequence FROM ({_VIEW})")
def pred_08(spark, sf_dir):
    view = _view(Store(spark, sf_dir))
    sound = checks.view_error(view).filter("error_code = 'NONE'").join(checks.delta_contiguity(view).filter("contiguous"), "session")
    return view.join(sound, "session", "left_semi").select("session", "event_id", "sequence")


@query("pred_09", "SELECT e.block_id, e.session FROM (SELECT kind || ':' || capsule_id || ':' || item_id AS block_id, session, sequence FROM items WHERE kind IN ('goal', 'constraint', 'anchor') AND status = 'active') e WHERE sequence % 4 = 3")
def pred_09(spark, sf_dir):
    block = F.concat_ws(":", "kind", "capsule_id", "item_id").alias("block_id")
    expected = Store(spark, sf_dir).items.filter("kind IN ('goal', 'constraint', 'anchor') AND status = 'active'").select(block, "session", "sequence")
    present = expected.filter("sequence % 4 <> 3").select("block_id")
    return checks.missing_sources(expected, present, "block_id").select("block_id", "session")


@query("pred_10", "SELECT session AS graph, sum(4) > 40 AS exceeds FROM items GROUP BY session")
def pred_10(spark, sf_dir):
    return checks.relation_entries_exceed(Store(spark, sf_dir).items.select(F.col("session").alias("graph"), F.lit(2).alias("n_terms")), 40)


@query("pred_11", "SELECT event_id, '[' || event_type || '/' || role || ' ' || event_id || ']' || chr(10) || content AS text FROM journal")
def pred_11(spark, sf_dir):
    return Store(spark, sf_dir).journal.select("event_id", render.raw_event().alias("text"))


@query("pred_12", """, l AS (SELECT capsule_id, sequence, item_id, list_position(['goal','constraint','progress','open_loop','preference','emotional_context','decision','entity','anchor'], kind) AS rank,
  CASE kind WHEN 'decision' THEN 'DECISION: ' || text WHEN 'entity' THEN 'ENTITY: ' || text || ' (topic)' WHEN 'anchor' THEN 'EXACT_QUOTE: ' || text ELSE upper(kind) || ': ' || text END || ' [source:' || source || ']' AS line
  FROM items WHERE status = 'active' AND kind <> 'dependency')
SELECT c.capsule_id, '[CAPSULE ' || c.capsule_id || ' EVENTS ' || covered_event_start || '-' || covered_event_end || ']' || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY rank, sequence, item_id), '') AS rendered
FROM capsules c LEFT JOIN l USING (capsule_id) GROUP BY c.capsule_id, covered_event_start, covered_event_end""")
def pred_12(spark, sf_dir):
    s = Store(spark, sf_dir)
    return render.render_capsules(s.capsules, s.items)


@query("pred_13", """SELECT capsule_id, string_agg(t, chr(10) ORDER BY rank) AS task_text FROM (
  SELECT i.capsule_id, list_position(['progress','open_loop','preference','emotional_context'], i.kind) AS rank,
    CASE i.kind WHEN 'progress' THEN 'Progress' WHEN 'open_loop' THEN 'Open loops' WHEN 'preference' THEN 'Preferences' ELSE 'Emotional context' END || ': ' || string_agg(text, ' | ' ORDER BY sequence) AS t
  FROM items i JOIN capsules c USING (capsule_id) WHERE level = 'task' AND i.kind IN ('progress','open_loop','preference','emotional_context') GROUP BY i.capsule_id, i.kind) GROUP BY capsule_id""")
def pred_13(spark, sf_dir):
    from ..operators.retrieval import task_texts

    s = Store(spark, sf_dir)
    return task_texts(s.capsules, s.items)


@query("pred_14", "SELECT item_id, contains(content, text) AS quoted FROM (SELECT i.item_id, CASE WHEN i.sequence % 3 = 0 THEN i.text || '#' ELSE i.text END AS text, j.content FROM items i JOIN journal j ON j.event_id = i.source WHERE i.kind = 'anchor')")
def pred_14(spark, sf_dir):
    s = Store(spark, sf_dir)
    quotes = s.items.filter("kind = 'anchor'").select("item_id", F.when(F.col("sequence") % 3 == 0, F.concat("text", F.lit("#"))).otherwise(F.col("text")).alias("text"), F.col("source").alias("event_id"))
    return quotes.join(s.journal.select("event_id", "content"), "event_id").select("item_id", F.contains("content", "text").alias("quoted"))


@query("pred_15", "SELECT b.job_id, count(j.event_id) = b.target - b.base_coverage AND b.target > b.base_coverage AS valid FROM jobs b LEFT JOIN journal j ON j.session = b.session AND j.sequence > b.base_coverage AND j.sequence <= b.target GROUP BY b.job_id, b.target, b.base_coverage")
def pred_15(spark, sf_dir):
    s = Store(spark, sf_dir)
    seen = scans.frozen_view(s.journal, s.jobs).groupBy("job_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return s.jobs.join(seen, "job_id", "left").select("job_id", ((n == F.col("target") - F.col("base_coverage")) & (F.col("target") > F.col("base_coverage"))).alias("valid"))


@query("pred_16", "SELECT session, count(*) FILTER (WHERE sequence % 6 = 5) AS differing FROM covered GROUP BY session")
def pred_16(spark, sf_dir):
    covered = Store(spark, sf_dir).covered.select("session", "sequence", "event_id")
    fitted = covered.withColumn("event_id", F.when(F.col("sequence") % 6 == 5, F.concat("event_id", F.lit("?"))).otherwise(F.col("event_id"))).withColumnRenamed("event_id", "fitted_id")
    both = covered.join(fitted, ["session", "sequence"], "full_outer")
    return both.groupBy("session").agg(F.count_if(~F.col("event_id").eqNullSafe(F.col("fitted_id"))).alias("differing"))


@query("pred_17", "SELECT i.item_id, i.source IN (SELECT event_id FROM covered c WHERE c.capsule_id = i.capsule_id AND c.sequence % 5 <> 2) AS contained FROM items i")
def pred_17(spark, sf_dir):
    s = Store(spark, sf_dir)
    outer = s.covered.groupBy("capsule_id").agg(F.collect_list(F.when(F.col("sequence") % 5 != 2, F.col("event_id"))).alias("all"))
    return s.items.join(outer, "capsule_id").select("item_id", checks.contained(F.array("source"), F.col("all")).alias("contained"))


@query("pred_18", "SELECT code, regexp_full_match(code, '[A-Z][A-Z0-9_]{0,63}') AS valid FROM (SELECT DISTINCT CASE WHEN session % 4 = 0 THEN lower(state) ELSE state END AS code FROM jobs)")
def pred_18(spark, sf_dir):
    code = F.when(F.col("session") % 4 == 0, F.lower("state")).otherwise(F.col("state")).alias("code")
    return Store(spark, sf_dir).jobs.select(code).distinct().select("code", F.col("code").rlike("^[A-Z][A-Z0-9_]{0,63}$").alias("valid"))


def ledger(s: Store):
    """A ledger over all items: dependencies and anchors stay, others are retained, shortened or released in turn."""
    n, kept = F.octet_length("text").cast("long"), F.col("kind").isin("anchor", "dependency")
    turn = (F.col("sequence") + F.length("item_id")) % 3
    status = F.when(kept, "retained").when(turn == 0, "retained").when(turn == 1, "approximate").otherwise("released")
    return s.items.select(
        "session", F.col("capsule_id").alias("source_capsule_id"), "kind", "item_id", status.alias("status"), n.alias("before_tokens"),
        F.when(status == "retained", n).when(status == "approximate", F.floor(n / 2)).otherwise(0).alias("after_tokens"), kept.alias("required"),
    )


LEDGER = """, ledger AS (SELECT session, capsule_id AS source_capsule_id, kind, item_id,
  CASE WHEN kind IN ('anchor','dependency') THEN 'retained' WHEN (sequence + length(item_id)) % 3 = 0 THEN 'retained' WHEN (sequence + length(item_id)) % 3 = 1 THEN 'approximate' ELSE 'released' END AS status,
  strlen(text)::BIGINT AS before_tokens, kind IN ('anchor','dependency') AS required FROM items),
led AS (SELECT *, CASE status WHEN 'retained' THEN before_tokens WHEN 'approximate' THEN before_tokens // 2 ELSE 0 END AS after_tokens FROM ledger)
"""


@query("pred_19", LEDGER + "SELECT source_capsule_id, kind, item_id FROM led WHERE kind IN ('goal', 'anchor') AND status <> 'retained' AND session % 2 = 0")
def pred_19(spark, sf_dir):
    spoiled = ledger(Store(spark, sf_dir)).withColumn("required", F.col("required") | ((F.col("kind") == "goal") & (F.col("session") % 2 == 0)))
    return checks.ledger_errors(spoiled).select("source_capsule_id", "kind", "item_id")

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, retrieval
from ..sources import Store
from ..sources.prelude import PROFILE
from .blocks_sql import BLOCKS, QUERY
from .registry import query


@query("join_01", "SELECT p.session, s.snapshot_id, pointer_version, covered_event_end FROM pointers p JOIN snapshots s USING (snapshot_id)")
def join_01(spark, sf_dir):
    s = Store(spark, sf_dir)
    return s.pointers.join(s.snapshots.select("snapshot_id", "covered_event_end"), "snapshot_id").select("session", "snapshot_id", "pointer_version", "covered_event_end")


@query("join_02", "SELECT p.session, s.snapshot_id AS base_snapshot_id, covered_event_end AS base_coverage FROM pointers p JOIN snapshots s USING (snapshot_id)")
def join_02(spark, sf_dir):
    s = Store(spark, sf_dir)
    base = s.pointers.select("session", "snapshot_id").join(s.snapshots.select("snapshot_id", "covered_event_end"), "snapshot_id")
    return base.select("session", F.col("snapshot_id").alias("base_snapshot_id"), F.col("covered_event_end").alias("base_coverage"))


@query("join_03", "SELECT snapshot_id, string_agg(capsule_id, ',' ORDER BY ordinal) AS capsule_ids, sum(token_cost)::BIGINT AS token_cost FROM memberships JOIN capsules USING (capsule_id) GROUP BY snapshot_id")
def join_03(spark, sf_dir):
    s = Store(spark, sf_dir)
    rows = s.memberships.join(s.capsules.select("capsule_id", "token_cost"), "capsule_id")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "capsule_id"))), lambda x: x["capsule_id"])
    return rows.groupBy("snapshot_id").agg(F.array_join(ids, ",").alias("capsule_ids"), F.sum("token_cost").alias("token_cost"))


@query("join_04", "SELECT job_id, state, high_water FROM jobs JOIN marks USING (session)")
def join_04(spark, sf_dir):
    s = Store(spark, sf_dir)
    return s.jobs.join(s.marks.select("session", "high_water"), "session").select("job_id", "state", "high_water")


@query("join_05", "SELECT snapshot_id, s.session, high_water - covered_event_end AS behind FROM snapshots s JOIN marks USING (session)")
def join_05(spark, sf_dir):
    s = Store(spark, sf_dir)
    return s.snapshots.join(s.marks.select("session", "high_water"), "session").select("snapshot_id", "session", (F.col("high_water") - F.col("covered_event_end")).alias("behind"))


_MISSING = f"""SELECT 0 AS kind_rank, sequence AS sort_major, 0 AS sort_minor, 'EVENT' AS artifact_kind, event_id AS artifact_id, session FROM journal j WHERE NOT EXISTS (SELECT 1 FROM metrics m WHERE m.artifact_kind = 'EVENT' AND m.artifact_id = j.event_id AND m.profile = '{PROFILE}')
UNION ALL SELECT 1, covered_event_end, covered_event_start, 'CAPSULE', capsule_id, session FROM capsules c WHERE NOT EXISTS (SELECT 1 FROM metrics m WHERE m.artifact_kind = 'CAPSULE' AND m.artifact_id = c.capsule_id AND m.profile = '{PROFILE}')
UNION ALL SELECT 2, covered_event_end, source_high_water_mark, 'SNAPSHOT', snapshot_id, session FROM snapshots s WHERE NOT EXISTS (SELECT 1 FROM metrics m WHERE m.artifact_kind = 'SNAPSHOT' AND m.artifact_id = s.snapshot_id AND m.profile = '{PROFILE}')"""
_MISSING = f"SELECT kind_rank::BIGINT AS kind_rank, sort_major::BIGINT AS sort_major, sort_minor::BIGINT AS sort_minor, artifact_kind, artifact_id, session FROM ({_MISSING})"


def missing(s: Store):
    zero = F.lit(0).cast("long")
    parts = [
        ("EVENT", s.journal.select("session", F.col("event_id").alias("artifact_id"), zero.alias("kind_rank"), F.col("sequence").alias("sort_major"), zero.alias("sort_minor"))),
        ("CAPSULE", s.capsules.select("session", F.col("capsule_id").alias("artifact_id"), (zero + 1).alias("kind_rank"), F.col("covered_event_end").alias("sort_major"), F.col("covered_event_start").alias("sort_minor"))),
        ("SNAPSHOT", s.snapshots.select("session", F.col("snapshot_id").alias("artifact_id"), (zero + 2).alias("kind_rank"), F.col("covered_event_end").alias("sort_major"), F.col("source_high_water_mark").alias("sort_minor"))),
    ]
    metrics = s.metrics
    out = [joins.without_metric(rows, metrics, kind, PROFILE) for kind, rows in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("kind_rank", "sort_major", "sort_minor", "artifact_kind", "artifact_id", "session")


@query("join_06", _MISSING)
def join_06(spark, sf_dir):
    return missing(Store(spark, sf_dir))


@query("set_01", f"SELECT artifact_kind, count(*) AS n FROM ({_MISSING}) GROUP BY artifact_kind")
def set_01(spark, sf_dir):
    return missing(Store(spark, sf_dir)).groupBy("artifact_kind").agg(F.count("*").alias("n"))


@query("join_07", f"""SELECT session, count(*) AS n FROM (
  SELECT j.session FROM metrics m JOIN journal j ON m.artifact_kind = 'EVENT' AND j.event_id = m.artifact_id WHERE m.profile = '{PROFILE}'
  UNION ALL SELECT c.session FROM metrics m JOIN capsules c ON m.artifact_kind = 'CAPSULE' AND c.capsule_id = m.artifact_id WHERE m.profile = '{PROFILE}') GROUP BY session""")
def join_07(spark, sf_dir):
    return owned_metrics(Store(spark, sf_dir)).groupBy("session").agg(F.count("*").alias("n"))


def owned_metrics(s: Store):
    owners = s.journal.select(F.lit("EVENT").alias("artifact_kind"), F.col("event_id").alias("artifact_id"), "session").unionByName(
        s.capsules.select(F.lit("CAPSULE").alias("artifact_kind"), F.col("capsule_id").alias("artifact_id"), "session")
    )
    return s.metrics.filter(F.col("profile") == PROFILE).join(owners, ["artifact_kind", "artifact_id"])


@query("join_08", "SELECT session, covered FROM marks WHERE session NOT IN (SELECT session FROM pointers)")
def join_08(spark, sf_dir):
    s = Store(spark, sf_dir)
    return s.marks.join(s.pointers, "session", "left_anti").select("session", "covered")


@query("join_09", "SELECT p.session, s.session AS snapshot_session FROM (SELECT session + CASE WHEN session % 10 = 3 THEN 1 ELSE 0 END AS session, snapshot_id FROM pointers) p JOIN snapshots s USING (snapshot_id) WHERE p.session <> s.session")
def join_09(spark, sf_dir):
    s = Store(spark, sf_dir)
    moved = s.pointers.select((F.col("session") + F.when(F.col("session") % 10 == 3, 1).otherwise(0)).alias("session"), "snapshot_id")
    both = moved.join(s.snapshots.select("snapshot_id", F.col("session").alias("snapshot_session")), "snapshot_id")
    return both.filter("session <> snapshot_session").select("session", "snapshot_session")


@query("join_10", "SELECT snapshot_id, max(ordinal) + 1 = count(*) AND count(DISTINCT capsule_id) = count(*) AS valid FROM memberships JOIN capsules USING (capsule_id) WHERE segment <> 1 OR session % 4 <> 0 GROUP BY snapshot_id")
def join_10(spark, sf_dir):
    s = Store(spark, sf_dir)
    rows = s.memberships.join(s.capsules.filter("segment <> 1 OR session % 4 <> 0").select("capsule_id"), "capsule_id")
    return rows.groupBy("snapshot_id").agg(((F.max("ordinal") + 1 == F.count("*")) & (F.count_distinct("capsule_id") == F.count("*"))).alias("valid"))


_PAIRS = """SELECT a.session, a.position AS i, b.position AS j,
  (CASE WHEN list_has_any(a.sources, b.sources) THEN 1.0 ELSE 0 END + CASE WHEN a.capsule_id = b.capsule_id THEN 0.75 ELSE 0 END
  + CASE WHEN a.kind = 'raw_event' AND b.kind = 'raw_event' AND abs(a.event_sequence - b.event_sequence) = 1 THEN 0.5 ELSE 0 END
  + CASE WHEN a.kind = b.kind THEN 0.25 ELSE 0 END + CASE WHEN a.slot = b.slot THEN 0.125 ELSE 0 END)::DOUBLE AS weight
FROM ordered a JOIN ordered b ON a.session = b.session AND a.position < b.position"""



_CAPPED = BLOCKS + f"SELECT session, i, j, weight FROM ({_PAIRS}) WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY i, j) <= 1024"


@query("join_11", _CAPPED)
@query("graph_02", _CAPPED)
def join_11(spark, sf_dir):
    return joins.relations(retrieval.session_blocks(Store(spark, sf_dir), QUERY)).select("session", "i", "j", "weight")


@query("join_12", BLOCKS + """SELECT DISTINCT a.session, a.block_id AS a, b.block_id AS b FROM ordered a JOIN ordered b ON a.session = b.session AND a.block_id <> b.block_id
WHERE a.kind = 'dependency' AND (a.capsule_id = b.capsule_id OR list_has_any(a.sources, b.sources))""")
def join_12(spark, sf_dir):
    return joins.companions(retrieval.session_blocks(Store(spark, sf_dir), QUERY))


@query("join_13", "SELECT i.item_id, j.event_id, strlen(j.content)::BIGINT AS bytes FROM items i JOIN journal j ON j.event_id = i.source WHERE i.kind = 'decision'")
def join_13(spark, sf_dir):
    s = Store(spark, sf_dir)
    found = s.items.filter("kind = 'decision'").select("item_id", F.col("source").alias("event_id")).join(s.journal.select("event_id", "content"), "event_id")
    return found.select("item_id", "event_id", F.octet_length("content").cast("long").alias("bytes"))


@query("join_14", "SELECT item_id, session FROM items WHERE status = 'active' AND sequence % 7 = 2")
def join_14(spark, sf_dir):
    previous = Store(spark, sf_dir).items.filter("status = 'active'")
    candidate = previous.filter("sequence % 7 <> 2").select("item_id")
    return previous.join(candidate, "item_id", "left_anti").select("item_id", "session")


_TOOLS = "SELECT session, sequence, CASE WHEN sequence % 2 = 1 THEN 'TOOL_CALL' ELSE 'TOOL_RESULT' END AS event_type, 'tool' || session % 3 AS tool, (sequence + 1) // 2 // 2 AS arguments FROM journal"


@query("join_15", f"SELECT session, tool, arguments, pending FROM (SELECT session, tool, arguments, sum(CASE event_type WHEN 'TOOL_CALL' THEN 1 ELSE -1 END)::BIGINT AS pending FROM ({_TOOLS}) GROUP BY ALL) WHERE pending > 0")
@query("agg_12", f"SELECT session, tool, arguments, pending FROM (SELECT session, tool, arguments, sum(CASE event_type WHEN 'TOOL_CALL' THEN 1 ELSE -1 END)::BIGINT AS pending FROM ({_TOOLS}) GROUP BY ALL) WHERE pending > 0")
def join_15(spark, sf_dir):
    n = F.col("sequence")
    tools = Store(spark, sf_dir).journal.select(
        "session", F.when(n % 2 == 1, "TOOL_CALL").otherwise("TOOL_RESULT").alias("event_type"), F.concat(F.lit("tool"), F.col("session") % 3).alias("tool"), F.floor(F.floor((n + 1) / 2) / 2).alias("arguments")
    )
    return joins.pending_tools(tools)

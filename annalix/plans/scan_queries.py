from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans
from ..sources import Store, read
from ..sources.prelude import PROFILE
from .registry import query

EVENT = ["session", "event_id", "sequence", "event_type", "token_count"]


@query("scan_01", "SELECT session, event_id, sequence, event_type, token_count FROM journal WHERE sequence > 1 AND sequence <= 4")
def scan_01(spark, sf_dir):
    return scans.event_range(Store(spark, sf_dir).journal, 1, 4).select(EVENT)


_VIEW = """SELECT m.session, p.snapshot_id, coalesce(p.pointer_version, 0) AS pointer_version, coalesce(s.covered_event_end, 0) AS covered_event_end,
m.high_water, j.event_id, j.sequence FROM marks m LEFT JOIN pointers p USING (session) LEFT JOIN snapshots s ON s.snapshot_id = p.snapshot_id
JOIN journal j ON j.session = m.session AND j.sequence > coalesce(s.covered_event_end, 0)"""


@query("scan_02", _VIEW)
@query("scan_03", _VIEW)
def scan_02(spark, sf_dir):
    s = Store(spark, sf_dir)
    view = scans.request_view(s.journal, s.active)
    return view.select("session", "snapshot_id", "pointer_version", "covered_event_end", "high_water", "event_id", "sequence")


_FROZEN = "SELECT b.job_id, j.session, j.event_id, j.sequence FROM jobs b JOIN journal j ON j.session = b.session AND j.sequence > b.base_coverage AND j.sequence <= b.target"


@query("scan_04", _FROZEN)
@query("scan_05", _FROZEN)
def scan_04(spark, sf_dir):
    s = Store(spark, sf_dir)
    return scans.frozen_view(s.journal, s.jobs).select("job_id", "session", "event_id", "sequence")


@query("scan_07", "SELECT job_id, state, target, intent FROM jobs WHERE job_id = 'job-7'")
def scan_07(spark, sf_dir):
    return Store(spark, sf_dir).jobs.filter(F.col("job_id") == "job-7").select("job_id", "state", "target", "intent")


@query("scan_08", "SELECT event_id, sequence FROM journal WHERE session = 3 AND source_hook = 'ON_LLM_REQUEST' AND idempotency_key = '3:0'")
def scan_08(spark, sf_dir):
    found = Store(spark, sf_dir).journal.filter((F.col("session") == 3) & (F.col("source_hook") == "ON_LLM_REQUEST") & (F.col("idempotency_key") == "3:0"))
    return found.select("event_id", "sequence")


@query("scan_09", "SELECT event_id, session, sequence FROM journal WHERE event_id > '2' ORDER BY event_id LIMIT 128")
def scan_09(spark, sf_dir):
    return scans.page(Store(spark, sf_dir).journal.select("event_id", "session", "sequence"), "event_id", "2")


@query("scan_10", "SELECT artifact_kind, artifact_id, profile, token_count FROM metrics WHERE artifact_id > '3' ORDER BY artifact_id LIMIT 128")
def scan_10(spark, sf_dir):
    return scans.page(Store(spark, sf_dir).metrics, "artifact_id", "3")


@query("scan_11", f"SELECT j.event_id, m.token_count AS stored_count FROM journal j JOIN metrics m ON m.artifact_kind = 'EVENT' AND m.artifact_id = j.event_id AND m.profile = '{PROFILE}'")
def scan_11(spark, sf_dir):
    s = Store(spark, sf_dir)
    return scans.metric_counts(s.journal.select("event_id"), s.metrics, "EVENT", PROFILE)


@query("scan_12", "SELECT session, max(sequence) AS latest, count(*) FILTER (WHERE sequence > 2) AS later, count(*) FILTER (WHERE sequence BETWEEN 2 AND 4) AS inside FROM journal GROUP BY session")
def scan_12(spark, sf_dir):
    n = F.col("sequence")
    return Store(spark, sf_dir).journal.groupBy("session").agg(F.max(n).alias("latest"), F.count_if(n > 2).alias("later"), F.count_if(n.between(2, 4)).alias("inside"))


@query("scan_13", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, (props->>'k')::BIGINT AS k FROM events")
def scan_13(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.from_json("props", "k long", {"mode": "FAILFAST"})["k"].alias("k"))

"""Queries that publish versions of tables and read them as of one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, jobs, scans
from ..sources import Store, StoredJournal
from ..sources.scratch import scratch
from ..sources.versions import Versions
from .composite_queries import candidates
from .registry import query


def _published(spark, s: Store) -> tuple[Versions, int]:
    """Every session's snapshot in a first version, and in a second one three proposals a session: (store, second version)."""
    store = Versions(spark, scratch(spark, "published"))
    first = s.pointers.join(s.snapshots.select("session", "covered_event_end"), "session")
    store.commit(0, append={"snapshots": first.select("session", "snapshot_id", "covered_event_end")}, replace={"pointers": first.select("session", "snapshot_id", "pointer_version")})
    audited = s.marks.filter("covered >= 3")
    proposals = s.pointers.join(audited, "session").select("session", F.explode(F.array(*map(F.lit, "bac"))).alias("k"), "pointer_version", "high_water")
    proposals = proposals.select("session", F.concat(F.lit("next-"), "k", F.lit("-"), "session").alias("snapshot_id"), (F.col("pointer_version") - F.when(F.col("k") == "c", 1).otherwise(0)).alias("expected"), F.col("high_water").alias("covered_event_end"))
    members = proposals.join(s.capsules.select("session", "capsule_id"), "session").select("session", "snapshot_id", "capsule_id")
    version, _ = jobs.publish_all(store, proposals, audit.validate(candidates(s)).select("session", "passed"), {"memberships": members})
    return store, version


@query("sink_15_versions", """SELECT p.session, CASE WHEN won THEN 'next-a-' || p.session ELSE p.snapshot_id END AS snapshot_id, pointer_version + won::INT AS pointer_version,
 CASE WHEN won THEN (SELECT count(*) FROM capsules c WHERE c.session = p.session) ELSE 0 END AS members
FROM (SELECT p.*, m.covered >= 3 AND p.session % 19 IN (0, 18) AS won FROM pointers p JOIN marks m USING (session)) p""")
def sink_15_versions(spark, sf_dir):
    """The pointers after a publication of all sessions at once, and how many memberships each active snapshot brought."""
    store, _ = _published(spark, Store(spark, sf_dir))
    members = store.read("memberships").groupBy("session", "snapshot_id").agg(F.count("*").alias("members"))
    return store.read("pointers").join(members, ["session", "snapshot_id"], "left").select("session", "snapshot_id", "pointer_version", F.coalesce("members", F.lit(0)).alias("members"))


@query("scan_03_asof", """SELECT m.session, p.snapshot_id, coalesce(p.pointer_version, 0) AS pointer_version, coalesce(s.covered_event_end, 0) AS covered_event_end, m.high_water, j.event_id, j.sequence
FROM marks m LEFT JOIN pointers p USING (session) LEFT JOIN snapshots s ON s.snapshot_id = p.snapshot_id JOIN journal j ON j.session = m.session AND j.sequence > coalesce(s.covered_event_end, 0)""")
def scan_03_asof(spark, sf_dir):
    """The request view as of the version before a publication, read after it."""
    s = Store(spark, sf_dir)
    store, version = _published(spark, s)
    pointers, snapshots = store.read("pointers", version - 1), store.read("snapshots", version - 1)
    active = pointers.join(snapshots.select("snapshot_id", "covered_event_end"), "snapshot_id")
    return scans.request_view(s.journal, active).select("session", "snapshot_id", "pointer_version", "covered_event_end", "high_water", "event_id", "sequence")


@query("sink_01_stored", "SELECT session, event_id, sequence, content FROM journal UNION ALL SELECT session, 'new-' || session, high_water + 1, 'more' FROM marks")
def sink_01_stored(spark, sf_dir):
    """A journal that is stored in three appends: half of each session, all of it with the half sent again, and one more event a session twice."""
    s = Store(spark, sf_dir)
    kept = StoredJournal(spark, scratch(spark, "stored-journal"))
    rows = s.journal.withColumn("arrival", F.col("sequence"))
    half = rows.join(s.marks.select("session", "covered"), "session").filter("sequence <= covered").drop("covered")
    kept.append(half.drop("sequence"))
    kept.append(rows.drop("sequence"))
    last = s.marks.select("session", F.concat(F.lit("new-"), "session").alias("event_id"), F.lit("USER_MESSAGE").alias("event_type"), F.lit("USER").alias("role"), F.lit("more").alias("content"), F.lit("ON_LLM_REQUEST").alias("source_hook"), F.concat(F.lit("new-"), "session").alias("idempotency_key"), F.lit(4).cast("long").alias("token_count"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("arrival"))
    kept.append(last)
    return kept.table.select("session", "event_id", "sequence", "content")

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs, mutations
from ..operators.checks import gaps
from ..sources import Store
from ..sources.prelude import NOW, OPEN_STATES, PROFILE
from .predicate_queries import LEDGER, ledger
from .registry import query


def _arrivals(s: Store):
    """A batch: the last two events of each session again (replays), and two new ones, the second sent twice."""
    j = s.journal.join(s.marks.select("session", "high_water"), "session")
    key = ["session", "source_hook", "idempotency_key", "content"]
    replays = j.filter("sequence > high_water - 2").select(*key, F.col("sequence").alias("arrival"))
    new = s.marks.select("session", F.lit("ON_LLM_REQUEST").alias("source_hook"), F.explode(F.array(*[F.struct(F.concat(F.lit(f"new-{k}-"), "session").alias("idempotency_key"), F.lit(f"text {k}").alias("content"), F.lit(100 + n).cast("long").alias("arrival")) for n, k in enumerate((1, 2, 2))])).alias("e"))
    return replays.unionByName(new.select("session", "source_hook", "e.*"))


_CAPTURE = "SELECT session, 'new-' || k || '-' || session AS idempotency_key, high_water + k AS sequence FROM marks, (VALUES (1), (2)) t(k)"


@query("sink_02", """SELECT session, event_type, role, source_hook, high_water + n AS sequence FROM marks,
 (VALUES ('USER_MESSAGE', 'USER', 'ON_LLM_REQUEST', 1), ('TOOL_CALL', 'TOOL', 'ON_USING_LLM_TOOL', 2), ('TOOL_RESULT', 'TOOL', 'ON_LLM_TOOL_RESPOND', 3), ('ASSISTANT_MESSAGE', 'ASSISTANT', 'ON_AGENT_DONE', 4)) t(event_type, role, source_hook, n)""")
def sink_02(spark, sf_dir):
    """A turn through the four typed entry points, each event sent twice: one event each, in order of arrival."""
    s = Store(spark, sf_dir)
    batch = None
    for n, point in enumerate(("user", "tool_call", "tool_result", "assistant")):
        sent = s.marks.select("session", F.concat(F.lit(f"turn-{point}-"), "session").alias("idempotency_key"), F.explode(F.array(F.lit(10 + n), F.lit(20 + n))).alias("arrival"))
        sent = mutations.typed(sent, point)
        batch = sent if batch is None else batch.unionByName(sent)
    return mutations.capture(s.journal, batch).select("session", "event_type", "role", "source_hook", F.col("sequence").cast("long").alias("sequence"))


@query("sink_01", _CAPTURE)
def sink_01(spark, sf_dir):
    s = Store(spark, sf_dir)
    return mutations.capture(s.journal, _arrivals(s)).select("session", "idempotency_key", F.col("sequence").cast("long").alias("sequence"))


@query("sink_03", "SELECT DISTINCT user_id AS session FROM events WHERE user_id NOT IN (SELECT session FROM journal)")
def sink_03(spark, sf_dir):
    s = Store(spark, sf_dir)
    return s.activity.select("session").distinct().join(s.marks, "session", "left_anti")


@query("sink_04", "SELECT session, source_hook, idempotency_key FROM journal WHERE sequence % 4 = 1")
def sink_04(spark, sf_dir):
    j = Store(spark, sf_dir).journal.select(*mutations.KEY, "content", "sequence")
    changed = j.withColumn("content", F.when(F.col("sequence") % 4 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return mutations.replay_conflicts(j.unionByName(changed), mutations.KEY, ["content"]).select(*mutations.KEY)


def _put(s: Store):
    new = s.journal.select(F.lit("EVENT").alias("artifact_kind"), F.col("event_id").alias("artifact_id"), F.lit(PROFILE).alias("profile"), (F.col("token_count") + F.when(F.col("sequence") == 2, 1).otherwise(0)).alias("token_count"))
    return mutations.put_metrics(s.metrics, new)


@query("sink_05", "SELECT event_id AS artifact_id, CASE WHEN session % 2 = 1 THEN 'INSERT' ELSE 'CONFLICT' END AS action FROM journal WHERE session % 2 = 1 OR sequence = 2")
def sink_05(spark, sf_dir):
    new, bad = _put(Store(spark, sf_dir))
    return new.select("artifact_id", F.lit("INSERT").alias("action")).unionByName(bad.select("artifact_id", F.lit("CONFLICT").alias("action")))


@query("sink_06", f"SELECT artifact_id, token_count FROM metrics WHERE artifact_kind = 'CAPSULE' AND profile = '{PROFILE}'")
def sink_06(spark, sf_dir):
    return Store(spark, sf_dir).metrics.filter((F.col("artifact_kind") == "CAPSULE") & (F.col("profile") == PROFILE)).select("artifact_id", "token_count")


@query("sink_07", "SELECT event_id AS artifact_id, CASE WHEN sequence % 2 = 0 THEN 'METRIC' ELSE 'INTENT' END AS target FROM journal WHERE sequence % 2 = 0 OR NOT (session % 2 = 1 AND session % 3 = 0)")
def sink_07(spark, sf_dir):
    s = Store(spark, sf_dir)
    seen = s.journal.select(F.lit("EVENT").alias("artifact_kind"), F.col("event_id").alias("artifact_id"), F.lit(PROFILE).alias("profile"), "session", F.when(F.col("sequence") % 2 == 0, F.col("token_count")).alias("token_count"))
    metrics, intents = mutations.observations(seen, s.intents)
    return metrics.select("artifact_id", F.lit("METRIC").alias("target")).unionByName(intents.select("artifact_id", F.lit("INTENT").alias("target")))


@query("sink_08", "SELECT event_id AS artifact_id FROM journal WHERE session % 2 = 1 AND session % 3 = 0 AND sequence % 2 = 1")
def sink_08(spark, sf_dir):
    """Intents left after the counts of even events were written."""
    s = Store(spark, sf_dir)
    written = s.journal.filter("sequence % 2 = 0").select(F.col("event_id").alias("artifact_id"))
    return s.intents.join(written, "artifact_id", "left_anti").select("artifact_id")


_OPEN = ", ".join(f"'{x}'" for x in OPEN_STATES)


@query("sink_09", f"""SELECT job_id, state, intent FROM (SELECT job_id, state, CASE WHEN state IN ({_OPEN}) AND session % 4 = 0 AND target + 2 > intent THEN target + 2 ELSE intent END AS intent FROM jobs)
UNION ALL SELECT 'job-new-' || session, 'PENDING', target + 2 FROM jobs WHERE session % 4 = 0 AND state NOT IN ({_OPEN})""")
def sink_09(spark, sf_dir):
    s = Store(spark, sf_dir)
    raised = s.jobs.filter("session % 4 = 0").select("session", F.explode(F.array(F.col("target") + 1, F.col("target") + 2)).alias("target"), "base_coverage")
    return jobs.raise_intents(s.jobs, raised, NOW).select("job_id", "state", "intent")


@query("sink_10", f"""SELECT job_id, CASE WHEN won THEN 'LEASED' ELSE state END AS state, CASE WHEN won THEN 'worker-x' ELSE lease_owner END AS lease_owner, lease_epoch + won::INT AS lease_epoch, attempt_count + won::INT AS attempt_count
FROM (SELECT *, job_id = (SELECT job_id FROM jobs WHERE (state = 'PENDING' OR (state = 'RETRY_WAIT' AND next_retry_at <= '{NOW}')) AND intent > base_coverage ORDER BY created_at, job_id LIMIT 1) AS won FROM jobs)""")
def sink_10(spark, sf_dir):
    return jobs.claim(Store(spark, sf_dir).jobs, "worker-x", NOW, "2026-01-03T00:00:00.000000Z").select("job_id", "state", "lease_owner", "lease_epoch", "attempt_count")


@query("sink_11", f"SELECT job_id, CASE WHEN state = 'LEASED' AND lease_owner = 'worker-1' AND lease_epoch = 2 AND lease_expires_at > '2026-01-01T12:00:00.000000Z' THEN 'COMPILING' ELSE state END AS state FROM jobs")
def sink_11(spark, sf_dir):
    return jobs.transition(Store(spark, sf_dir).jobs, "worker-1", 2, "2026-01-01T12:00:00.000000Z", "COMPILING").select("job_id", "state")


@query("sink_12", "SELECT job_id, CASE WHEN lease_owner = 'worker-1' AND lease_epoch = 2 AND lease_expires_at > '2026-01-01T12:00:00.000000Z' AND lease_expires_at < '2026-01-05T00:00:00.000000Z' THEN '2026-01-05T00:00:00.000000Z' ELSE lease_expires_at END AS lease_expires_at FROM jobs")
def sink_12(spark, sf_dir):
    return jobs.renew(Store(spark, sf_dir).jobs, "worker-1", 2, "2026-01-01T12:00:00.000000Z", "2026-01-05T00:00:00.000000Z").select("job_id", "lease_expires_at")


@query("sink_13", f"SELECT job_id, CASE WHEN hit THEN 'RETRY_WAIT' ELSE state END AS state, CASE WHEN hit THEN greatest(attempt_count - 1, 0) ELSE attempt_count END AS attempt_count, CASE WHEN hit THEN 'PROVIDER' ELSE error_code END AS error_code FROM (SELECT *, coalesce(lease_owner = 'worker-2' AND lease_expires_at > '{NOW}', false) AS hit FROM jobs)")
def sink_13(spark, sf_dir):
    return jobs.fail(Store(spark, sf_dir).jobs, "worker-2", NOW, "PROVIDER", "2026-01-04T00:00:00.000000Z", True).select("job_id", "state", "attempt_count", "error_code")


@query("sink_14", f"SELECT job_id, CASE WHEN coalesce(lease_expires_at <= '{NOW}', false) THEN 'PENDING' ELSE state END AS state, CASE WHEN coalesce(lease_expires_at <= '{NOW}', false) THEN NULL ELSE lease_owner END AS lease_owner FROM jobs")
def sink_14(spark, sf_dir):
    return jobs.recover(Store(spark, sf_dir).jobs, NOW).select("job_id", "state", "lease_owner")


@query("sink_17", "SELECT capsule_id, CASE WHEN segment % 3 = 0 THEN 'INSERT' WHEN segment % 3 = 1 THEN 'VERIFIED' ELSE 'CONFLICT' END AS action FROM capsules")
def sink_17(spark, sf_dir):
    c = Store(spark, sf_dir).capsules.select("capsule_id", "segment", "level", "token_cost")
    stored = c.filter("segment % 3 <> 0").withColumn("token_cost", F.col("token_cost") + F.when(F.col("segment") % 3 == 2, 1).otherwise(0))
    return mutations.insert_or_verify(stored, c, "capsule_id", F.to_json(F.struct("capsule_id", "level", "token_cost")))


@query("sink_19", f"""SELECT job_id, CASE WHEN state = 'READY_TO_COMMIT' AND lease_expires_at > '{NOW}' THEN CASE WHEN p.pointer_version = lease_epoch THEN 'COMMITTED' ELSE 'SUPERSEDED' END ELSE state END AS state,
 CASE WHEN state = 'READY_TO_COMMIT' AND lease_expires_at > '{NOW}' THEN NULL ELSE lease_owner END AS lease_owner FROM jobs LEFT JOIN pointers p USING (session)""")
def sink_19(spark, sf_dir):
    """Ready jobs propose the version after that of their lease's epoch; the swap decides, and only live leases end."""
    s = Store(spark, sf_dir)
    ready = s.jobs.filter("state = 'READY_TO_COMMIT'")
    proposals = ready.select("session", F.concat(F.lit("by-"), "job_id").alias("snapshot_id"), F.col("lease_epoch").alias("expected"))
    outcomes = mutations.swap_pointers(s.pointers, proposals).select(F.substring("snapshot_id", 4, 1 << 20).alias("job_id"), "outcome")
    return jobs.finish(s.jobs, outcomes, NOW).select("job_id", "state", "lease_owner")


@query("sink_20", "SELECT 'followup-' || left(sha256(job_id || chr(0) || 'snap-' || session || chr(0) || (session % 3 + 1) || chr(0) || intent), 32) AS job_id, session, intent AS target FROM jobs WHERE intent > target")
def sink_20(spark, sf_dir):
    done = Store(spark, sf_dir).jobs.select("session", "job_id", F.concat(F.lit("snap-"), "session").alias("snapshot_id"), (F.col("session") % 3 + 1).alias("pointer_version"), "intent", F.col("target").alias("covered"))
    return jobs.follow_ups(done)


@query("sink_21", f"SELECT job_id, coalesce(lease_owner = 'worker-1' AND lease_epoch = 2 AND lease_expires_at > '{NOW}', false) AS live FROM jobs")
def sink_21(spark, sf_dir):
    return Store(spark, sf_dir).jobs.select("job_id", jobs.live_fence("worker-1", 2, NOW).alias("live"))


@query("sink_22", "SELECT snapshot_id, max(ordinal) + 1 = count(*) AS dense, count(DISTINCT capsule_id) = count(*) AS distinct_ids FROM (SELECT snapshot_id, capsule_id, ordinal + (ordinal >= 2)::INT AS ordinal FROM memberships) GROUP BY snapshot_id")
def sink_22(spark, sf_dir):
    """Memberships that skip an ordinal after the second are not dense."""
    rows = Store(spark, sf_dir).memberships.withColumn("ordinal", F.col("ordinal") + F.when(F.col("ordinal") >= 2, 1).otherwise(0))
    return rows.groupBy("snapshot_id").agg((F.max("ordinal") + 1 == F.count("*")).alias("dense"), (F.count_distinct("capsule_id") == F.count("*")).alias("distinct_ids"))


@query("sink_24", "SELECT event_id, content, true AS bound FROM journal")
def sink_24(spark, sf_dir):
    """Encrypted and decrypted again; another record's key does not open a cell."""
    secret = F.unhex(F.sha2(F.lit("test key"), 256))
    iv = F.unhex(F.substring(F.sha2("event_id", 256), 1, 24))
    rows = Store(spark, sf_dir).journal.select("event_id", mutations.encrypt(F.col("content"), "journal", "content", F.col("event_id"), secret, iv).alias("cell"))
    other = F.try_aes_decrypt(F.unbase64("cell"), secret, F.lit("GCM"), F.lit("DEFAULT"), F.lit("journal\0content\0elsewhere"))
    return rows.select("event_id", mutations.decrypt(F.col("cell"), "journal", "content", F.col("event_id"), secret).alias("content"), other.isNull().alias("bound"))


@query("sink_25", "SELECT event_id, token_count FROM journal")
def sink_25(spark, sf_dir):
    """The typed form for non-negative integers."""
    secret = F.unhex(F.sha2(F.lit("test key"), 256))
    iv = F.unhex(F.substring(F.sha2("event_id", 256), 1, 24))
    cell = mutations.encrypt(F.col("token_count").cast("string"), "journal", "token_count", F.col("event_id"), secret, iv)
    back = mutations.decrypt(F.col("cell"), "journal", "token_count", F.col("event_id"), secret).cast("long")
    return Store(spark, sf_dir).journal.select("event_id", cell.alias("cell")).select("event_id", back.alias("token_count"))


@query("sink_27", "SELECT 'membership_without_capsule' AS fault, 0::BIGINT AS n UNION ALL SELECT 'gap', count(*) FROM (SELECT sequence, lag(sequence) OVER (PARTITION BY session ORDER BY sequence) AS p FROM journal WHERE sequence <> 2) WHERE sequence <> p + 1 UNION ALL SELECT 'pointer_without_snapshot', count(*) FROM pointers WHERE session % 6 = 0")
def sink_27(spark, sf_dir):
    s = Store(spark, sf_dir)
    named = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")
    return (
        named(s.memberships.join(s.capsules, "capsule_id", "left_anti"), "membership_without_capsule")
        .unionByName(named(gaps(s.journal.filter("sequence <> 2")), "gap"))
        .unionByName(named(s.pointers.join(s.snapshots.filter("session % 6 <> 0"), "snapshot_id", "left_anti"), "pointer_without_snapshot"))
    )


@query("sink_28", "SELECT session, bool_and(sequence > p OR p IS NULL) AS increasing FROM (SELECT session, sequence, lag(sequence) OVER (PARTITION BY session ORDER BY event_id) AS p FROM journal) GROUP BY session")
def sink_28(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("sequence").over(Window.partitionBy("session").orderBy("event_id"))
    rows = Store(spark, sf_dir).journal.withColumn("p", before)
    return rows.groupBy("session").agg(F.bool_and(F.col("p").isNull() | (F.col("sequence") > F.col("p"))).alias("increasing"))


@query("scan_06", LEDGER + "SELECT item_id, status, before_tokens, after_tokens, row_number() OVER (ORDER BY source_capsule_id, kind, item_id) - 1 AS ordinal FROM led WHERE session = 7")
def scan_06(spark, sf_dir):
    """One snapshot's ledger in ordinal order."""
    from pyspark.sql import Window

    rows = ledger(Store(spark, sf_dir)).filter("session = 7")
    n = F.row_number().over(Window.partitionBy("session").orderBy("source_capsule_id", "kind", "item_id")).cast("long") - 1
    return rows.select("item_id", "status", "before_tokens", "after_tokens", n.alias("ordinal"))

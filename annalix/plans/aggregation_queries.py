from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, retrieval
from ..sources import Store
from ..sources.prelude import OPEN_STATES, PROFILE
from .blocks_sql import BLOCKS, QUERY
from .predicate_queries import LEDGER, ledger
from .registry import query


@query("agg_01", "SELECT s.session, t.event_type, count(j.event_id) AS n FROM marks s CROSS JOIN (VALUES ('USER_MESSAGE'), ('ASSISTANT_MESSAGE'), ('TOOL_CALL'), ('TOOL_RESULT')) t(event_type) LEFT JOIN journal j ON j.session = s.session AND j.event_type = t.event_type GROUP BY s.session, t.event_type")
def agg_01(spark, sf_dir):
    return aggregates.session_event_counts(Store(spark, sf_dir).journal)


_OPEN = ", ".join(f"'{s}'" for s in OPEN_STATES)
_STATUS = f"SELECT (SELECT count(*) FROM journal) AS events, (SELECT count(*) FROM snapshots) AS snapshots, (SELECT count(*) FROM jobs WHERE state IN ({_OPEN})) AS open_jobs, (SELECT count(*) FROM metrics WHERE profile = '{PROFILE}') AS metrics, (SELECT count(*) FROM intents) AS intents"


@query("agg_02", _STATUS)
@query("obs_02", _STATUS)
def agg_02(spark, sf_dir):
    s = Store(spark, sf_dir)
    one = [
        s.journal.agg(F.count("*").alias("events")), s.snapshots.agg(F.count("*").alias("snapshots")), s.jobs.agg(F.count_if(F.col("state").isin(*OPEN_STATES)).alias("open_jobs")),
        s.metrics.filter(F.col("profile") == PROFILE).agg(F.count("*").alias("metrics")), s.intents.agg(F.count("*").alias("intents")),
    ]
    rows = [r.select(F.lit(k).alias("k"), F.col(r.columns[0]).alias("n")) for k, r in enumerate(one)]
    stacked = rows[0]
    for r in rows[1:]:
        stacked = stacked.unionByName(r)
    return stacked.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(r.columns[0]) for k, r in enumerate(one)])


@query("agg_03", "SELECT session, max(sequence) AS high_water, max(sequence) + 1 AS next_sequence, max(sequence) = count(*) AS dense FROM journal GROUP BY session")
def agg_03(spark, sf_dir):
    top = F.coalesce(F.max("sequence"), F.lit(0))
    return Store(spark, sf_dir).journal.groupBy("session").agg(top.alias("high_water"), (top + 1).alias("next_sequence"), (top == F.count("*")).alias("dense"))


_TABLES = ("journal", "capsules", "snapshots", "memberships", "pointers", "jobs", "metrics", "intents")


@query("agg_04", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def agg_04(spark, sf_dir):
    s, out = Store(spark, sf_dir), None
    for t in _TABLES:
        part = getattr(s, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("agg_05", "SELECT slot, count(*) AS n FROM memberships GROUP BY slot")
def agg_05(spark, sf_dir):
    return Store(spark, sf_dir).memberships.groupBy("slot").agg(F.count("*").alias("n"))


@query("agg_06", "SELECT event_id, session, sequence, copy > 1 AS duplicate FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY src) AS copy FROM (SELECT *, 0 AS src FROM journal UNION ALL SELECT *, 1 FROM journal WHERE sequence % 3 = 0))")
def agg_06(spark, sf_dir):
    journal = Store(spark, sf_dir).journal.select("event_id", "session", "sequence")
    twice = journal.withColumn("src", F.lit(0)).unionByName(journal.filter("sequence % 3 = 0").withColumn("src", F.lit(1)))
    return aggregates.first_by_key(twice, ["event_id"], ["src"]).select("event_id", "session", "sequence", "duplicate")


@query("agg_07", BLOCKS + "SELECT session, slot, sum(strlen(text))::BIGINT AS tokens FROM ordered GROUP BY session, slot")
def agg_07(spark, sf_dir):
    return retrieval.session_blocks(Store(spark, sf_dir), QUERY).groupBy("session", "slot").agg(F.sum(F.octet_length("text")).alias("tokens"))


@query("agg_08", LEDGER + """SELECT session, count(*) FILTER (WHERE status = 'retained') AS retained, count(*) FILTER (WHERE status = 'approximate') AS approximate, count(*) FILTER (WHERE status = 'released') AS released,
 count(*) FILTER (WHERE status <> 'retained') AS loss, sum(before_tokens)::BIGINT AS before_tokens, sum(after_tokens)::BIGINT AS after_tokens, coalesce(sum(after_tokens)::DOUBLE / nullif(sum(before_tokens), 0)::DOUBLE, 1.0) AS compression_ratio FROM led GROUP BY session""")
def agg_08(spark, sf_dir):
    return aggregates.ledger_summary(ledger(Store(spark, sf_dir)))


@query("agg_09", """SELECT session, coalesce(count(*) FILTER (WHERE status = 'active' AND sequence % 7 <> 2)::DOUBLE / nullif(count(*) FILTER (WHERE status = 'active'), 0), 1.0) AS source_coverage,
 coalesce(count(*) FILTER (WHERE kind = 'anchor' AND sequence % 5 <> 3)::DOUBLE / nullif(count(*) FILTER (WHERE kind = 'anchor'), 0), 1.0) AS anchor_recall FROM items GROUP BY session""")
def agg_09(spark, sf_dir):
    n, active, anchor = F.col("sequence"), F.col("status") == "active", F.col("kind") == "anchor"
    return Store(spark, sf_dir).items.groupBy("session").agg(
        aggregates.safe_ratio(F.count_if(active & (n % 7 != 2)), F.count_if(active), 1.0).alias("source_coverage"),
        aggregates.safe_ratio(F.count_if(anchor & (n % 5 != 3)), F.count_if(anchor), 1.0).alias("anchor_recall"),
    )


@query("agg_10", "SELECT c.session, min(covered_event_start) AS start, max(covered_event_end) AS end, arg_max(level, list_position(['micro','episode','task','global'], level)) AS level, any_value(s.ids) AS source_event_ids FROM capsules c JOIN (SELECT session, string_agg(DISTINCT source, ',' ORDER BY source) AS ids FROM items GROUP BY session) s USING (session) GROUP BY c.session")
def agg_10(spark, sf_dir):
    s = Store(spark, sf_dir)
    return aggregates.merge_envelope(s.capsules, s.items)


@query("agg_11", "SELECT session, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT session, event_type, min(sequence) AS first FROM journal GROUP BY session, event_type) GROUP BY session")
def agg_11(spark, sf_dir):
    ordered = Store(spark, sf_dir).journal.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("sequence", "event_type"))).alias("e"))
    return ordered.select("session", F.array_join(F.array_distinct(F.transform("e", lambda x: x["event_type"])), ",").alias("kinds"))


@query("agg_13", "SELECT text, count(*) AS n FROM items WHERE status = 'active' AND kind <> 'dependency' GROUP BY text HAVING count(*) > 1")
def agg_13(spark, sf_dir):
    texts = Store(spark, sf_dir).items.filter("status = 'active' AND kind <> 'dependency'").groupBy("text").agg(F.count("*").alias("n"))
    return texts.filter("n > 1")


_COO = "SELECT session AS graph, sequence % 3 AS row, segment % 2 AS col, (CASE WHEN sequence % 2 = 0 THEN 1.5 ELSE -1.5 END)::DOUBLE AS value FROM items"


def _coo(s: Store):
    return s.items.select(F.col("session").alias("graph"), (F.col("sequence") % 3).alias("row"), (F.col("segment") % 2).alias("col"), F.when(F.col("sequence") % 2 == 0, 1.5).otherwise(-1.5).alias("value"))


@query("agg_14", f"SELECT graph, row, col, sum(value) AS value FROM ({_COO}) GROUP BY ALL HAVING sum(value) <> 0")
def agg_14(spark, sf_dir):
    return aggregates.accumulate(_coo(Store(spark, sf_dir)))


@query("agg_15", f"SELECT graph, max(s) AS row_norm, max(m) AS max_abs FROM (SELECT graph, row, sum(abs(value)) AS s, max(abs(value)) AS m FROM (SELECT graph, row, col, sum(value) AS value FROM ({_COO}) GROUP BY ALL HAVING sum(value) <> 0) GROUP BY graph, row) GROUP BY graph")
def agg_15(spark, sf_dir):
    return aggregates.matrix_norms(aggregates.accumulate(_coo(Store(spark, sf_dir))))


@query("agg_16", "SELECT session, CASE WHEN n = 0 THEN '0.00%' ELSE (least(n, r) * 10000 // n // 100)::VARCHAR || '.' || lpad((least(n, r) * 10000 // n % 100)::VARCHAR, 2, '0') || '%' END AS reduction FROM (SELECT session, count(*) AS n, count(*) FILTER (WHERE kind = 'goal') AS r FROM items GROUP BY session)")
def agg_16(spark, sf_dir):
    counts = Store(spark, sf_dir).items.groupBy("session").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "goal").alias("r"))
    return counts.select("session", aggregates.reduction_text(F.col("n"), F.col("r")).alias("reduction"))

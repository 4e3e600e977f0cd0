from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import checks, greedy, windows
from ..sources import Store
from .registry import query

#: A journal with tool rounds: events of a user, whose types are told by the sequence.
TOOLED = """, tooled AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, props FROM events)"""


@query("win_01", "SELECT conv_id AS session, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence FROM conversations WHERE role IN ('user','assistant')")
def win_01(spark, sf_dir):
    from ..sources import read

    rows = read(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant")).select(F.col("conv_id").alias("session"), "turn")
    return windows.allocate(rows, ["turn"])


@query("win_02", "SELECT session, sequence, previous FROM (SELECT session, sequence, lag(sequence) OVER (PARTITION BY session ORDER BY sequence) AS previous FROM (SELECT session, sequence + sequence // 4 AS sequence FROM journal)) WHERE sequence <> previous + 1")
def win_02(spark, sf_dir):
    """Numbers that skip one after every third event."""
    shifted = F.col("sequence") + F.floor(F.col("sequence") / 4)
    return checks.gaps(Store(spark, sf_dir).journal.select("session", shifted.alias("sequence")))


@query("win_03", "SELECT snapshot_id, count(*) FILTER (WHERE n <> ordinal) AS misplaced FROM (SELECT snapshot_id, ordinal, row_number() OVER (PARTITION BY snapshot_id ORDER BY ordinal) - 1 AS n FROM (SELECT snapshot_id, ordinal + (ordinal >= 2)::INT AS ordinal FROM memberships)) GROUP BY snapshot_id")
def win_03(spark, sf_dir):
    """Memberships that skip an ordinal after the second."""
    rows = Store(spark, sf_dir).memberships.withColumn("ordinal", F.col("ordinal") + F.when(F.col("ordinal") >= 2, 1).otherwise(0))
    n = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("ordinal")) - 1
    return rows.withColumn("n", n).groupBy("snapshot_id").agg(F.count_if(F.col("n") != F.col("ordinal")).alias("misplaced"))


def _raw(s: Store):
    return s.journal.select("session", F.col("sequence").alias("event_sequence"), F.lit(1).alias("n_sources"), F.col("token_count").alias("cost"))


@query("win_04", "SELECT session, event_sequence, suffix_cost FROM (SELECT session, sequence AS event_sequence, (sum(token_count) OVER w + 2 * (count(*) OVER w - 1))::BIGINT AS suffix_cost FROM journal WINDOW w AS (PARTITION BY session ORDER BY sequence ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE suffix_cost <= 3000")
def win_04(spark, sf_dir):
    return windows.suffix_within(_raw(Store(spark, sf_dir)), 3000).select("session", "event_sequence", "suffix_cost")


@query("win_05", "SELECT session, sequence AS event_sequence FROM (SELECT *, max(CASE WHEN sequence <> p + 1 THEN sequence END) OVER (PARTITION BY session) AS brk FROM (SELECT session, sequence, lag(sequence) OVER (PARTITION BY session ORDER BY sequence) AS p FROM (SELECT session, sequence + sequence // 4 AS sequence FROM journal))) WHERE brk IS NULL OR sequence >= brk")
def win_05(spark, sf_dir):
    """Of numbers that skip one after every third event, the run behind the last gap."""
    shifted = F.col("event_sequence") + F.floor(F.col("event_sequence") / 4)
    return windows.tail_run(_raw(Store(spark, sf_dir)).withColumn("event_sequence", shifted)).select("session", "event_sequence")


@query("win_06", "SELECT session, start, size FROM (SELECT session, start, size, sum(size) OVER (PARTITION BY session ORDER BY start DESC) AS so_far FROM (SELECT session, (sequence - 1) // 3 AS unit, min(sequence) AS start, count(*) AS size FROM journal GROUP BY ALL)) WHERE so_far <= 4 OR so_far = size")
def win_06(spark, sf_dir):
    units = Store(spark, sf_dir).journal.groupBy("session", F.floor((F.col("sequence") - 1) / 3).alias("unit")).agg(F.min("sequence").alias("start"), F.count("*").alias("size"))
    return windows.last_units(units, 4).select("session", "start", "size")


_FOLD = """, rows AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, strlen(props)::BIGINT AS tok FROM events),
walk AS (
  SELECT session, sequence, 1::BIGINT AS n, tok AS total, 0::BIGINT AS segment FROM rows WHERE sequence = 1
  UNION ALL
  SELECT r.session, r.sequence, CASE WHEN w.n >= 16 OR w.total >= 120 OR w.n + 1 > 16 OR w.total + r.tok > 120 THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.n >= 16 OR w.total >= 120 OR w.n + 1 > 16 OR w.total + r.tok > 120 THEN r.tok ELSE w.total + r.tok END,
    CASE WHEN w.n >= 16 OR w.total >= 120 OR w.n + 1 > 16 OR w.total + r.tok > 120 THEN w.segment + 1 ELSE w.segment END
  FROM walk w JOIN rows r ON r.session = w.session AND r.sequence = w.sequence + 1)
"""


@query("win_07", _FOLD + "SELECT session, sequence, segment FROM walk")
def win_07(spark, sf_dir):
    return greedy.fold(Store(spark, sf_dir).activity, 16, 120)


@query("win_08", "SELECT session, string_agg(DISTINCT x, ',' ORDER BY x) AS preferred FROM (SELECT session, x, max_n FROM (SELECT session, max(sequence) AS max_n FROM journal GROUP BY session), (VALUES (3, 1), (9, 2), (1, 3), (3, 4), (5, 5)) t(x, pos) WHERE pos <= 4) WHERE x >= 1 AND x < max_n GROUP BY session")
def win_08(spark, sf_dir):
    wanted = F.slice(F.array(*map(F.lit, (3, 9, 1, 3, 5))), 1, 4)
    last = Store(spark, sf_dir).journal.groupBy("session").agg(F.max("sequence").alias("last"))
    kept = last.select("session", F.array_sort(F.array_distinct(F.filter(wanted, lambda x: (x >= 1) & (x < F.col("last"))))).alias("p"))
    return kept.filter(F.size("p") > 0).select("session", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("preferred"))


def tooled(s: Store):
    """Rounds of five: user, call, call, result, result, then an assistant message each sixth; sessions divisible by 7 lose a result."""
    n = (F.col("sequence") - 1) % 6
    kind = F.when(n == 0, "USER_MESSAGE").when(n.isin(1, 2), "TOOL_CALL").when(n.isin(3, 4), "TOOL_RESULT").otherwise("ASSISTANT_MESSAGE")
    which = F.when(n.isin(1, 4), 1).otherwise(2)
    spoiled = (F.col("session") % 7 == 0) & (n == 4)
    content = F.when(n.between(1, 4), F.format_string('{"kind":"%s","tool":"t%d","arguments":{"k":%d}}', F.when(n <= 2, "call").otherwise("result"), F.when(spoiled, 9).otherwise(which), which)).otherwise(F.col("content"))
    return s.activity.select("session", "sequence", kind.alias("event_type"), content.alias("content"), "token_count")


_N = "(SELECT user_id AS session, count(*) AS n FROM events GROUP BY user_id)"


@query("win_09", f"SELECT session, CASE WHEN session % 7 = 0 AND n >= 5 THEN 'invalid' WHEN n % 6 IN (0, 1) THEN 'stable' WHEN n % 6 = 5 THEN 'awaiting_assistant' ELSE 'awaiting_results' END AS state, CASE WHEN session % 7 = 0 AND n >= 5 THEN 0 WHEN n % 6 = 0 THEN n // 6 * 2 WHEN n % 6 = 1 THEN n // 6 * 2 + 1 ELSE 0 END AS n_units FROM {_N}")
def win_09(spark, sf_dir):
    return windows.assess(tooled(Store(spark, sf_dir))).select("session", "state", "n_units")


@query("win_10", f"SELECT session, sum(size)::BIGINT AS events, count(*) AS n_units FROM (SELECT s.session, u.size FROM {_N} s, (SELECT unnest(range(0, 400)) AS k) r, (VALUES (1, 0), (5, 1)) u(size, odd) WHERE (session % 7 <> 0 OR n < 5) AND n % 6 IN (0, 1) AND r.k * 6 + CASE odd WHEN 0 THEN 1 ELSE 6 END <= n) GROUP BY session")
def win_10(spark, sf_dir):
    return windows.units(tooled(Store(spark, sf_dir))).groupBy("session").agg(F.sum("size").alias("events"), F.count("*").alias("n_units"))


#: Units of stable sessions of ``tooled``: one event, then five, in turn; and the segments that they make, cut greedily.
_SEGMENTS = f""", sized AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events),
parts AS (SELECT user_id AS session, sequence, {{tokens}} AS tokens, ((sequence - 1) // 6) * 2 + ((sequence - 1) % 6 > 0)::INT AS unit FROM sized),
u AS (SELECT p.session, unit + 1 AS k, min(sequence) AS first, max(sequence) AS last, sum(tokens)::BIGINT AS cost, unit + 1 = max(unit + 1) OVER (PARTITION BY p.session) AS final FROM parts p JOIN {_N} s USING (session) WHERE (session % 7 <> 0 OR n < 5) AND n % 6 IN (0, 1) GROUP BY p.session, unit),
walk AS (
  SELECT session, 0::BIGINT AS k, NULL::BIGINT AS start, NULL::BIGINT AS stop, NULL::BIGINT AS tokens, NULL::BIGINT[] AS before, NULL::VARCHAR AS over, NULL::BIGINT[] AS after, NULL::VARCHAR AS why FROM u WHERE k = 1
  UNION ALL
  SELECT session, k, CASE WHEN why IS NULL THEN start END, CASE WHEN why IS NULL THEN last END, CASE WHEN why IS NULL THEN tokens END, before, over, CASE WHEN why IS NOT NULL THEN [start, last, tokens] END, why FROM (
    SELECT *, CASE WHEN last - first + 1 > 8 OR cost > 100 THEN 'OVERSIZED_EVENT' WHEN final THEN 'END_OF_INPUT' WHEN last - start + 1 >= 8 THEN 'MAX_EVENTS' WHEN tokens >= 100 THEN 'MAX_TOKENS' WHEN 7 BETWEEN first AND last OR 13 BETWEEN first AND last THEN 'PREFERRED' END AS why FROM (
      SELECT session, k, first, last, cost, final, over, CASE WHEN over IS NOT NULL THEN [prior, stop, held] END AS before, CASE WHEN over IS NULL THEN coalesce(prior, first) ELSE first END AS start, CASE WHEN over IS NULL THEN coalesce(held, 0) + cost ELSE cost END AS tokens FROM (
        SELECT u.session, u.k, u.first, u.last, u.cost, u.final, w.start AS prior, w.stop, w.tokens AS held, CASE WHEN u.last - w.start + 1 > 8 THEN 'MAX_EVENTS' WHEN w.tokens + u.cost > 100 THEN 'MAX_TOKENS' END AS over
        FROM walk w JOIN u ON u.session = w.session AND u.k = w.k + 1)))
), made AS (SELECT session, before AS part, over AS reason FROM walk WHERE before IS NOT NULL UNION ALL SELECT session, after, why FROM walk WHERE after IS NOT NULL)
SELECT session, row_number() OVER (PARTITION BY session ORDER BY part[1]) - 1 AS segment, part[1] AS start, part[2] AS "end", part[3] AS tokens, reason FROM made"""


@query("win_11", _SEGMENTS.replace("{tokens}", "strlen(props)::BIGINT"))
def win_11(spark, sf_dir):
    """Segments never split a unit: their ends are unit ends."""
    return greedy.segment_units(windows.units(tooled(Store(spark, sf_dir))), windows.Caps(8, 100), [7, 13])


_RUNS = """, sized AS (SELECT session, sequence, strlen('[' || sequence || ', ' || to_json(content)::VARCHAR || ']') AS size FROM journal),
walk AS (
  SELECT session, sequence, 0::BIGINT AS n, CASE WHEN size + 2 <= 1500 THEN size + 2 END AS held, CASE WHEN size + 2 <= 1500 THEN 0 ELSE -1 END::BIGINT AS run FROM sized WHERE sequence = 1
  UNION ALL
  SELECT session, sequence, n, CASE WHEN size + 2 > 1500 THEN held WHEN held IS NULL THEN size + 2 ELSE held + 2 + size END, CASE WHEN size + 2 > 1500 THEN -1 ELSE n END FROM (
    SELECT s.session, s.sequence, s.size, CASE WHEN w.held + 2 + s.size > 1500 THEN w.n + 1 ELSE w.n END AS n, CASE WHEN w.held + 2 + s.size <= 1500 THEN w.held END AS held FROM walk w JOIN sized s ON s.session = w.session AND s.sequence = w.sequence + 1)
) SELECT session, sequence, run FROM walk"""


@query("win_12", _RUNS)
def win_12(spark, sf_dir):
    """Runs of events whose serialised form stays within a limit; rows too large alone are deferred (run -1)."""
    import json

    return windows.split_sessions(Store(spark, sf_dir).journal, 1500, lambda rows: len(json.dumps(rows, ensure_ascii=False).encode()))

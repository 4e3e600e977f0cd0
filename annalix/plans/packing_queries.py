from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, graph, packing, retrieval
from ..sources import Store
from ..sources.prelude import OPEN_STATES
from .blocks_sql import BLOCKS, COMPONENTS, QUERY
from .join_queries import _MISSING, missing
from .registry import query

#: Budgets of the packing queries: small enough that some sessions reject blocks.
BUDGET = packing.Budget(target=6000, ceiling=9000, limit=10_000, reserved=1000, margin=100)


def _blocks(spark, sf_dir):
    return retrieval.session_blocks(Store(spark, sf_dir), QUERY)


@query("sort_01", BLOCKS + "SELECT session, block_id, position FROM ordered")
def sort_01(spark, sf_dir):
    return _blocks(spark, sf_dir).select("session", "block_id", "position")


@query("sort_02", BLOCKS + """SELECT session, block_id, row_number() OVER (PARTITION BY session ORDER BY list_position(['active_goal','hard_constraint','raw_delta','exact_anchor','recent_raw','active_task','relevant_evidence','episode_background','global_background'], slot),
 CASE WHEN slot = 'raw_delta' THEN event_sequence ELSE 0 END, CASE WHEN slot = 'raw_delta' THEN 0.0 ELSE -score END, block_id) - 1 AS place FROM ordered""")
def sort_02(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy(*packing.packing_order())
    return _blocks(spark, sf_dir).select("session", "block_id", (F.row_number().over(w).cast("long") - 1).alias("place"))


@query("sort_03", BLOCKS + """SELECT session, block_id, row_number() OVER (PARTITION BY session ORDER BY list_position(['active_goal','hard_constraint','raw_delta','exact_anchor','recent_raw','active_task','relevant_evidence','episode_background','global_background'], slot), block_id, reason, -score) AS place FROM ordered""")
def sort_03(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy(retrieval.slot_rank(), "block_id", "reason", -F.col("score"))
    return _blocks(spark, sf_dir).select("session", "block_id", F.row_number().over(w).cast("long").alias("place"))


@query("sort_04", "SELECT job_id, state, created_at FROM jobs WHERE state = 'PENDING' OR (state = 'RETRY_WAIT' AND next_retry_at <= '2026-01-02T00:00:00.000000Z') ORDER BY created_at, job_id LIMIT 1")
def sort_04(spark, sf_dir):
    from ..operators.jobs import eligible

    return Store(spark, sf_dir).jobs.filter(eligible("2026-01-02T00:00:00.000000Z")).orderBy("created_at", "job_id").limit(1).select("job_id", "state", "created_at")


_OPEN = ", ".join(f"'{s}'" for s in OPEN_STATES)


@query("sort_05", f"SELECT job_id, state, error_code FROM jobs WHERE state IN ({_OPEN}) ORDER BY created_at DESC, job_id DESC LIMIT 1")
def sort_05(spark, sf_dir):
    return Store(spark, sf_dir).jobs.filter(F.col("state").isin(*OPEN_STATES)).orderBy(F.desc("created_at"), F.desc("job_id")).limit(1).select("job_id", "state", "error_code")


@query("sort_06", f"SELECT * FROM ({_MISSING}) WHERE session = 5 ORDER BY kind_rank, sort_major, sort_minor, artifact_id LIMIT 3")
def sort_06(spark, sf_dir):
    return missing(Store(spark, sf_dir)).filter("session = 5").orderBy("kind_rank", "sort_major", "sort_minor", "artifact_id").limit(3)


@query("sort_07", "SELECT capsule_id, kind, item_id FROM items QUALIFY row_number() OVER (PARTITION BY capsule_id, kind ORDER BY sequence) <= 1")
def sort_07(spark, sf_dir):
    items = aggregates.first_by_key(Store(spark, sf_dir).items, ["capsule_id", "kind"], ["sequence"])
    return items.filter("NOT duplicate").select("capsule_id", "kind", "item_id")


_GREEDY = BLOCKS + """, costs AS (SELECT session, position, block_id, strlen(text)::BIGINT AS cost FROM ordered),
walk AS (
  SELECT session, position, block_id, CASE WHEN cost <= 3000 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 3000 THEN 1 ELSE 0 END AS n, cost <= 3000 AS selected FROM costs WHERE position = 0
  UNION ALL
  SELECT c.session, c.position, c.block_id, CASE WHEN w.used + c.cost + CASE WHEN w.n > 0 THEN 2 ELSE 0 END <= 3000 THEN w.used + c.cost + CASE WHEN w.n > 0 THEN 2 ELSE 0 END ELSE w.used END,
    CASE WHEN w.used + c.cost + CASE WHEN w.n > 0 THEN 2 ELSE 0 END <= 3000 THEN w.n + 1 ELSE w.n END, w.used + c.cost + CASE WHEN w.n > 0 THEN 2 ELSE 0 END <= 3000
  FROM walk w JOIN costs c ON c.session = w.session AND c.position = w.position + 1)
SELECT session, block_id, selected FROM walk"""


@query("pack_01", _GREEDY)
def pack_01(spark, sf_dir):
    return packing.greedy_fold(_blocks(spark, sf_dir), 3000)


@query("pack_02")
def pack_02(spark, sf_dir):
    """Sessions whose required blocks exceed a small budget."""
    blocks = _blocks(spark, sf_dir).withColumn("required", F.col("required") & (F.col("kind") != "raw_event"))
    packed = packing.assemble_sessions(blocks, "now", 0, 0, packing.Budget(2500, 9000, 10_000, 1000, 0))
    return packed.filter("mode = 'EMERGENCY_ASSEMBLY'")


def _packed(b_ac: int) -> str:
    """Components taken in order while they fit; ``picked`` has the blocks of sessions in which every required one was taken."""
    return BLOCKS + COMPONENTS + f""", sized AS (SELECT o.*, c.least, strlen(text)::BIGINT AS cost FROM ordered o JOIN comp c USING (session, position)),
grp AS (SELECT session, least, sum(cost)::BIGINT AS cost, count(*) AS n, row_number() OVER (PARTITION BY session ORDER BY least) AS k FROM sized GROUP BY session, least),
walk AS (
  SELECT session, 0::BIGINT AS k, 0::BIGINT AS used, false AS started, NULL::BIGINT AS least, NULL::BOOLEAN AS fits FROM grp WHERE k = 1
  UNION ALL
  SELECT session, k, CASE WHEN used + price <= {b_ac} THEN used + price ELSE used END, started OR used + price <= {b_ac}, least, used + price <= {b_ac} FROM (
    SELECT g.session, g.k, g.least, w.used, w.started, (g.cost + 2 * (g.n - CASE WHEN w.started THEN 0 ELSE 1 END))::BIGINT AS price FROM walk w JOIN grp g ON g.session = w.session AND g.k = w.k + 1)
), tried AS (SELECT s.*, w.fits AS selected FROM sized s JOIN walk w ON w.session = s.session AND w.least = s.least),
picked AS (SELECT * FROM tried WHERE session IN (SELECT session FROM tried GROUP BY session HAVING bool_and(selected OR NOT required)))
"""


_USED = "(coalesce(sum(cost) FILTER (WHERE selected), 0) + 2 * greatest(0, count(*) FILTER (WHERE selected) - 1))::BIGINT"


@query("pack_03", _packed(5897) + f"SELECT session, {_USED} AS used, {_USED} AS recount, 5897::BIGINT AS b_ac FROM picked GROUP BY session HAVING count(*) FILTER (WHERE selected) > 0")
def pack_03(spark, sf_dir):
    """Exact costs of what was packed in normal mode, counted twice: never above the budget."""
    packed = packing.assemble_sessions(_blocks(spark, sf_dir), "now", 0, 0, BUDGET).filter("selected AND mode = 'NORMAL'")
    return packed.groupBy("session").agg(F.max("used").alias("used"), (F.sum("token_cost") + 2 * (F.count("*") - 1)).alias("recount"), F.max("b_ac").alias("b_ac"))


@query("pack_04", _packed(5837) + f"""SELECT session, 'NORMAL' AS mode, 'NONE' AS error, block_id, selected, CASE WHEN selected THEN 'SELECTED_NORMAL' ELSE 'INSUFFICIENT_AC_BUDGET' END AS reason, cost AS token_cost, 5837::BIGINT AS b_ac, u.used
FROM picked JOIN (SELECT session, {_USED} AS used FROM picked GROUP BY session) u USING (session)""")
def pack_04(spark, sf_dir):
    """Sessions whose required blocks all fit: what was selected, what not, and why."""
    return packing.assemble_sessions(_blocks(spark, sf_dir), "now", 50, 10, BUDGET).filter("mode = 'NORMAL' AND error = 'NONE'")


@query("pack_04_all")
def pack_04_all(spark, sf_dir):
    """All sessions, those in emergency mode as well."""
    return packing.assemble_sessions(_blocks(spark, sf_dir), "now", 50, 10, BUDGET)


@query("pack_05", _packed(5837) + "SELECT session, slot, sum(cost)::BIGINT AS slot_tokens FROM picked WHERE selected GROUP BY session, slot")
def pack_05(spark, sf_dir):
    """Costs by slot of what was packed in normal mode."""
    blocks = _blocks(spark, sf_dir)
    packed = packing.assemble_sessions(blocks, "now", 50, 10, BUDGET).filter("selected AND mode = 'NORMAL'")
    return packed.join(blocks.select("session", "block_id", "slot"), ["session", "block_id"]).groupBy("session", "slot").agg(F.sum("token_cost").alias("slot_tokens"))


@query("pack_06", BLOCKS + "SELECT session, block_id, CASE WHEN required THEN score ELSE greatest(0.0, score / 100 - 0.35) / greatest(1, strlen(text)) END::DOUBLE AS pack_score FROM ordered")
def pack_06(spark, sf_dir):
    """Scores for each token of cost from given activations."""
    given = F.col("score") / 100 - F.lit(0.35)
    return _blocks(spark, sf_dir).select("session", "block_id", packing.pack_score(F.col("required"), F.col("score"), given, F.octet_length("text")).alias("pack_score"))


@query("pack_06_solved")
def pack_06_solved(spark, sf_dir):
    """The same from the solver's activations."""
    blocks = _blocks(spark, sf_dir)
    solved = graph.solve_sessions(blocks, QUERY).select("session", "block_id", "activation")
    rows = blocks.select("session", "block_id", "required", "score", F.octet_length("text").alias("cost")).join(solved, ["session", "block_id"])
    return rows.select("session", "block_id", F.round(packing.pack_score(F.col("required"), F.col("score"), F.col("activation"), F.col("cost")), 10).alias("pack_score"))


@query("pack_07", BLOCKS + """, costs AS (SELECT session, block_id, row_number() OVER (PARTITION BY session ORDER BY score DESC, position) AS n, greatest(1, length(text) // 4) AS cost FROM ordered),
walk AS (
  SELECT session, n, block_id, CASE WHEN cost <= 700 THEN 700 - cost ELSE 700 END AS remaining, cost <= 700 AS selected FROM costs WHERE n = 1
  UNION ALL SELECT c.session, c.n, c.block_id, CASE WHEN c.cost <= w.remaining THEN w.remaining - c.cost ELSE w.remaining END, c.cost <= w.remaining FROM walk w JOIN costs c ON c.session = w.session AND c.n = w.n + 1)
SELECT session, block_id, selected, 'NONE' AS error FROM walk""")
def pack_07(spark, sf_dir):
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    blocks = _blocks(spark, sf_dir).select("session", F.col("score").alias("priority"), "position", "block_id", tokens.alias("tokens"), F.lit(False).alias("required"))
    return packing.priority_greedy(blocks, 700)


@query("pack_08", "SELECT job_id, least(greatest(0, target - 3), greatest(0, 4 - attempt_count)) AS granted FROM jobs")
def pack_08(spark, sf_dir):
    return Store(spark, sf_dir).jobs.select("job_id", packing.reserve(F.col("target") - 3, F.greatest(F.lit(0), 4 - F.col("attempt_count"))).alias("granted"))


@query("pack_09")
def pack_09(spark, sf_dir):
    """Every session's capsules folded into one of 4,000 bytes; sessions whose core does not fit say so."""
    return fold_sessions(Store(spark, sf_dir), 4000)


@query("pack_10")
def pack_10(spark, sf_dir):
    """What had to be shortened on the way."""
    return fold_sessions(Store(spark, sf_dir), 4000).filter("status = 'approximate'")


def fold_sessions(s: Store, budget: int):
    import pyarrow as pa

    from ..operators.reorganise import CORE, OPTIONAL, BudgetError, reorganise

    rows = s.items.join(s.capsules.select("capsule_id", "level", "covered_event_start", "covered_event_end"), "capsule_id")
    ids = {"anchor": "anchor_id", "decision": "decision_id", "entity": "entity_id", "dependency": "dependency_id"}

    def item(r: dict) -> dict:
        own = {ids.get(r["kind"], "claim_id"): r["item_id"], "source_event_ids": [r["source"]]}
        if r["kind"] == "anchor":
            return own | {"anchor_type": "quote", "exact_text": r["text"], "status": r["status"], "importance": r["importance"]}
        if r["kind"] == "dependency":
            return own | {"kind": "follows", "target_id": r["text"]}
        if r["kind"] == "entity":
            return own | {"kind": "topic", "canonical_name": r["text"], "aliases": []}
        claim = own | {"text": r["text"], "status": r["status"], "confidence": 1.0}
        return claim | {"rationale": "", "alternatives": [], "supersedes": [], "rejected_because": ""} if r["kind"] == "decision" else claim

    def run(table: pa.Table) -> pa.Table:
        made: dict[str, dict] = {}
        for r in table.sort_by([("sequence", "ascending"), ("item_id", "ascending")]).to_pylist():
            c = made.setdefault(r["capsule_id"], {
                "capsule_id": r["capsule_id"], "schema_version": "2.1.0", "level": r["level"], "session_key": {"session_id": str(r["session"])}, "covered_event_start": r["covered_event_start"], "covered_event_end": r["covered_event_end"],
                "source_event_ids": [], "narrative_summary": "Summary of " + r["capsule_id"], "created_at": "2026-01-01T00:00:00Z", "quality": {}, **{f: [] for f in (*OPTIONAL.values(), *CORE.values())},
            })
            c["source_event_ids"] = sorted({*c["source_event_ids"], r["source"]})
            c[(OPTIONAL | CORE | {"anchor": "exact_anchors"})[r["kind"]]].append(item(r))
        session = table["session"][0].as_py()
        try:
            got = reorganise(list(made.values()), budget)
            ledger, after, error = got["ledger"], got["after_tokens"], "NONE"
        except BudgetError as e:
            ledger, after, error = [{"kind": "", "item_id": "", "source_capsule_id": "", "status": "", "before_tokens": 0, "after_tokens": 0, "required": False}], e.required, "BUDGET_EXCEEDED"
        out = pa.Table.from_pylist(ledger)
        n = out.num_rows
        return out.append_column("session", pa.array([session] * n, pa.int64())).append_column("capsule_tokens", pa.array([after] * n, pa.int64())).append_column("error", pa.array([error] * n, pa.string()))

    return rows.groupBy("session").applyInArrow(run, "kind string, item_id string, source_capsule_id string, status string, before_tokens long, after_tokens long, required boolean, session long, capsule_tokens long, error string")


@query("retr_01", BLOCKS + "SELECT session, block_id, slot, kind, text, array_to_string(list_sort(sources), ',') AS sources, score, reason, required, capsule_id, event_sequence, position FROM ordered")
def retr_01(spark, sf_dir):
    return _blocks(spark, sf_dir).withColumn("sources", F.array_join(F.array_sort("sources"), ",")).drop("required_selection_complete")


@query("retr_03", "SELECT session, count(*) <= 3 AS complete FROM delta GROUP BY session")
def retr_03(spark, sf_dir):
    """Whether a limit of three delta events leaves a session all its required blocks."""
    blocks = retrieval.session_blocks(Store(spark, sf_dir), QUERY, retrieval.Retrieval(max_delta_events=3))
    return blocks.groupBy("session").agg(F.bool_and("required_selection_complete").alias("complete"))


@query("retr_02", BLOCKS + "SELECT o.session, block_id FROM ordered o JOIN (SELECT session, max(sequence) AS s FROM journal GROUP BY session) m USING (session) JOIN journal j ON j.session = o.session AND j.sequence = m.s WHERE NOT list_contains(sources, j.event_id)")
def retr_02(spark, sf_dir):
    s = Store(spark, sf_dir)
    latest = s.journal.groupBy("session").agg(F.max_by("event_id", "sequence").alias("current"))
    return retrieval.session_blocks(s, QUERY).join(latest, "session").filter(~F.array_contains("sources", F.col("current"))).select("session", "block_id")


@query("graph_25", BLOCKS.replace("'the'", "'no such words'") + "SELECT session, block_id, score FROM ordered WHERE slot NOT IN ('episode_background', 'global_background')")
def graph_25(spark, sf_dir):
    """Blocks of a candidate snapshot: no query, no background."""
    blocks = retrieval.session_blocks(Store(spark, sf_dir), "")
    return blocks.filter(~F.col("slot").isin("episode_background", "global_background")).select("session", "block_id", "score")

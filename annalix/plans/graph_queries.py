from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, joins, packing, retrieval
from ..sources import Store
from .blocks_sql import BLOCKS, COMPONENTS as _COMPONENTS, QUERY
from .join_queries import _CAPPED
from .packing_queries import BUDGET
from .registry import query


def _blocks(spark, sf_dir):
    return retrieval.session_blocks(Store(spark, sf_dir), QUERY)


@query("graph_01", _CAPPED.replace("SELECT session, i, j, weight FROM", "SELECT weight, count(*) AS n FROM (SELECT session, i, j, weight FROM", 1) + ") GROUP BY weight")
def graph_01(spark, sf_dir):
    """How often each relation weight occurs."""
    return joins.relations(_blocks(spark, sf_dir)).groupBy("weight").agg(F.count("*").alias("n"))


_OPERATOR = _CAPPED.replace("SELECT session, i, j, weight FROM (", ", rel AS (SELECT session, i, j, weight FROM (", 1) + """), coo AS (
  SELECT session, i AS row, i AS col, weight AS value FROM rel UNION ALL SELECT session, j, j, weight FROM rel
  UNION ALL SELECT session, i, j, -weight FROM rel UNION ALL SELECT session, j, i, -weight FROM rel UNION ALL SELECT session, position, position, 1.0 + 1e-9 FROM ordered)
SELECT session, row, col, round(sum(value), 9) AS value FROM coo GROUP BY session, row, col HAVING sum(value) <> 0"""


@query("graph_03", _OPERATOR)
def graph_03(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return graph.propagation_entries(joins.relations(blocks), blocks).withColumn("value", F.round("value", 9))


@query("graph_04", BLOCKS + "SELECT session, block_id, CASE position % 5 WHEN 0 THEN 'fix' WHEN 1 THEN 'equality' ELSE 'unsupported' END AS kind FROM ordered")
def graph_04(spark, sf_dir):
    """Constraints of five forms, of which two are supported."""
    here, k = F.col("position"), F.col("position") % 5
    term = lambda at, c: F.struct(at.alias("at"), F.lit(c).alias("coefficient"))
    terms = F.when(k == 1, F.array(term(here, 1.0), term(here - 1, -1.0))).when(k == 2, F.array(term(here, 2.0))).when(k == 3, F.array(term(here, 1.0), term(here - 1, 1.0))).otherwise(F.array(term(here, 1.0)))
    rhs = F.when(k == 0, (here % 2).cast("double")).when(k == 4, 0.5).otherwise(0.0)
    return _blocks(spark, sf_dir).select("session", "block_id", graph.constraint_kind(terms, rhs).alias("kind"))


@query("graph_05", BLOCKS + ", n AS (SELECT session, count(*) AS blocks, count(DISTINCT slot) AS slots FROM ordered GROUP BY session) SELECT session, CASE WHEN blocks = 0 THEN 'NONE' ELSE 'CONSTRAINT_CONTRADICTORY' END AS code, blocks + slots AS given, 0::BIGINT AS independent FROM n UNION ALL SELECT session, 'NONE', blocks, blocks FROM n")
def graph_05(spark, sf_dir):
    """Blocks of a slot made equal, its first one fixed to 1: the independent rows of each session; and with its last one fixed to 0, which contradicts."""
    blocks = _blocks(spark, sf_dir)
    both = graph.constraint_sessions(blocks).unionByName(graph.constraint_sessions(blocks, contradict=True))
    return both.select("session", "code", "given", "independent").distinct()


@query("graph_06", BLOCKS + "SELECT session, block_id, first_value(block_id) OVER (PARTITION BY session, slot ORDER BY position) AS first FROM ordered")
def graph_06(spark, sf_dir):
    """The block that stands for each block's group of equal ones."""
    return graph.constraint_sessions(_blocks(spark, sf_dir)).select("session", "block_id", "first")


@query("graph_07_blocks")
def graph_07_blocks(spark, sf_dir):
    """Activation of every block under the constraint that required ones are 1."""
    return graph.solve_sessions(_blocks(spark, sf_dir), QUERY).withColumn("activation", F.round("activation", 8))


def _pairs(spark, sf_dir):
    """(session, outcome, error_code, band, block_id, activation): a required block and an optional one, related with a weight; scores and weights follow from the session.

    With the required one fixed to 1 the optional one's activation is (score + weight) / (1 + weight), up to the diagonal's epsilon. Every third session lacks its source.
    """
    import numpy as np

    def run(n: int):
        own = [packing.Block("must", "active_goal", "goal", "x", ("e1",), 1.0, "r", True), packing.Block("may", "relevant_evidence", "decision", "x", ("e2",), 1.0, "r", False)]
        score, weight = n % 10 / 10, 0.25 * (1 + n % 4)
        got = graph.solve_graph(own, [([(0, 1.0), (1, -1.0)], weight)], np.array([1.0, score]), None, {"e1"} if n % 3 == 0 else {"e1", "e2"})
        return got.outcome, got.error_code, got.residual_band, round(got.scores["may"], 8), "may" in got.selected

    return _systems(spark, sf_dir, run, "session long, outcome string, error_code string, band string, activation double, selected boolean")


_ACTIVE = "(SELECT session, (session % 10 / 10.0::DOUBLE + 0.25::DOUBLE * (1 + session % 4)) / (1 + 0.25::DOUBLE * (1 + session % 4) + 1e-9::DOUBLE) AS a FROM marks)"


@query("graph_07", f"SELECT session, round(a, 8) AS activation, a >= 0.5 AND session % 3 <> 0 AS selected FROM {_ACTIVE}")
def graph_07(spark, sf_dir):
    """The constrained solve of systems whose solution is known in closed form."""
    return _pairs(spark, sf_dir).select("session", "activation", "selected")


#: A probe that few texts match, so that there is something to eliminate.
RARE = "zq"
_KEPT = BLOCKS + ", kept AS (SELECT session, count(*) AS n, count(*) FILTER (WHERE required OR regexp_matches(lower(text), '[zq]')) AS k FROM ordered GROUP BY session) "


@query("graph_08", _KEPT + "SELECT session, n, CASE k WHEN 0 THEN 0 ELSE n - k END AS eliminated, true AS rebuilt FROM kept")
def graph_08(spark, sf_dir):
    """What the reduction eliminates, and that the eliminated rows hold."""
    return graph.reduction_sessions(_blocks(spark, sf_dir), RARE).select("session", "n", "eliminated", "rebuilt")


@query("graph_09", _KEPT + "SELECT session, k > 0 AND k < n AS reduced, true AS agrees FROM kept")
def graph_09(spark, sf_dir):
    """The reduced solve, rebuilt, is the full solve in every coordinate to 1e-8."""
    return graph.reduction_sessions(_blocks(spark, sf_dir), RARE).select("session", (F.col("eliminated") > 0).alias("reduced"), "agrees")


@query("graph_17", f"SELECT session, CASE WHEN a >= 0.5 AND session % 3 = 0 THEN 'DEGRADED_RAW' ELSE 'ACTIVE' END AS outcome, CASE WHEN a >= 0.5 AND session % 3 = 0 THEN 'CERTIFICATE_PROVENANCE_FAILED' ELSE 'NONE' END AS error_code FROM {_ACTIVE}")
def graph_17(spark, sf_dir):
    """The certificate's verdict: a chosen block without provenance fails it."""
    return _pairs(spark, sf_dir).select("session", "outcome", "error_code")


@query("graph_23", f"SELECT session, CASE WHEN a >= 0.5 AND session % 3 = 0 THEN 'FAILED' ELSE 'VERIFIED' END AS band FROM {_ACTIVE}")
def graph_23(spark, sf_dir):
    return _pairs(spark, sf_dir).select("session", "band")


@query("graph_17_blocks")
def graph_17_blocks(spark, sf_dir):
    return graph.solve_sessions(_blocks(spark, sf_dir), QUERY).select("session", "outcome", "error_code", "band").distinct()


@query("graph_18", BLOCKS + _COMPONENTS + "SELECT o.session, o.block_id, r.block_id AS component FROM ordered o JOIN comp c USING (session, position) JOIN ordered r ON r.session = o.session AND r.position = c.least")
def graph_18(spark, sf_dir):
    return graph.component_sessions(_blocks(spark, sf_dir)).select("session", "block_id", "component")


@query("graph_19", BLOCKS + _COMPONENTS + "SELECT o.session, o.block_id, NOT bool_or(o.required) OVER (PARTITION BY o.session, c.least) AS removable FROM ordered o JOIN comp c USING (session, position)")
def graph_19(spark, sf_dir):
    return graph.component_sessions(_blocks(spark, sf_dir)).select("session", "block_id", "removable")


_CLOSED = BLOCKS + _COMPONENTS + "SELECT o.session, o.block_id FROM ordered o JOIN comp c USING (session, position) QUALIFY bool_or(o.required OR o.kind = 'decision') OVER (PARTITION BY o.session, c.least)"


@query("graph_20", _CLOSED)
def graph_20(spark, sf_dir):
    return graph.component_sessions(_blocks(spark, sf_dir)).filter("closed").select("session", "block_id")


@query("graph_21", _CLOSED.replace("SELECT o.session, o.block_id FROM", "SELECT o.session, o.block_id, row_number() OVER (PARTITION BY o.session ORDER BY o.position) - 1 AS place, true AS again FROM (SELECT o.* FROM", 1) + ") o")
def graph_21(spark, sf_dir):
    """A closure comes in the blocks' order and is closed."""
    return graph.closure_sessions(_blocks(spark, sf_dir))


@query("graph_22_cut", "SELECT session, count(*) > 3 AS cut FROM delta GROUP BY session")
def graph_22_cut(spark, sf_dir):
    """Sessions of which a limit of three delta events cut a required block keep the plain packing, and say so."""
    blocks = retrieval.session_blocks(Store(spark, sf_dir), QUERY, retrieval.Retrieval(max_delta_events=3))
    got = graph.live_sessions(blocks, QUERY, 50, 10, packing.Budget(60_000, 90_000, 100_000, 1000, 100))
    return got.select("session", ((F.col("outcome") == "DEGRADED_RAW") & (F.col("error_code") == "LIVE_REQUIRED_CANDIDATE_TRUNCATED")).alias("cut"))


@query("graph_22")
def graph_22(spark, sf_dir):
    return graph.live_sessions(_blocks(spark, sf_dir), QUERY, 50, 10, packing.Budget(60_000, 90_000, 100_000, 1000, 100))


@query("graph_22_small")
def graph_22_small(spark, sf_dir):
    return graph.live_sessions(_blocks(spark, sf_dir), QUERY, 50, 10, BUDGET)


#: Three probes of different kinds.
PROBES = ("", "the", "what was decided and why")


@query("graph_24")
def graph_24(spark, sf_dir):
    return graph.verify_sessions(_blocks(spark, sf_dir), PROBES)


def _systems(spark, sf_dir, run, schema: str):
    """run(number, size) -> rows for each session's system, whose number is that of the session."""
    import pyarrow as pa

    def each(batches):
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            rows = [(n, *run(n)) for n in b.column("session").to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")]))

    return Store(spark, sf_dir).marks.select("session").mapInArrow(each, schema)


@query("graph_14", "SELECT session, CASE session % 4 WHEN 0 THEN 'CONVERGED' WHEN 1 THEN 'SINGULAR' ELSE 'ILL_CONDITIONED' END AS status, session % 4 IN (0, 2) AS solved FROM marks")
def graph_14(spark, sf_dir):
    """Well-conditioned, singular and ill-conditioned systems, the last kind also beyond 1e14, by two solvers that must agree."""
    import numpy as np

    from ..operators import solvers

    def run(n: int):
        a = [np.diag([2.0, 1.0]), np.array([[1.0, 2.0], [2.0, 4.0]]), np.diag([1.0, 1e-13]), np.diag([1.0, 3e-15])][n % 4]
        one, two = graph.dense_solve(a, np.ones(2), graph.Limits()), solvers.elimination(a, np.ones(2))
        same = one.status == two.status and (one.x is None) == (two.x is None)
        return (one.status if same else f"{one.status} and {two.status}"), one.x is not None

    return _systems(spark, sf_dir, run, "session long, status string, solved boolean")


_SPMV = _OPERATOR.replace("SELECT session, row, col, round(sum(value), 9) AS value FROM coo GROUP BY session, row, col HAVING sum(value) <> 0", "SELECT session, row, round(sum(value * (col + 1)), 6) AS product FROM coo GROUP BY session, row")


@query("graph_16", _SPMV)
def graph_16(spark, sf_dir):
    """The operator times the vector 1, 2, 3, ... as a join and a sum."""
    blocks = _blocks(spark, sf_dir)
    q = graph.propagation_entries(joins.relations(blocks), blocks)
    x = blocks.select("session", F.col("position").alias("col"), (F.col("position") + 1).cast("double").alias("x"))
    return q.join(x, ["session", "col"]).groupBy("session", "row").agg(F.round(F.sum(F.col("value") * F.col("x")), 6).alias("product"))


@query("graph_15", "SELECT session, round(k * 1e-6 / (2 + k * 1e-6), 15) AS error, k = 0 AS accepted FROM (SELECT session, session % 5 AS k FROM marks)")
def graph_15(spark, sf_dir):
    """Backward errors of a solution that is off by session % 5 millionths in one coordinate."""
    import numpy as np

    def run(n: int):
        b = np.ones(3)
        b[1] += n % 5 * 1e-6
        error = graph.backward_error(np.eye(3), np.ones(3), b)
        return round(error, 15), error <= graph.Limits().error

    return _systems(spark, sf_dir, run, "session long, error double, accepted boolean")

"""Every query against its SQL, and the others for invariants."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle import connect, rows

from annalix.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SMALL).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_solves_are_verified(spark):
    got = QUERIES["graph_17_blocks"](spark, SMALL).toPandas()
    assert set(got["outcome"]) == {"ACTIVE"} and set(got["error_code"]) == {"NONE"} and set(got["band"]) == {"VERIFIED"}


def test_reductions_eliminate_something(spark):
    got = QUERIES["graph_08"](spark, SMALL).toPandas()
    assert (got["eliminated"] > 0).any() and got["rebuilt"].all()


def test_scores_of_solved_blocks(spark):
    """The column against the function on blocks."""
    from annalix.operators import graph, packing
    from annalix.plans.packing_queries import _blocks
    from annalix.plans.blocks_sql import QUERY

    want = {}
    for _, own in _blocks(spark, SMALL).toPandas().sort_values("position").groupby("session"):
        blocks = [packing.Block(*r) for r in own[["block_id", "slot", "kind", "text", "sources", "score", "reason", "required", "capsule_id", "event_sequence"]].itertuples(index=False)]
        blocks = [packing.replace(b, sources=tuple(b.sources), capsule_id=b.capsule_id if isinstance(b.capsule_id, str) else None, event_sequence=None if b.event_sequence != b.event_sequence else b.event_sequence) for b in blocks]
        relations, scores, kept, provenance = graph.build(blocks, QUERY)
        solved = graph.solve_graph(blocks, relations, scores, kept, provenance)
        want |= {b.block_id: b.score for b in packing.per_token(blocks, solved.scores, {b.block_id: packing.utf8_cost(b.text) for b in blocks})}
    got = {r["block_id"]: r["pack_score"] for r in QUERIES["pack_06_solved"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_compiled_segments_are_whole(spark):
    assert QUERIES["comp_01_capsules"](spark, SMALL).toPandas()["complete"].all()


def test_a_map_keeps_what_was_used_last(spark):
    from annalix.functions.metadata import Recent
    from annalix.operators.aggregates import most_recent

    accesses = [(k * 7 % 23, n) for n, k in enumerate([*range(60), 3, 3, 9])]
    held = Recent(5)
    for key, at in accesses:
        held.put(key, at)
    got = most_recent(spark.createDataFrame(accesses, "k int, at int"), "k", "at", 5).collect()
    assert {r["k"]: r["latest"] for r in got} == dict(held)


def test_strict_json_looks_into_texts_for_nothing(spark):
    from annalix.functions import scalars

    texts = {'{"a":1}': True, '{"a":"NaN"}': True, r'{"a":"\"NaN"}': True, '{"a":NaN}': False, '{"a":[-Infinity]}': False, '{"a":1,"a":2}': False, "{": False, '{"Infinity":1}': True}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["ok"] for r in rows.select("t", scalars.strict_json(rows["t"]).alias("ok")).collect()} == texts


def test_budget_columns_are_those_of_packing(spark):
    from annalix.operators.packing import Budget, assemble, budget_columns
    from pyspark.sql import functions as F

    budget = Budget(100, 90, 120, 20, 5)
    got = spark.range(1).select(*[c.alias(k) for k, c in budget_columns(budget, F.lit(5), F.lit(15), F.lit(10)).items()]).first()
    a = assemble([], "12345", 15, 10, budget, len)
    assert (got["b_input"], got["b_required"], got["b_ac"]) == (a.b_input, a.b_required, a.b_ac)


def test_packed_costs_add_up(spark):
    got = QUERIES["pack_03"](spark, SMALL).toPandas()
    assert (got["used"] == got["recount"]).all() and (got["used"] <= got["b_ac"]).all()


def test_probes_agree(spark):
    assert QUERIES["graph_24"](spark, SMALL).toPandas()["verified"].all()


def test_fold_keeps_core_items(spark):
    got = QUERIES["pack_09"](spark, SMALL).toPandas()
    assert (got.loc[got["required"], "status"] == "retained").all()
    assert (got.loc[got["error"] == "NONE", "capsule_tokens"] <= 4000).all()


def test_segments_keep_units_whole(spark):
    segments = QUERIES["win_11"](spark, SMALL).toPandas()
    assert (segments["end"] - segments["start"] + 1 <= 8).all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

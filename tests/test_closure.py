"""Components, closures and equality systems against the functions on one session's blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalix.operators import closure, graph, packing

EDGES = "session long, a long, b long"


def brute(edges):
    label = {}
    for s, a, b in edges:
        if a is not None and b is not None and a != b:
            label.setdefault((s, a), a), label.setdefault((s, b), b)
    changed = True
    while changed:
        changed = False
        for s, a, b in edges:
            if (s, a) in label and (s, b) in label:
                low = min(label[s, a], label[s, b])
                for k in ((s, a), (s, b)):
                    if label[k] != low:
                        label[k], changed = low, True
    return {(s, n, c) for (s, n), c in label.items()}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_edges(spark, seed):
    draw = np.random.default_rng(seed)
    edges = [(int(s), int(a), int(b)) for s, a, b in zip(draw.integers(0, 4, 90), draw.integers(0, 60, 90), draw.integers(0, 60, 90))]
    edges += [(7, 3, 3), (7, None, 1), (None, 1, 2), edges[0], edges[0]]
    got = closure.components(spark.createDataFrame(edges, EDGES)).collect()
    assert {tuple(r) for r in got} == {x for x in brute(edges) if x[0] is not None} and len(got) == len(set(got))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(5000).select(F.lit(1).cast("long").alias("session"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1, 5000).select(F.lit(2).cast("long").alias("session"), F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = closure.components(chain.unionByName(star))
    assert {(r.session, r.component, r["count"]) for r in got.groupBy("session", "component").count().collect()} == {(1, 0, 5001), (2, 0, 5000)}
    assert closure.components(spark.createDataFrame([], EDGES)).collect() == []


def random_blocks(draw, n):
    out = []
    for k in range(n):
        kind = str(draw.choice(["dependency", "decision", "goal", "entity"]))
        sources = tuple(f"e{x}" for x in draw.integers(0, 2 * n, draw.integers(0, 3)))
        out.append(packing.Block(f"b{k}", "relevant_evidence", kind, "t", sources, 1.0, "r", bool(draw.random() < 0.1), None if draw.random() < 0.5 else f"c{draw.integers(0, n)}", None))
    return out


@pytest.fixture(scope="module")
def sessions():
    draw = np.random.default_rng(4)
    return {s: random_blocks(draw, n) for s, n in enumerate((1, 5, 20, 40, 80))}


@pytest.fixture(scope="module")
def blocks(spark, sessions):
    rows = [(s, b.block_id, k, b.kind, list(b.sources), b.capsule_id, b.required) for s, bs in sessions.items() for k, b in enumerate(bs)]
    return spark.createDataFrame(rows, "session long, block_id string, position long, kind string, sources array<string>, capsule_id string, required boolean")


def test_groups_and_closures_are_those_of_one_session(sessions, blocks):
    got = {(r.session, r.block_id): (r.component, r.removable, r.closed) for r in closure.grouped(blocks, F.col("kind") == "decision").collect()}
    for s, own in sessions.items():
        comp = packing.components(own)
        removable = {b.block_id for g in packing.removable(own) for b in g}
        closed = [b.block_id for b in packing.closure([b.block_id for b in own if b.kind == "decision"], own, 1024)]
        for k, b in enumerate(own):
            assert got[s, b.block_id] == (comp[k], b.block_id in removable, b.block_id in closed)
    rows = closure.closure(blocks, F.col("kind") == "decision", 30).orderBy("session", "place").collect()
    for s, own in sessions.items():
        want = [b.block_id for b in packing.closure([b.block_id for b in own if b.kind == "decision"], own, 1024)]
        assert [r.block_id for r in rows if r.session == s] == want
        assert {r.code for r in rows if r.session == s} <= {"DEPENDENCY_CLOSURE_CAPACITY_EXCEEDED" if len(want) > 30 else "NONE"}


def test_packs_are_judged(spark, sessions, blocks):
    whole = closure.closure(blocks, F.col("kind") == "decision").select("session", "block_id", "place")
    assert all(r.valid for r in closure.closed_packs(blocks, whole).collect())
    odd = whole.filter("session <> 2 OR place > 0").unionByName(spark.createDataFrame([(3, "nowhere", 99)], "session long, block_id string, place long")).unionByName(whole.filter("session = 4 AND place = 0"))
    told = {r.session: r.valid for r in closure.closed_packs(blocks, odd).collect()}
    assert not told[2] and not told[3] and not told[4] and all(told[s] for s in told if s < 2)


def test_equality_systems(spark):
    """Random systems against the elimination of one session's rows."""
    draw = np.random.default_rng(8)
    coordinates, equal, fixed, want = [], [], [], {}
    for s in range(12):
        n = int(draw.integers(1, 12))
        eq = [(int(a), int(b)) for a, b in draw.integers(0, n, (int(draw.integers(0, n)), 2)) if a != b]
        fx = [(int(a), float(draw.integers(0, 2))) for a in draw.integers(0, n, int(draw.integers(0, 3)))]
        coordinates += [(s, k) for k in range(n)]
        equal += [(s, a, b) for a, b in eq]
        fixed += [(s, a, v) for a, v in fx]
        given = [([(a, 1.0), (b, -1.0)], 0.0) for a, b in eq] + [([(a, 1.0)], v) for a, v in fx]
        try:
            c = graph.compile_constraints(n, given)
            want[s] = ("NONE", len(given), len(c.rows), list(c.label))
        except graph.GraphError as e:
            want[s] = (str(e), len(given), 0, None)
    labels, verdict = closure.constraints(spark.createDataFrame(coordinates, "session long, node long"), spark.createDataFrame(equal, EDGES), spark.createDataFrame(fixed, "session long, node long, value double"))
    assert {r.session: (r.code, r.given, r.independent) for r in verdict.collect()} == {s: w[:3] for s, w in want.items()}
    rows = {(r.session, r.node): r.label for r in labels.collect()}
    for s, (_, _, _, label) in want.items():
        if label is not None:
            assert [rows[s, k] for k in range(len(label))] == label
    assert {w[0] for w in want.values()} == {"NONE", "CONSTRAINT_CONTRADICTORY"}

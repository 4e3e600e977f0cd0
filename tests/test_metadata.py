"""Bounded metadata, rank files, the driver-side map, and the solvers."""

from __future__ import annotations

import json

import numpy as np
import pytest

from annalix.functions import metadata
from annalix.operators import graph, mutations, solvers


def test_bounds():
    deep = {"a": {"b": {"c": {"d": {"e": 1}}}}}
    assert metadata.bounded(deep) == {"a": {"b": {"c": {"d": {"type": "builtins.dict", "truncated": True}}}}}
    assert metadata.bounded(list(range(20)))[-1] == {"truncated_items": 4}
    many = metadata.bounded({f"k{n:02}": n for n in range(20)})
    assert many["$truncated_items"] == 4 and "k16" not in many and many["k15"] == 15
    assert metadata.bounded("x" * 600) == {"text": "x" * 512, "truncated": True, "characters": 600}
    assert metadata.bounded(float("nan")) == {"type": "non_finite_float"} and metadata.bounded(True) is True


def test_fallback_is_lossy_and_has_no_fingerprint():
    text = metadata.tool_metadata("call", "t", [["y" * 500] * 16] * 16)
    assert json.loads(text).keys() == {"kind", "truncated", "utf8_bytes"}
    from annalix.operators.windows import fingerprint

    assert fingerprint("TOOL_CALL", text) is None
    good = metadata.tool_metadata("result", "t", {"b": 1, "a": 2}, "fine")
    assert fingerprint("TOOL_RESULT", good) == ("t", '{"a":2,"b":1}')


def test_rank_file(spark, tmp_path):
    path = tmp_path / "ranks"
    path.write_text("\n".join(metadata.rank_line(t, n) for n, t in enumerate((b"a", b"b", b"ab"))))
    size, digest = metadata.file_facts(str(path))
    ranks = metadata.mergeable_ranks(spark, str(path), size, digest)
    assert {(bytes(r["token"]), r["rank"]) for r in ranks.collect()} == {(b"a", 0), (b"b", 1), (b"ab", 2)}
    assert metadata.invalid_ranks(ranks).isEmpty()
    with pytest.raises(ValueError, match="ASSET_INVALID"):
        metadata.mergeable_ranks(spark, str(path), size + 1, digest)
    path.write_text("\n".join(metadata.rank_line(t, n) for t, n in ((b"a", 0), (b"a", 1), (b"c", 1))))
    assert metadata.invalid_ranks(metadata.mergeable_ranks(spark, str(path), *metadata.file_facts(str(path)))).count() == 3


def test_recent_forgets_the_oldest_use():
    m = metadata.Recent(2)
    m.put("a", 1)
    m.put("b", 2)
    assert m.use("a") == 1
    m.put("c", 3)
    assert list(m) == ["a", "c"] and m.use("b", 0) == 0


def test_solvers_agree_on_a_seeded_system():
    draw = np.random.default_rng(7)
    n = 40
    a = draw.normal(size=(n, n)) + n * np.eye(n)
    b = draw.normal(size=n)
    want = np.linalg.solve(a, b)
    sparse = solvers.Sparse(n, *np.nonzero(a), a[np.nonzero(a)])
    assert np.allclose(solvers.elimination(a, b).x, want) and np.allclose(solvers.gmres(sparse, b).x, want, atol=1e-6)
    assert solvers.elimination(np.zeros((2, 2)), np.ones(2)).status == "SINGULAR"
    assert solvers.elimination(np.eye(65), np.ones(65)).status == "BACKEND_CAPACITY_EXCEEDED"
    assert solvers.gmres(sparse, b, restart=3, most=3).status == "ITERATION_LIMIT"


def test_gmres_on_a_system_too_large_to_be_dense():
    n = 5000
    i = np.arange(n)
    a = solvers.Sparse(n, np.concatenate([i, i[1:], i[:-1]]), np.concatenate([i, i[:-1], i[1:]]), np.concatenate([np.full(n, 4.0), np.full(n - 1, -1.0), np.full(n - 1, -1.0)]))
    assert solvers.choose(n, len(a.value)) == "BACKEND_CAPACITY_EXCEEDED" and solvers.choose(n, len(a.value), True) == "sparse"
    got = solvers.solve(a, np.ones(n), prefer_sparse=True)
    assert got.status == "CONVERGED" and np.allclose(a @ got.x, 1.0, atol=1e-6)
    assert solvers.solve(a, np.ones(n)).status == "BACKEND_CAPACITY_EXCEEDED"
    assert graph.dense_solve(np.eye(3), np.ones(3), graph.Limits()).status == "CONVERGED"


def test_migrations_and_swaps(spark):
    schema = "version long, checksum string"
    same = spark.createDataFrame([(1, "a")], schema)
    assert [r["state"] for r in mutations.pending_migrations(same, same).collect()] == ["APPLIED"]
    pointers = spark.createDataFrame([(1, 2)], "session long, pointer_version long")
    proposals = spark.createDataFrame([(1, "x", 2), (1, "w", 1), (2, "y", 0), (2, "z", 0)], "session long, snapshot_id string, expected long")
    got = {(r["session"], r["snapshot_id"]): r["outcome"] for r in mutations.swap_pointers(pointers, proposals).collect()}
    assert got == {(1, "x"): "COMMITTED", (1, "w"): "SUPERSEDED", (2, "y"): "COMMITTED", (2, "z"): "SUPERSEDED"}

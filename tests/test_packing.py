"""Packing, closure and folding on small fixtures."""

from __future__ import annotations

import random

import pytest

from annalix.operators.packing import Block, Budget, assemble, closure, components, dedupe, removable
from annalix.operators.reorganise import BudgetError, reorganise


def block(name: str, slot: str, size: int, required: bool = False, **more) -> Block:
    kinds = {"raw_delta": "raw_event", "active_goal": "goal", "exact_anchor": "exact_anchor"}
    return Block(name, slot, more.pop("kind", kinds.get(slot, "decision")), "x" * size, more.pop("sources", (name,)), more.pop("score", 1.0), "r", required, **more)


def test_budget_arithmetic():
    a = assemble([block("a", "active_goal", 10, True), block("b", "relevant_evidence", 20)], "12345", 15, 10, Budget(100, 90, 120, 20, 5), len)
    assert (a.b_input, a.b_required, a.b_ac, a.used, a.overhead) == (90, 20, 55, 32, 2)
    assert 15 + a.b_required + a.used == 67 and len(a.selected) == 2


def test_emergency_keeps_the_longest_suffix():
    blocks = [block("goal", "active_goal", 4, True), *[block(f"raw-{n}", "raw_delta", c, event_sequence=n) for n, c in ((1, 8), (2, 4), (3, 4))], block("anchor", "exact_anchor", 4, True), block("optional", "relevant_evidence", 1)]
    a = assemble(blocks, "", 0, 0, Budget(22, 22, 22, 0, 0), len)
    assert a.mode == "EMERGENCY_ASSEMBLY" and [b.block_id for b in a.selected] == ["goal", "raw-2", "raw-3", "anchor"] and a.used == 22
    assert [(b.block_id, r) for b, r in a.rejected] == [("raw-1", "EMERGENCY_RAW_PREFIX_OMITTED"), ("optional", "EMERGENCY_OPTIONAL_OMITTED")]


def test_required_raw_block_that_does_not_fit_is_an_error():
    a = assemble([block("raw-1", "raw_delta", 30, True, event_sequence=1)], "", 0, 0, Budget(22, 22, 22, 0, 0), len)
    assert a.error == "REQUIRED_INPUT_EXCEEDS_BUDGET" and not a.selected


def test_misfit_is_skipped_and_later_blocks_still_fit():
    a = assemble([block("a", "relevant_evidence", 5, score=3.0), block("b", "relevant_evidence", 50, score=2.0), block("c", "relevant_evidence", 5, score=1.0)], "", 0, 0, Budget(15, 15, 15, 0, 0), len)
    assert [b.block_id for b in a.selected] == ["a", "c"]


def test_duplicates_are_reported_once_in_any_order():
    blocks = [block(f"b{k}", s, 2) for k, s in enumerate(("global_background", "active_task", "active_goal", "exact_anchor"))]
    blocks.append(blocks[1])
    for _ in range(3):
        random.shuffle(blocks)
        a = assemble(blocks, "", 0, 0, Budget(99, 99, 99, 0, 0), len)
        assert [b.slot for b in a.selected] == ["active_goal", "exact_anchor", "active_task", "global_background"]
        assert [(b.block_id, r) for b, r in a.rejected] == [("b1", "DUPLICATE_BLOCK_ID")]
    assert len(dedupe(blocks)[1]) == 1


def test_counter_that_is_not_additive_drops_the_last_optional_group():
    count = lambda t: len(t) + 5 * t.count("\n\n")
    a = assemble([block("a", "active_goal", 5, True), block("b", "relevant_evidence", 5)], "", 0, 0, Budget(20, 20, 20, 0, 0), lambda t: 2 if t == "\n\n" else count(t))
    assert [b.block_id for b in a.selected] == ["a", "b"] and a.used == 17
    tight = assemble([block("a", "active_goal", 5, True), block("b", "relevant_evidence", 5)], "", 0, 0, Budget(14, 14, 14, 0, 0), lambda t: 2 if t == "\n\n" else count(t))
    assert [b.block_id for b in tight.selected] == ["a"] and [(b.block_id, r) for b, r in tight.rejected] == [("b", "EXACT_BUDGET_COMPONENT_REMOVED")]


def test_dependency_binds_its_capsule_and_sources():
    blocks = [
        block("required", "hard_constraint", 1, True, capsule_id="c1", sources=("e1",)), block("companion", "relevant_evidence", 1, kind="dependency", capsule_id="c1", sources=("e2",)),
        block("tools", "raw_delta", 1, sources=("e5", "e6")), block("other", "relevant_evidence", 1, capsule_id="c2", sources=("e9",)),
    ]
    assert components(blocks) == [0, 0, 2, 3]
    assert [b.block_id for b in closure(["tools"], blocks, 9)] == ["required", "companion", "tools"]
    assert [[b.block_id for b in g] for g in removable(blocks)] == [["tools"], ["other"]]
    with pytest.raises(ValueError, match="CAPACITY"):
        closure(["tools"], blocks, 2)
    with pytest.raises(ValueError, match="UNKNOWN"):
        closure(["nothing"], blocks, 9)


def capsule(**fields) -> dict:
    empty = {f: [] for f in ("goals", "constraints", "decisions", "progress", "open_loops", "preferences", "entities", "emotional_context", "exact_anchors", "dependencies")}
    return empty | {
        "capsule_id": "c1", "schema_version": "2.0.0", "level": "task", "session_key": {"session_id": "s"}, "covered_event_start": 1, "covered_event_end": 3, "source_event_ids": ["e1", "e2", "e3"],
        "narrative_summary": "long story", "token_cost": 1, "quality": {}, "created_at": "2026-01-01T00:00:00Z",
    } | fields


def full_capsule() -> dict:
    claim = lambda k, n: {"claim_id": k, "text": k * n, "status": "active", "confidence": 1.0, "source_event_ids": ["e1"]}
    return capsule(
        goals=[claim("g", 60)], constraints=[claim("c", 200)], progress=[claim("p", 300)],
        exact_anchors=[{"anchor_id": "a", "anchor_type": "quote", "exact_text": "keep me", "source_event_ids": ["e2"], "status": "active", "importance": 1.0}],
        dependencies=[{"dependency_id": "d", "kind": "follows", "target_id": "x", "source_event_ids": ["e3"]}],
    )


@pytest.mark.parametrize(("budget", "expected"), [(1300, ["retained", "retained", "released"]), (1400, ["retained", "retained", "approximate"])])
def test_folding_keeps_core_and_shortens_or_releases_the_rest(budget, expected):
    got = reorganise([full_capsule()], budget)
    status = {r["kind"]: r["status"] for r in got["ledger"]}
    assert status["exact_anchor"] == status["dependency"] == "retained" and status["narrative_summary"] == "released"
    assert [status[k] for k in ("goal", "constraint", "progress")] == expected
    assert got["capsule"]["token_cost"] == got["after_tokens"] <= budget < got["before_tokens"]
    shortened = [c["text"] for f in ("goals", "constraints", "progress") for c in got["capsule"][f] if c["text"].endswith("…")]
    assert all(len(t) >= 8 for t in shortened)


def test_folding_without_room_for_the_core():
    with pytest.raises(BudgetError):
        reorganise([full_capsule()], 1)


def test_folding_refuses_conflicting_items():
    other = full_capsule() | {"capsule_id": "c2"}
    other["goals"] = [other["goals"][0] | {"text": "different"}]
    with pytest.raises(ValueError, match="conflicting"):
        reorganise([full_capsule(), other], 10_000)
    same = reorganise([full_capsule(), full_capsule() | {"capsule_id": "c2"}], 10_000)
    assert sum(r["kind"] == "goal" for r in same["ledger"]) == 1

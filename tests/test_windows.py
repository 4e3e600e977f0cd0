"""Tool loop and segmenter on hand-made sessions."""

from __future__ import annotations

import json

import pytest

from annalix.operators.windows import Caps, ToolLoop, fingerprint, segments, session_units, split_by_cost


def tool(kind: str, name: str, **arguments) -> str:
    return json.dumps({"kind": kind, "tool": name, "arguments": arguments})


def events(*kinds) -> list[tuple[int, str, str, int]]:
    names = {"u": "USER_MESSAGE", "a": "ASSISTANT_MESSAGE", "c": "TOOL_CALL", "r": "TOOL_RESULT"}
    return [(n, names[k[0]], k[1] if len(k) > 1 else "text", 1) for n, k in enumerate(kinds, 1)]


U, A = ("u",), ("a",)
CALL, RESULT = ("c", tool("call", "search", q=1, z=2)), ("r", tool("result", "search", z=2, q=1))
LOOK, LOOKED = ("c", tool("call", "lookup")), ("r", tool("result", "lookup"))


@pytest.mark.parametrize(
    ("kinds", "state", "units"),
    [
        ((), "stable", []),
        ((U, A), "stable", [(1, 1, 1), (2, 2, 1)]),
        ((CALL, RESULT, A), "stable", [(1, 3, 3)]),
        ((CALL, LOOK, LOOKED, RESULT, A), "stable", [(1, 5, 5)]),
        ((U, CALL, RESULT, CALL, RESULT, A, U), "stable", [(1, 1, 1), (2, 6, 5), (7, 7, 1)]),
        ((U, CALL), "awaiting_results", []),
        ((CALL, RESULT), "awaiting_assistant", []),
        ((RESULT,), "invalid", []),
        ((CALL, LOOKED), "invalid", []),
        ((CALL, A), "invalid", []),
        ((CALL, RESULT, U), "invalid", []),
        ((("c", tool("call", " ")), RESULT, A), "invalid", []),
        ((("c", tool("call", "search", deep=[{"$Truncated-Items": 1}])),), "invalid", []),
        ((("c", '{"kind":"call","tool":"t","arguments":{},"arguments":{}}'),), "invalid", []),
        ((("c", '{"kind":"call","tool":"t","arguments":NaN}'),), "invalid", []),
        ((("c", '{"kind":"call","tool":"t"}'),), "invalid", []),
    ],
)
def test_tool_loop(kinds, state, units):
    loop, got = session_units(events(*kinds))
    assert (loop.state, got) == (state, units)


def test_gap_is_invalid_for_good():
    loop = ToolLoop()
    loop.step(1, "USER_MESSAGE", "x")
    loop.step(3, "USER_MESSAGE", "x")
    assert loop.state == "invalid" and loop.step(4, "USER_MESSAGE", "x") is None


def test_argument_order_does_not_matter():
    assert fingerprint("TOOL_CALL", CALL[1]) == fingerprint("TOOL_RESULT", RESULT[1])


def one(*tokens: int, first: int = 1) -> list[tuple[int, int, int]]:
    return [(n, n, t) for n, t in enumerate(tokens, first)]


def test_segments_by_events():
    got = segments(one(1, 1, 1, 1, 1), Caps(2, 100))
    assert got == [(1, 2, 2, "MAX_EVENTS"), (3, 4, 2, "MAX_EVENTS"), (5, 5, 1, "END_OF_INPUT")]


def test_segments_by_tokens():
    assert [x[:4] for x in segments(one(2, 3, 4, 1), Caps(10, 5))] == [(1, 2, 5, "MAX_TOKENS"), (3, 4, 5, "END_OF_INPUT")]


def test_segments_at_preferred_ends():
    got = segments(one(*[1] * 8, first=10), Caps(20, 100), [16, 12, 99, 14, 12, 9])
    assert [x[:2] for x in got] == [(10, 12), (13, 14), (15, 16), (17, 17)]


def test_preferred_end_inside_a_unit():
    assert segments([(1, 4, 4)], Caps(), [2]) == [(1, 4, 4, "END_OF_INPUT")]


def test_full_segment_closes_before_a_free_unit():
    assert [x[:2] for x in segments(one(5, 4, 0, 3), Caps(10, 9))] == [(1, 2), (3, 4)]


def test_oversized_unit_stands_alone():
    assert [(a, b, r) for a, b, _, r in segments(one(1, 50, 1), Caps(10, 9))] == [(1, 1, "MAX_TOKENS"), (2, 2, "OVERSIZED_EVENT"), (3, 3, "END_OF_INPUT")]


def test_split_defers_what_never_fits():
    runs, deferred = split_by_cost([(1, "ab"), (2, "cd"), (3, "x" * 50), (4, "e")], 10, lambda r: sum(len(t) + 3 for _, t in r))
    assert [[n for n, _ in r] for r in runs] == [[1, 2], [4]] and [n for n, _ in deferred] == [3]


def plain_segments(units, caps, wanted):
    """The same written out: a list of units is cut greedily."""
    out, held = [], []
    cost = lambda us: (us[-1][1] - us[0][0] + 1, sum(u[2] for u in us))

    def cut(reason):
        out.append((held[0][0], held[-1][1], cost(held)[1], reason))
        held.clear()

    for k, u in enumerate(units):
        if held:
            n, tokens = cost([*held, u])
            if n > caps.max_events or tokens > caps.max_tokens:
                cut("MAX_EVENTS" if n > caps.max_events else "MAX_TOKENS")
        held.append(u)
        n, tokens = cost(held)
        if cost([u])[0] > caps.max_events or u[2] > caps.max_tokens:
            cut("OVERSIZED_EVENT")
        elif k == len(units) - 1:
            cut("END_OF_INPUT")
        elif n >= caps.max_events:
            cut("MAX_EVENTS")
        elif tokens >= caps.max_tokens:
            cut("MAX_TOKENS")
        elif any(u[0] <= x <= u[1] for x in wanted[: caps.max_preferred]):
            cut("PREFERRED")
    return out


def test_segments_of_random_units():
    import random

    draw = random.Random(8)
    for _ in range(500):
        units, at = [], 1
        for _ in range(draw.randrange(12)):
            n = draw.randint(1, 6)
            units.append((at, at + n - 1, draw.randint(0, 30)))
            at += n
        caps = Caps(draw.randint(1, 8), draw.randint(1, 60), draw.randint(0, 3))
        wanted = [draw.randint(0, at + 2) for _ in range(4)]
        assert segments(units, caps, wanted) == plain_segments(units, caps, wanted)


def test_sessions_stream_through_a_task(spark):
    """Many sessions in few batches, and one far longer than a batch: units and states as of the whole list."""
    from annalix.operators import windows

    kinds = [U, A, CALL, RESULT, A]
    rows = [(s, n, k, t, c) for s, size in ((1, 30_000), *((s, s % 9) for s in range(2, 40))) for n, k, t, c in events(*(kinds[i % 5] for i in range(size)))]
    d = spark.createDataFrame([(s, n, k, t, c) for s, n, k, t, c in rows], "session long, sequence long, event_type string, content string, token_count long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        states = {r["session"]: (r["state"], r["n_units"]) for r in windows.assess(d).collect()}
        units = {(r["session"], r["start"], r["end"], r["tokens"]) for r in windows.units(d).collect()}
        cut = sorted(tuple(r) for r in windows.segment_sessions(d, Caps(4, 100), [3]).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want_states, want_units, want_cut = {}, set(), []
    for s in {r[0] for r in rows}:
        loop, got = session_units([r[1:] for r in rows if r[0] == s])
        want_states[s] = (loop.state, len(got))
        want_units |= {(s, a, b, t) for a, b, t in got}
        want_cut += [(s, k, *x) for k, x in enumerate(segments(got, Caps(4, 100), [3]))]
    assert states == want_states and units == want_units and cut == sorted(want_cut)

"""Order-dependent scans of a session: allocation, gaps, suffixes, units and segments.

What depends on all earlier events (tool loop, segmenter, splits) is a sequential machine with a small
state, run over sessions that come sorted: the journal is shuffled once, and no task holds a session.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import prefix


def allocate(events: DataFrame, order: list[str], most: int = prefix.ONE_TASK) -> DataFrame:
    """Dense sequence numbers within a session in the given arrival order. Sessions of more than ``most`` events are numbered block by block."""
    rows = prefix.cumulative(events, ["session"], [F.col(c) for c in order], {"sequence": F.lit(1)}, most)
    return rows.withColumn("sequence", F.col("sequence").cast("long"))


def tail_run(blocks: DataFrame, most: int = prefix.ONE_TASK) -> DataFrame:
    """The contiguous run at the end of each session's raw blocks: rows after the last break.

    A block follows another if its sequence is that one's plus the number of that one's sources: then sequence less the sources so far is the same
    for both. The last break is where that difference was last another one.
    """
    rows = prefix.cumulative(blocks, ["session"], [F.col("event_sequence")], {"_n": F.col("n_sources")}, most)
    rows = rows.withColumn("_d", F.col("event_sequence") - F.col("_n") + F.col("n_sources"))
    last = rows.groupBy("session").agg(F.max_by("_d", "event_sequence").alias("_last"))
    marked = rows.join(last, "session")
    breaks = marked.filter("_d <> _last").groupBy("session").agg(F.max("event_sequence").alias("_break"))
    return marked.join(breaks, "session", "left").filter("_break IS NULL OR event_sequence > _break").select(*blocks.columns)


def suffix_within(blocks: DataFrame, budget: int, separator: int = 2, most: int = prefix.ONE_TASK) -> DataFrame:
    """Rows of the longest suffix of each session whose cost, with separators, is within the budget."""
    rows = prefix.cumulative(blocks, ["session"], [F.desc("event_sequence")], {"_cost": F.col("cost"), "_n": F.lit(1)}, most)
    return rows.withColumn("suffix_cost", F.col("_cost") + separator * (F.col("_n") - 1)).filter(F.col("suffix_cost") <= budget).drop("_cost", "_n")


def last_units(units: DataFrame, events: int, most: int = prefix.ONE_TASK) -> DataFrame:
    """The last whole units of each session with at most ``events`` events together; the last unit always."""
    rows = prefix.cumulative(units, ["session"], [F.desc("start")], {"so_far": F.col("size")}, most)
    return rows.filter((F.col("so_far") <= events) | (F.col("so_far") == F.col("size"))).drop("so_far")


# --- the tool loop -----------------------------------------------------------------------------


def _pairs_once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _refuse(constant: str) -> object:
    raise ValueError(constant)


def _lossy(value: object) -> bool:
    if isinstance(value, list):
        return any(map(_lossy, value))
    if not isinstance(value, dict):
        return False
    names = {k.casefold().lstrip("$").replace("-", "_") for k in value}
    return bool(names & {"truncated", "truncated_items"}) or any(map(_lossy, value.values()))


def fingerprint(event_type: str, content: str | None) -> tuple[str, str] | None:
    """(tool, canonical arguments) of a tool event; None if its metadata can't establish a pairing."""
    try:
        data = json.loads(content, object_pairs_hook=_pairs_once, parse_constant=_refuse)
    except (TypeError, ValueError):
        return None
    if not isinstance(data, dict) or data.get("kind") != ("call" if event_type == "TOOL_CALL" else "result") or _lossy(data):
        return None
    tool = data.get("tool")
    if not isinstance(tool, str) or not tool.strip() or "arguments" not in data:
        return None
    return tool, json.dumps(data["arguments"], ensure_ascii=False, separators=(",", ":"), sort_keys=True)


@dataclass
class ToolLoop:
    """Protocol of one session, event by event. Its state can be stored between batches.

    Plain events are units of one. A tool round opens with a call, needs every call answered by a result
    of the same fingerprint, may open further calls, and closes with an assistant message. Anything else
    makes it invalid for good.
    """

    state: str = "stable"
    last: int | None = None
    opened: int | None = None
    pending: Counter = None

    def __post_init__(self):
        self.pending = Counter() if self.pending is None else self.pending

    def step(self, sequence: int, event_type: str, content: str | None) -> tuple[int, int] | None:
        """The unit (first, last sequence) that this event closes, if any."""
        if self.state == "invalid":
            return None
        follows = self.last is None or sequence == self.last + 1
        self.last = sequence
        tool = event_type in ("TOOL_CALL", "TOOL_RESULT")
        mark = fingerprint(event_type, content) if tool else None
        if not follows or tool and mark is None or event_type not in ("USER_MESSAGE", "ASSISTANT_MESSAGE", "TOOL_CALL", "TOOL_RESULT"):
            return self._fail()
        if event_type == "TOOL_CALL":
            if self.state == "stable":
                self.opened = sequence
            self.pending[mark] += 1
            self.state = "awaiting_results"
            return None
        if self.state == "stable" and not tool:
            return sequence, sequence
        if self.state == "awaiting_results" and event_type == "TOOL_RESULT" and self.pending[mark] > 0:
            self.pending[mark] -= 1
            self.pending += Counter()  # drops zero counts
            if not self.pending:
                self.state = "awaiting_assistant"
            return None
        if self.state == "awaiting_assistant" and event_type == "ASSISTANT_MESSAGE":
            self.state = "stable"
            return self.opened, sequence
        return self._fail()

    def _fail(self) -> None:
        self.state, self.pending = "invalid", Counter()


@dataclass(frozen=True)
class Caps:
    max_events: int = 16
    max_tokens: int = 4096
    max_preferred: int = 64


def preferred_ends(first: int, last: int, wanted: list[int], limit: int) -> set[int]:
    """The first ``limit`` wanted values as given, of which those in [first, last) count."""
    return {x for x in wanted[:limit] if first <= x < last}


def _size(run: tuple[int, int, int]) -> int:
    return run[1] - run[0] + 1


class Segmenter:
    """Segments of units as they come; a unit is decided once it is known whether another follows.

    A segment closes before a unit that would take it over a cap, and after a unit that reaches one, is too
    large by itself, is the last or holds a preferred end.
    """

    def __init__(self, caps: Caps, wanted: list[int] = ()):
        self.caps, self.ends = caps, set(list(wanted)[: caps.max_preferred])
        self.run: tuple[int, int, int] | None = None
        self.waiting: tuple[int, int, int] | None = None

    def _over(self, run: tuple[int, int, int], events: int, tokens: int) -> str | None:
        return "MAX_EVENTS" if _size(run) > events else "MAX_TOKENS" if run[2] > tokens else None

    def _place(self, unit: tuple[int, int, int], last: bool) -> Iterator[tuple[int, int, int, str]]:
        caps, joined = self.caps, unit
        if self.run is not None:
            joined = (self.run[0], unit[1], self.run[2] + unit[2])
            if why := self._over(joined, caps.max_events, caps.max_tokens):
                yield (*self.run, why)
                joined = unit
        why = "OVERSIZED_EVENT" if self._over(unit, caps.max_events, caps.max_tokens) else "END_OF_INPUT" if last else self._over(joined, caps.max_events - 1, caps.max_tokens - 1)
        if why is None and any(unit[0] <= x <= unit[1] for x in self.ends):
            why = "PREFERRED"
        self.run = None if why else joined
        if why:
            yield (*joined, why)

    def step(self, unit: tuple[int, int, int]) -> Iterator[tuple[int, int, int, str]]:
        if self.waiting is not None:
            yield from self._place(self.waiting, False)
        self.waiting = unit

    def finish(self) -> Iterator[tuple[int, int, int, str]]:
        if self.waiting is not None:
            yield from self._place(self.waiting, True)


def segments(units: Iterable[tuple[int, int, int]], caps: Caps, wanted: list[int] = ()) -> list[tuple[int, int, int, str]]:
    """(first, last, tokens, reason) of runs of units; units are (first, last, tokens)."""
    segmenter = Segmenter(caps, wanted)
    return [s for u in units for s in segmenter.step(u)] + list(segmenter.finish())


class UnitLoop:
    """The tool loop over events, with the tokens of the open unit only."""

    def __init__(self):
        self.loop, self.open, self.n_units = ToolLoop(), {}, 0

    def step(self, sequence: int, kind: str, content: str | None, tokens: int) -> tuple[int, int, int] | None:
        self.open[sequence] = tokens
        unit = self.loop.step(sequence, kind, content)
        if unit is None:
            if self.loop.state == "invalid":
                self.open.clear()
            return None
        self.n_units += 1
        out = (*unit, sum(self.open[x] for x in range(unit[0], unit[1] + 1)))
        self.open.clear()
        return out


def session_units(rows: Iterable[tuple[int, str, str | None, int]]) -> tuple[ToolLoop, list[tuple[int, int, int]]]:
    """The loop after all events (sequence, type, content, tokens), and its units with their tokens."""
    loop = UnitLoop()
    got = [u for u in (loop.step(*r) for r in rows) if u]
    return loop.loop, got if loop.loop.state == "stable" else []


def by_session(events: DataFrame, columns: list[str], machine: Callable, schema: str) -> DataFrame:
    """Rows of sequential machines, one a session: ``step(*columns)`` for each event in order, then ``finish()``; both give rows without the session.

    Sessions come sorted, batch by batch; a task holds the state of one machine and never a whole session.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        types = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            types = types or [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]] for f in schema.split(", ")]
            out: list[tuple] = []
            for session, *values in zip(b.column("session").to_pylist(), *(b.column(c).to_pylist() for c in columns)):
                if now is None or now[0] != session:
                    if now is not None:
                        out += [(now[0], *r) for r in now[1].finish()]
                    now = session, machine()
                out += [(session, *r) for r in now[1].step(*values)]
            yield table(out)
        if now is not None:
            yield table([(now[0], *r) for r in now[1].finish()])

    rows = events.select("session", *columns).repartition("session").sortWithinPartitions("session", "sequence")
    return rows.mapInArrow(run, schema)


EVENT = ["sequence", "event_type", "content", "token_count"]


class _Assessor(UnitLoop):
    def step(self, *event) -> tuple:
        super().step(*event)
        return ()

    def finish(self) -> Iterator[tuple]:
        loop = self.loop
        pending = "\n".join(f"{t}|{a}|{n}" for (t, a), n in sorted(loop.pending.items()))
        yield loop.state, pending, self.n_units if loop.state == "stable" else 0


def assess(events: DataFrame) -> DataFrame:
    """(session, state, pending, n_units): pending as tool|arguments|count lines, sorted."""
    return by_session(events, EVENT, _Assessor, "session long, state string, pending string, n_units long")


def _of_stable(rows: DataFrame, what: str) -> DataFrame:
    """Rows of one kind of the sessions that end stable. A window over the machines' rows, which are fewer than events, spares a second pass over those."""
    stable = F.bool_or(F.col("what") == "stable").over(Window.partitionBy("session"))
    return rows.withColumn("_stable", stable).filter(F.col("_stable") & (F.col("what") == what)).drop("what", "_stable")


class _Units(UnitLoop):
    """Units as they close, and last the state, without which they don't count."""

    def step(self, *event) -> Iterator[tuple]:
        if unit := super().step(*event):
            yield "unit", self.n_units - 1, unit[0], unit[1], _size(unit), unit[2]

    def finish(self) -> Iterator[tuple]:
        yield self.loop.state, None, None, None, None, None


def units(events: DataFrame) -> DataFrame:
    """(session, k, start, end, size, tokens) of each durable unit, k counting from 0; none for a session that isn't stable."""
    rows = by_session(events, EVENT, _Units, "session long, what string, k long, start long, end long, size long, tokens long")
    return _of_stable(rows, "unit")


def segment_sessions(events: DataFrame, caps: Caps, wanted: list[int] = ()) -> DataFrame:
    """(session, segment, start, end, tokens, reason) of the units of every stable session."""

    class Cutter(UnitLoop):
        def __init__(self):
            super().__init__()
            self.segmenter, self.n = Segmenter(caps, wanted), 0

        def _rows(self, got: Iterator) -> Iterator[tuple]:
            for first, last, tokens, reason in got:
                yield "segment", self.n, first, last, tokens, reason
                self.n += 1

        def step(self, *event) -> Iterator[tuple]:
            if unit := super().step(*event):
                yield from self._rows(self.segmenter.step(unit))

        def finish(self) -> Iterator[tuple]:
            yield from self._rows(self.segmenter.finish())
            yield self.loop.state, None, None, None, None, None

    rows = by_session(events, EVENT, Cutter, "session long, what string, segment long, start long, end long, tokens long, reason string")
    return _of_stable(rows, "segment")


class Splitter:
    """Runs of (sequence, content) whose ``cost`` (of the whole run: it need not be additive) is within the limit; rows that exceed it alone are deferred (run -1)."""

    def __init__(self, limit: int, cost: Callable):
        self.limit, self.cost = limit, cost
        self.current: list[tuple[int, str]] = []
        self.n = 0

    def _close(self) -> Iterator[tuple[int, int]]:
        if self.current:
            yield from ((seq, self.n) for seq, _ in self.current)
            self.current, self.n = [], self.n + 1

    def step(self, sequence: int, content: str) -> Iterator[tuple[int, int]]:
        row = (sequence, content)
        if self.current and self.cost([*self.current, row]) > self.limit:
            yield from self._close()
        if self.cost([row]) > self.limit:
            yield sequence, -1
        else:
            self.current.append(row)

    def finish(self) -> Iterator[tuple[int, int]]:
        return self._close()


def split_by_cost(rows: Iterable[tuple[int, str]], limit: int, cost: Callable) -> tuple[list[list[tuple[int, str]]], list[tuple[int, str]]]:
    """The runs of a ``Splitter``, and the deferred rows."""
    rows, splitter = dict(rows), Splitter(limit, cost)
    runs: dict[int, list[tuple[int, str]]] = {}
    for sequence, n in [x for r in rows.items() for x in splitter.step(*r)] + list(splitter.finish()):
        runs.setdefault(n, []).append((sequence, rows[sequence]))
    deferred = runs.pop(-1, [])
    return list(runs.values()), deferred


def split_sessions(events: DataFrame, limit: int, cost: Callable) -> DataFrame:
    """(session, sequence, run) of every event; a task holds one run."""
    return by_session(events, ["sequence", "content"], lambda: Splitter(limit, cost), "session long, sequence long, run long")


class _Fold:
    def __init__(self, max_events: int, max_tokens: int):
        self.most, self.n, self.tokens, self.segment = (max_events, max_tokens), 0, 0, -1

    def step(self, sequence: int, tokens: int) -> tuple:
        events, most = self.most
        if self.segment < 0 or self.n >= events or self.tokens >= most or self.tokens + tokens > most:
            self.n, self.tokens, self.segment = 0, 0, self.segment + 1
        self.n, self.tokens = self.n + 1, self.tokens + tokens
        return ((sequence, self.segment),)

    def finish(self) -> tuple:
        return ()


def fold_segments(events: DataFrame, max_events: int, max_tokens: int) -> DataFrame:
    """(session, sequence, segment) for journals without tool events, in one pass over the sorted session.

    Closes both before a row that would exceed a cap and after one that reaches it.
    """
    return by_session(events, ["sequence", "token_count"], lambda: _Fold(max_events, max_tokens), "session long, sequence long, segment long")

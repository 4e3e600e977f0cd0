"""Greedy segments of sessions of any length, without a pass from end to end.

A segment of at most ``max_events`` events has at most as many units, so where a segment ends that begins at a unit follows from
the next ``max_events`` units alone: a search in running sums. Units are dealt in blocks, each with a copy of the
first units of the block after it, and for all units of a block the end is found at once. A block can be
entered at one of its first ``max_events`` units only, by a segment that began in the block before; it
is thus a small table from where it is entered to where the next block is entered, and how many segments begin within. These tables are
joined with themselves, doubling the number of blocks that a step spans, until every block's entry is known, and
each block writes its segments. A task holds a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialise
from .windows import Caps

#: Units of a block.
BLOCK = 1 << 16
REASONS = ("MAX_EVENTS", "MAX_TOKENS", "OVERSIZED_EVENT", "END_OF_INPUT", "PREFERRED")


def ends(start: np.ndarray, end: np.ndarray, tokens: np.ndarray, caps: Caps, wanted: list[int], last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(last unit, reason) of the segment that begins at each unit; last: nothing follows these units. An end beyond them is a guess that the caller drops."""
    n = len(start)
    at, before = np.arange(n), np.concatenate([[0], np.cumsum(tokens)])
    upto = before[1:]
    by_events = np.searchsorted(end, start + caps.max_events - 1)
    by_tokens = np.searchsorted(upto, before[:-1] + caps.max_tokens)
    j = np.minimum(by_events, by_tokens)  # the first unit that reaches a cap
    inside = np.minimum(j, n - 1)
    size, cost = end[inside] - start + 1, upto[inside] - before[:-1]
    over = (j < n) & ((size > caps.max_events) | (cost > caps.max_tokens))
    alone = over & (j == at)
    out = np.where(over & ~alone, inside - 1, inside)
    why = np.where(alone, 2, np.where(over, np.where(size > caps.max_events, 0, 1), np.where(size >= caps.max_events, 0, 1)))
    soft = over & ~alone  # ends because the next unit would be too much; a preferred end at the same unit comes first
    if last:
        why[(out == n - 1) & ~alone] = 3
    ends_ = np.array(sorted(set(list(wanted)[: caps.max_preferred])), np.int64)
    if len(ends_):
        prefers = np.searchsorted(ends_, start) < np.searchsorted(ends_, end, "right")
        nearest = np.where(prefers, at, n)
        nearest = np.minimum.accumulate(nearest[::-1])[::-1]
        earlier = (nearest < out) | (nearest == out) & soft
        out, why = np.where(earlier, nearest, out), np.where(earlier, 4, why)
    return out, why


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        a = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((a[:, 1:] != a[:, :-1]).any(0)) + 1), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = b.slice(lo, hi - lo)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _units(t: pa.Table, block: int) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(session, block, number of the block's own units, start, end, tokens), the units of the next block last."""
    own = int(t["block"][0].as_py())
    n = int((t["k"].to_numpy() // block == own).sum())
    return t["session"][0].as_py(), own, n, t["start"].to_numpy(), t["end"].to_numpy(), t["tokens"].to_numpy()


def _blocked(units: DataFrame, halo: int, block: int) -> DataFrame:
    """Units with their block, and the first ``halo`` units of a block also with the one before."""
    own = F.floor(F.col("k") / block)
    both = F.when((F.col("k") % block < halo) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return units.select("session", "k", "start", "end", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.explode(both).alias("block"))


def _by_block(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return rows.repartition("session", "block").sortWithinPartitions("session", "block", "k").mapInArrow(run, schema)


def _entries(cut: DataFrame, caps: Caps, wanted: list[int], block: int) -> DataFrame:
    """(session, block, entry, segments): where each block is entered, and how many segments of the session begin before it."""
    halo = caps.max_events

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("session", "block")):
            session, own, n, start, end, tokens = _units(t, block)
            nxt = ends(start, end, tokens, caps, wanted, False)[0] + 1
            many = min(halo, n)
            at, count = np.arange(many if own else 1), np.zeros(many if own else 1, np.int64)
            while (live := at < n).any():  # all entries walk at once
                count[live] += 1
                at = np.where(live, nxt[np.minimum(at, n - 1)], at)
            size = len(at)
            yield pa.RecordBatch.from_arrays([pa.array([session] * size, pa.int64()), pa.array([own] * size, pa.int64()), pa.array(range(size), pa.int64()), pa.array([own + 1] * size, pa.int64()), pa.array(at - n), pa.array(count)], ["session", "block", "entry", "to_block", "to_entry", "segments"])

    steps = materialise(_by_block(cut, transfer, "session long, block long, entry long, to_block long, to_entry long, segments long"), "greedy-steps")
    blocks = (steps.agg(F.max("block")).first()[0] or 0) + 1
    known = steps.filter("block = 0").select("session", "block", "entry", F.lit(0).cast("long").alias("segments"))
    span = 1
    while span < blocks:
        reach = known.withColumnRenamed("segments", "before").join(steps, ["session", "block", "entry"]).select("session", F.col("to_block").alias("block"), F.col("to_entry").alias("entry"), (F.col("before") + F.col("segments")).alias("segments"))
        known = materialise(known.unionByName(reach), "greedy-known")
        span *= 2
        if span < blocks:
            second = steps.select("session", F.col("block").alias("to_block"), F.col("entry").alias("to_entry"), F.col("to_block").alias("_b"), F.col("to_entry").alias("_e"), F.col("segments").alias("_s"))
            steps = materialise(steps.join(second, ["session", "to_block", "to_entry"]).select("session", "block", "entry", F.col("_b").alias("to_block"), F.col("_e").alias("to_entry"), (F.col("segments") + F.col("_s")).alias("segments")), "greedy-steps")
    return known


def _walk(units: DataFrame, caps: Caps, wanted: list[int], block: int, rows: Callable, schema: str) -> DataFrame:
    """``rows`` of every block with its entry: (session, number of the first segment, its segments' first and last units and reasons, units, entry)."""
    cut = _blocked(units, caps.max_events + 1, block)
    entries = _entries(cut, caps, wanted, block)
    joined = cut.join(entries.select("session", "block", "entry", "segments"), ["session", "block"])
    types = [f.split()[1] for f in schema.split(", ")]
    names = [f.split()[0] for f in schema.split(", ")]
    arrow = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("session", "block")):
            session, _, n, start, end, tokens = _units(t, block)
            last, why = ends(start, end, tokens, caps, wanted, len(start) - n <= caps.max_events)
            at, found = int(t["entry"][0].as_py()), []
            while at < n:
                found.append(at)
                at = int(last[at]) + 1
            first = np.array(found, np.int64)
            got = rows(session, int(t["segments"][0].as_py()), first, last[first], why[first], start, end, tokens, n)
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(got, types)], names)

    return _by_block(joined, run, schema)


def segment_units(units: DataFrame, caps: Caps, wanted: list[int] = (), block: int = BLOCK) -> DataFrame:
    """(session, segment, start, end, tokens, reason) of units (session, k, start, end, tokens), k counting from 0 in each session: what ``windows.Segmenter`` makes of them.

    Defined cases: tokens that are null count as 0 and must not be negative, sessions without units have no segments. The block must be longer than ``max_events``.
    """
    if block <= caps.max_events + 1:
        raise ValueError("a block must hold more units than a segment")

    def rows(session, base, first, last, why, start, end, tokens, n):
        upto = np.concatenate([[0], np.cumsum(tokens)])
        return [session] * len(first), base + np.arange(len(first)), start[first], end[last], upto[last + 1] - upto[first], [REASONS[w] for w in why]

    return _walk(units, caps, wanted, block, rows, "session long, segment long, start long, end long, tokens long, reason string")


def fold(events: DataFrame, max_events: int, max_tokens: int, block: int = BLOCK) -> DataFrame:
    """(session, sequence, segment) of events whose sequences are dense from 1: every event is a unit."""
    units = events.select("session", (F.col("sequence") - 1).alias("k"), F.col("sequence").alias("start"), F.col("sequence").alias("end"), F.col("token_count").alias("tokens"))
    caps = Caps(max_events, max_tokens)
    if block <= max_events + 1:
        raise ValueError("a block must hold more events than a segment")

    def rows(session, base, first, last, why, start, end, tokens, n):
        begins = np.zeros(n, np.int64)
        begins[first] = 1
        return [session] * n, start[:n], base - 1 + np.cumsum(begins)

    return _walk(units, caps, [], block, rows, "session long, sequence long, segment long")

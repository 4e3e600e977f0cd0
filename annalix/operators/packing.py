"""Packing of a session's blocks into a token budget.

A session has at most 256 blocks, so one grouped function per session holds them. Blocks that depend on
each other (see ``components``) are taken or left together. Costs are UTF-8 bytes unless counts are given.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .retrieval import SLOTS, slot_rank

RAW = ("raw_delta", "recent_raw")
SEPARATOR = "\n\n"


def utf8_cost(text: str) -> int:
    return len(text.encode())


@dataclass(frozen=True)
class Block:
    block_id: str
    slot: str
    kind: str
    text: str
    sources: tuple[str, ...]
    score: float
    reason: str
    required: bool
    capsule_id: str | None = None
    event_sequence: int | None = None

    def key(self) -> tuple:
        """Total packing order: slot, then sequence for raw blocks or score for others, then all else."""
        raw = self.slot in RAW
        return (SLOTS.index(self.slot), (self.event_sequence or 0) if raw else 0, 0.0 if raw else -self.score, self.block_id, self.kind, self.text, self.sources, self.reason, self.required, self.capsule_id or "")


def packing_order() -> list[Column]:
    """The same order as columns."""
    raw = F.col("slot").isin(*RAW)
    return [
        slot_rank(), F.when(raw, F.coalesce("event_sequence", F.lit(0))).otherwise(0), F.when(raw, 0.0).otherwise(-F.col("score")),
        *map(F.col, ("block_id", "kind", "text", "sources", "reason", "required")), F.coalesce("capsule_id", F.lit("")),
    ]


def components(blocks: list[Block]) -> list[int]:
    """For each block the least index of its dependency component.

    A dependency block binds all blocks of its capsule and all that share a source with it.
    """
    parent = list(range(len(blocks)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    members: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, b in enumerate(blocks):
        for s in b.sources:
            members["source", s].append(i)
        if b.capsule_id is not None:
            members["capsule", b.capsule_id].append(i)
    for own in members.values():
        if any(blocks[i].kind == "dependency" for i in own):
            for i in own[1:]:
                a, b = sorted((root(own[0]), root(i)))
                parent[b] = a
    return [root(i) for i in range(len(blocks))]


def groups(blocks: list[Block]) -> list[list[Block]]:
    """Components in order of their first block."""
    out: dict[int, list[Block]] = {}
    for b, c in zip(blocks, components(blocks)):
        out.setdefault(c, []).append(b)
    return list(out.values())


def removable(blocks: list[Block]) -> list[list[Block]]:
    return [g for g in groups(blocks) if not any(b.required for b in g)]


def closure(selected: Iterable[str], universe: list[Block], most: int) -> list[Block]:
    """All blocks in components that a selected or required block touches; ValueError beyond ``most``."""
    by_id = {b.block_id for b in universe}
    if len(by_id) != len(universe):
        raise ValueError("DEPENDENCY_CLOSURE_DUPLICATE_BLOCK")
    seed = set(selected)
    if not seed <= by_id:
        raise ValueError("DEPENDENCY_CLOSURE_UNKNOWN_BLOCK")
    comp = components(universe)
    touched = {c for b, c in zip(universe, comp) if b.required or b.block_id in seed}
    out = [b for b, c in zip(universe, comp) if c in touched]
    if len(out) > most:
        raise ValueError("DEPENDENCY_CLOSURE_CAPACITY_EXCEEDED")
    return out


class Tray:
    """Chosen blocks with their cost, a separator between each two."""

    def __init__(self, budget: int, cost: dict[str, int], separator: int):
        self.budget, self.cost, self.separator = budget, cost, separator
        self.ids: set[str] = set()
        self.used = 0

    def price(self, blocks: list[Block]) -> int:
        gaps = len(blocks) - (0 if self.ids else 1)
        return sum(self.cost[b.block_id] for b in blocks) + self.separator * max(gaps, 0)

    def offer(self, blocks: list[Block]) -> bool:
        price = self.price(blocks)
        if self.used + price > self.budget:
            return False
        self.used += price
        self.ids.update(b.block_id for b in blocks)
        return True


def normal(blocks: list[Block], tray: Tray) -> list[tuple[Block, str]]:
    """Greedy by first block of each group; what does not fit is skipped, and later groups still get their chance."""
    rejected = []
    for g in groups(blocks):
        if not tray.offer(g):
            rejected += [(b, "INSUFFICIENT_AC_BUDGET") for b in g]
    return rejected


def raw_tail(blocks: list[Block]) -> list[Block]:
    """The unbroken run at the end of the raw blocks."""
    run: list[Block] = []
    for b in reversed([b for b in blocks if b.event_sequence is not None]):
        if run and b.event_sequence + len(b.sources) != run[-1].event_sequence:
            break
        run.append(b)
    return run[::-1]


def emergency(blocks: list[Block], tray: Tray) -> list[tuple[Block, str]]:
    """Only what is required, slot by slot; lone raw blocks keep the longest unbroken suffix that fits."""
    rejected: list[tuple[Block, str]] = []
    group_of = {b.block_id: g for g in groups(blocks) for b in g}
    done: set[str] = set()

    def settle(g: list[Block]) -> None:
        done.update(b.block_id for b in g)
        if not any(b.required for b in g):
            rejected.extend((b, "EMERGENCY_OPTIONAL_OMITTED") for b in g)
        elif not tray.offer(g):
            rejected.extend((b, "EMERGENCY_REQUIRED_NOT_FIT") for b in g)

    for slot in SLOTS:
        for b in blocks:
            if b.slot == slot and b.block_id not in done and not (slot in RAW and len(group_of[b.block_id]) == 1):
                settle(group_of[b.block_id])
        if slot in RAW:
            lone = [b for b in blocks if b.slot == slot and b.block_id not in done]
            tail = raw_tail(lone)
            while tail and not tray.offer(tail):
                tail = tail[1:]
            rejected += [(b, "EMERGENCY_RAW_PREFIX_OMITTED") for b in lone if b not in tail]
            done.update(b.block_id for b in lone)
    return rejected


@dataclass(frozen=True)
class Budget:
    target: int
    ceiling: int
    limit: int
    reserved: int
    margin: int

    @property
    def b_input(self) -> int:
        return min(self.target, self.ceiling, self.limit - self.reserved)


def budget_columns(budget: Budget, current: Column, opaque: Column, fixed: Column, reserved: Column | None = None) -> dict[str, Column]:
    """b_input, b_required and b_ac of requests as columns: token counts of the current message, the opaque and the fixed parts."""
    room = F.lit(budget.limit).cast("long") - (F.lit(budget.reserved) if reserved is None else reserved)
    b_input = F.least(F.lit(budget.target).cast("long"), F.lit(budget.ceiling).cast("long"), room)
    b_required = (current + fixed + F.lit(budget.margin)).cast("long")
    return {"b_input": b_input, "b_required": b_required, "b_ac": F.greatest(F.lit(0).cast("long"), b_input - opaque - b_required)}


@dataclass(frozen=True)
class Assembly:
    mode: str
    error: str
    b_input: int
    b_required: int
    b_ac: int
    selected: list[Block]
    rejected: list[tuple[Block, str]]
    cost: dict[str, int]
    used: int

    @property
    def overhead(self) -> int:
        return self.used - sum(self.cost[b.block_id] for b in self.selected)


def dedupe(blocks: Iterable[Block]) -> tuple[list[Block], list[Block]]:
    first: dict[str, Block] = {}
    again = []
    for b in sorted(blocks, key=Block.key):
        again.append(b) if b.block_id in first else first.setdefault(b.block_id, b)
    return list(first.values()), again


def assemble(blocks: Iterable[Block], current: str, opaque: int, fixed: int, budget: Budget, count: Callable[[str], int] = utf8_cost) -> Assembly:
    """Normal packing; if a required block is left out, emergency packing; then an exact recount."""
    b_required = count(current) + fixed + budget.margin
    b_ac = max(0, budget.b_input - opaque - b_required)
    unique, again = dedupe(blocks)
    cost = {b.block_id: count(b.text) for b in unique}
    fail = lambda error, mode="NORMAL": Assembly(mode, error, budget.b_input, b_required, b_ac, [], [], cost, 0)
    if opaque + b_required > budget.b_input:
        return fail("REQUIRED_INPUT_EXCEEDS_BUDGET")
    mode, tray = "NORMAL", Tray(b_ac, cost, count(SEPARATOR))
    rejected = normal(unique, tray)
    if any(b.required for b, _ in rejected):
        mode, tray = "EMERGENCY_ASSEMBLY", Tray(b_ac, cost, count(SEPARATOR))
        rejected = emergency(unique, tray)
    selected = [b for b in unique if b.block_id in tray.ids]
    if any(b.required and b.block_id not in tray.ids for b in unique):
        return fail("REQUIRED_INPUT_EXCEEDS_BUDGET", mode)
    # a counter need not be additive, so the joined text is counted once more
    while (used := count(SEPARATOR.join(b.text for b in selected))) > b_ac:
        place = {b.block_id: i for i, b in enumerate(selected)}
        spare = removable(selected)
        if not spare:
            return fail("REQUIRED_INPUT_EXCEEDS_BUDGET", mode)
        last = max(spare, key=lambda g: (min(place[b.block_id] for b in g), [b.block_id for b in g]))
        rejected += [(b, "EXACT_BUDGET_COMPONENT_REMOVED") for b in last]
        selected = [b for b in selected if b not in last]
    rejected = [(b, "DUPLICATE_BLOCK_ID") for b in again] + rejected
    rejected.sort(key=lambda r: (SLOTS.index(r[0].slot), r[0].block_id, r[1], -r[0].score))
    return Assembly(mode, "NONE", budget.b_input, b_required, b_ac, selected, rejected, cost, used)


def per_token(blocks: list[Block], scores: dict[str, float], cost: dict[str, int]) -> list[Block]:
    """Optional blocks scored by activation for each token of cost."""
    return [b if b.required else replace(b, score=max(0.0, scores.get(b.block_id, 0.0)) / max(1, cost[b.block_id]), reason="verified_activation_per_token") for b in blocks]


def pack_score(required: Column, score: Column, activation: Column, cost: Column) -> Column:
    """``per_token`` as a column."""
    return F.when(required, score).otherwise(F.greatest(F.lit(0.0), F.coalesce(activation, F.lit(0.0))) / F.greatest(F.lit(1), cost))


def rows_to_blocks(table: pa.Table) -> list[Block]:
    cols = ("block_id", "slot", "kind", "text", "sources", "score", "reason", "required", "capsule_id", "event_sequence")
    return [Block(*r[:4], tuple(r[4]), *r[5:]) for r in zip(*(table[c].to_pylist() for c in cols))]


def assemble_sessions(blocks: DataFrame, current: str, opaque: int, fixed: int, budget: Budget) -> DataFrame:
    """(session, mode, error, block_id, selected, reason, token_cost, b_ac, used): a row for each block and duplicate."""

    def run(table: pa.Table) -> pa.Table:
        a = assemble(rows_to_blocks(table), current, opaque, fixed, budget)
        done = "SELECTED_NORMAL" if a.mode == "NORMAL" else "SELECTED_EMERGENCY"
        rows = [(b.block_id, True, done, a.cost[b.block_id]) for b in a.selected] + [(b.block_id, False, r, a.cost[b.block_id]) for b, r in a.rejected]
        if a.error != "NONE":
            rows = [("", False, a.error, 0)]
        n, cols = len(rows), list(zip(*rows)) or [(), (), (), ()]
        long = lambda x: pa.array(x, pa.int64())
        return pa.table({
            "session": long([table["session"][0].as_py()] * n), "mode": pa.array([a.mode] * n, pa.string()), "error": pa.array([a.error] * n, pa.string()), "block_id": pa.array(cols[0], pa.string()),
            "selected": pa.array(cols[1], pa.bool_()), "reason": pa.array(cols[2], pa.string()), "token_cost": long(cols[3]), "b_ac": long([a.b_ac] * n), "used": long([a.used] * n),
        })

    return blocks.groupBy("session").applyInArrow(run, "session long, mode string, error string, block_id string, selected boolean, reason string, token_cost long, b_ac long, used long")


def greedy_fold(blocks: DataFrame, budget: int, separator: int = 2) -> DataFrame:
    """(session, block_id, selected) without dependency groups, as a JVM fold: skips what does not fit and goes on."""
    rows = blocks.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("position", "block_id", F.octet_length("text").cast("long").alias("cost")))).alias("b"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<block_id:string,selected:boolean>>").alias("out"))

    def step(a, x):
        price = x["cost"] + F.when(a["n"] > 0, separator).otherwise(0)
        fits = a["used"] + price <= budget
        return F.struct(
            (a["used"] + F.when(fits, price).otherwise(0)).alias("used"), (a["n"] + F.when(fits, 1).otherwise(0)).alias("n"),
            F.concat(a["out"], F.array(F.struct(x["block_id"].alias("block_id"), fits.alias("selected")))).alias("out"),
        )

    return rows.select("session", F.explode(F.aggregate("b", zero, step)["out"]).alias("r")).select("session", "r.block_id", "r.selected")


def priority_greedy(blocks: DataFrame, budget: int) -> DataFrame:
    """The older assembler: by descending priority, skipping what does not fit; a session's required block that does not fit is an error."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("priority", "position", "block_id", "tokens", "required"))), key=lambda r: (-r[0], r[1]))
        left, out = budget, []
        for _, _, block, tokens, required in rows:
            fits = tokens <= left
            left -= tokens if fits else 0
            out.append((block, fits, "NONE" if fits or not required else "REQUIRED_BLOCK_DOES_NOT_FIT"))
        cols = list(zip(*out))
        return pa.table({"session": pa.array([table["session"][0].as_py()] * len(out), pa.int64()), "block_id": pa.array(cols[0], pa.string()), "selected": pa.array(cols[1], pa.bool_()), "error": pa.array(cols[2], pa.string())})

    return blocks.select("session", "priority", "position", "block_id", "tokens", "required").groupBy("session").applyInArrow(run, "session long, block_id string, selected boolean, error string")


def reserve(requested: Column, remaining: Column) -> Column:
    return F.least(F.greatest(F.lit(0), requested), remaining)

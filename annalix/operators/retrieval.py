"""Candidate blocks of a session from its capsules and delta, scored against a query.

One projection a source kind; the construction order is an explicit column, since the cap on candidates
counts in that order and the final sort comes after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import render

#: Slots in priority order.
SLOTS = ("active_goal", "hard_constraint", "raw_delta", "exact_anchor", "recent_raw", "active_task", "relevant_evidence", "episode_background", "global_background")
#: Weight of each kind of block.
WEIGHTS = {"goal": 100.0, "constraint": 100.0, "raw_event": 90.0, "exact_anchor": 80.0, "task_context": 50.0, "decision": 40.0, "entity": 30.0, "dependency": 30.0, "episode_background": 10.0, "global_background": 10.0}
#: Labels of the sections of a task's text.
TASK_LABELS = {"progress": "Progress", "open_loop": "Open loops", "preference": "Preferences", "emotional_context": "Emotional context"}


@dataclass(frozen=True)
class Retrieval:
    max_query_characters: int = 2048
    max_capsules: int = 64
    max_delta_events: int = 128
    max_candidates: int = 256
    max_items_per_field: int = 64
    max_lexical_characters: int = 4096
    lexical_weight: float = 10.0


def normalised_query(query: str, c: Retrieval = Retrieval()) -> str:
    """Lower case and single spaces. Lower case stands for case folding, which SQL lacks."""
    return " ".join(query[: c.max_query_characters].lower().split())


def lexical_fraction(query: str, text: Column, c: Retrieval = Retrieval()) -> Column:
    """1 if the whole query is in the text, else the share of its distinct terms that are."""
    q = normalised_query(query, c)
    if not q:
        return F.lit(0.0)
    low = F.lower(F.substring(text, 1, c.max_lexical_characters))
    terms = list(dict.fromkeys(q.split()))
    share = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0)) / F.lit(float(len(terms)))
    return F.when(F.contains(low, F.lit(q)), 1.0).otherwise(share)


def slot_rank(slot: str | Column = "slot") -> Column:
    return F.array_position(F.array(*map(F.lit, SLOTS)), F.col(slot) if isinstance(slot, str) else slot)


def _task_text(lists: str | Column, c: Retrieval) -> Column:
    """The sections of a task from its structured claims, an array of (kind, sequence, text); null without any."""
    of = lambda kind: F.transform(F.slice(F.array_sort(F.filter(lists, lambda x: x["kind"] == kind)), 1, c.max_items_per_field), lambda x: x["text"])
    lines = F.array(*[F.when(F.size(of(k)) > 0, F.concat(F.lit(f"{label}: "), F.array_join(of(k), " | "))) for k, label in TASK_LABELS.items()])
    return F.nullif(F.array_join(F.array_compact(lines), "\n"), F.lit(""))


def by_capsule(items: DataFrame, c: Retrieval = Retrieval()) -> DataFrame:
    """(capsule_id, all_sources, task_text, dep_text, dep_sources): what blocks need of a whole capsule, in one aggregate."""
    claim = F.when(F.col("kind").isin(*TASK_LABELS), F.struct("kind", "sequence", "text"))
    dep = F.when(F.col("kind") == "dependency", F.struct("sequence", "item_id", "text", "source"))
    rows = items.groupBy("capsule_id").agg(F.array_sort(F.collect_set("source")).alias("all_sources"), F.collect_list(claim).alias("claims"), F.array_sort(F.collect_list(dep)).alias("all_deps"))
    rows = rows.withColumn("deps", F.slice("all_deps", 1, c.max_items_per_field))
    return rows.select(
        "capsule_id", "all_sources", _task_text("claims", c).alias("task_text"), F.array_join(F.transform("deps", lambda x: F.concat(x["item_id"], F.lit(":follows->"), x["text"])), " | ").alias("dep_text"),
        F.transform("deps", lambda x: x["source"]).alias("dep_sources"),
    )


def task_texts(capsules: DataFrame, items: DataFrame, c: Retrieval = Retrieval()) -> DataFrame:
    """(capsule_id, task_text) of task capsules that have a structured claim."""
    tasks = capsules.filter("level = 'task'").select("capsule_id")
    return by_capsule(items, c).filter("task_text IS NOT NULL").join(tasks, "capsule_id", "left_semi").select("capsule_id", "task_text")


def cut_required(items: DataFrame, delta: DataFrame, c: Retrieval = Retrieval()) -> DataFrame:
    """(session, lost): whether a limit keeps a required block of the session out. One row a session, from counts alone.

    Required are active goals, constraints and anchors, each a block by capsule and id, and all of the delta. A block is lost if all its items lie
    behind the limits on capsules and on items of a field, or if required blocks and items that aren't lost fill more than ``max_candidates``:
    in order of construction nothing but required blocks stands before the last anchor. An item that comes twice counts twice for that limit.
    """
    field = F.row_number().over(Window.partitionBy("capsule_id", "kind").orderBy("sequence"))
    needed = F.col("kind").isin("goal", "constraint", "anchor")
    # The rank counts all items of the field, the inactive ones too; what is ranked has no texts.
    ranked = items.filter(needed).select("session", "capsule_id", "kind", "item_id", "segment", "sequence", "status").withColumn("few", field).filter("status = 'active'")
    inside = (F.col("segment") < c.max_capsules) & (F.col("few") <= c.max_items_per_field)
    blocks = ranked.groupBy("session", "capsule_id", "kind", "item_id").agg(F.count_if(inside).alias("inside"))
    own = blocks.groupBy("session").agg(F.count_if(F.col("inside") == 0).alias("outside"), F.sum("inside").alias("rows"))
    events = delta.groupBy("session").agg(F.count("*").alias("n"))
    both = own.select("session", "outside", "rows", F.lit(0).cast("long").alias("n")).unionByName(events.select("session", F.lit(0).cast("long").alias("outside"), F.lit(0).cast("long").alias("rows"), "n"))
    total = both.groupBy("session").agg(*[F.sum(k).alias(k) for k in ("outside", "rows", "n")])
    most = max(c.max_delta_events, 0)
    lost = (F.col("outside") > 0) | (F.col("n") > most) | (F.col("rows") + F.least("n", F.lit(most)) > c.max_candidates)
    return total.select("session", lost.alias("lost"))


def candidates(capsules: DataFrame, items: DataFrame, delta: DataFrame, query: str, c: Retrieval = Retrieval()) -> DataFrame:
    """Blocks of every session: block_id, slot, kind, text, sources, score, reason, required, capsule_id, event_sequence, position, required_selection_complete.

    position counts from 0 in retrieval order. required_selection_complete is false in all blocks of a session of which
    a limit cut a required block: that is known from counts (``cut_required``), so the limits are plain filters on ranks and no rows but
    the selected ones, with their texts, go on. The delta has no tool events here: each is one unit.
    Items give their blocks in one projection, capsules theirs in another; both need one aggregate by capsule.
    """
    kind, text, one = F.col("kind"), F.col("text"), F.array("source")
    few = F.row_number().over(Window.partitionBy("capsule_id", "kind").orderBy("sequence"))
    active = F.col("status") == "active"
    own = items.filter(F.col("segment") < c.max_capsules).withColumn("few", few).filter(F.col("few") <= c.max_items_per_field)
    whole = by_capsule(items, c)

    def block(when: Column, phase: int, sub: int, slot, name, block_id: Column, text: Column, sources: Column, required: bool, weight: Column) -> Column:
        lit = lambda v: F.lit(v) if isinstance(v, str) else v
        made = F.struct(
            F.lit(phase).alias("phase"), F.lit(sub).alias("sub"), block_id.alias("block_id"), lit(slot).alias("slot"), lit(name).alias("kind"), text.alias("text"),
            sources.alias("sources"), F.lit(required).alias("required"), weight.cast("double").alias("weight"),
        )
        return F.when(when, made)

    def named(prefix: str, last: str | None = "item_id") -> Column:
        return F.concat_ws(":", F.lit(prefix), "capsule_id", *([last] if last else []))

    decision = F.concat(F.lit("Decision: "), text, F.lit("\nRationale: \nAlternatives: \nSupersedes: \nRejected because: \nDependencies: "), F.col("dep_text"))
    from_items = F.coalesce(
        block(active & (kind == "goal"), 0, 0, "active_goal", "goal", named("goal"), text, one, True, F.lit(100.0)),
        block(active & (kind == "constraint"), 0, 1, "hard_constraint", "constraint", named("constraint"), text, one, True, F.lit(100.0)),
        block(active & (kind == "anchor"), 2, 0, "exact_anchor", "exact_anchor", named("anchor"), text, one, True, F.col("importance") * 80.0),
        block(kind == "decision", 4, 0, "relevant_evidence", "decision", named("decision"), decision, F.array_distinct(F.concat(one, "dep_sources")), False, F.lit(40.0)),
        block(kind == "entity", 4, 1, "relevant_evidence", "entity", named("entity"), F.concat(F.lit("Entity: "), text, F.lit("\nKind: topic\nAliases: ")), one, False, F.lit(30.0)),
        block(kind == "dependency", 4, 2, "relevant_evidence", "dependency", named("dependency"), F.concat(F.lit("Dependency: "), "item_id", F.lit("\nKind: follows\nTarget: "), text), one, False, F.lit(30.0)),
    )
    back, level = F.concat("level", F.lit("_background")), F.col("level")
    from_capsules = F.array_compact(F.array(
        block((level == "task") & F.col("task_text").isNotNull(), 3, 0, "active_task", "task_context", named("task", None), F.col("task_text"), F.col("all_sources"), False, F.lit(50.0)),
        block(level.isin("episode", "global"), 5, 0, back, back, named("background", None), F.concat(F.lit("Summary of "), "capsule_id"), F.col("all_sources"), False, F.lit(10.0)),
    ))
    latest = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("sequence")))
    raw = delta.withColumn("latest", latest).filter(F.col("latest") <= max(c.max_delta_events, 0))
    from_events = block(F.lit(True), 1, 0, "raw_delta", "raw_event", F.concat(F.lit("event:"), "event_id"), render.raw_event(), F.array("event_id"), True, F.lit(90.0))

    rows = own.join(whole.select("capsule_id", "dep_text", "dep_sources"), "capsule_id").select("session", F.col("segment").alias("major"), F.col("sequence").alias("minor"), "capsule_id", F.lit(None).cast("long").alias("event_sequence"), from_items.alias("b")).filter("b IS NOT NULL")
    rows = rows.unionByName(raw.select("session", F.lit(0).cast("long").alias("major"), F.col("sequence").alias("minor"), F.lit(None).cast("string").alias("capsule_id"), F.col("sequence").alias("event_sequence"), from_events.alias("b")))
    made = capsules.filter(F.col("segment") < c.max_capsules).join(whole, "capsule_id")
    rows = rows.unionByName(made.select("session", F.col("segment").alias("major"), F.col("covered_event_start").alias("minor"), "capsule_id", F.lit(None).cast("long").alias("event_sequence"), F.explode(from_capsules).alias("b")))
    rows = rows.select("session", "major", "minor", "capsule_id", "event_sequence", "b.*")

    built = Window.partitionBy("session").orderBy("phase", "major", "sub", "minor", "block_id")
    rows = rows.withColumn("built", F.row_number().over(built)).filter(F.col("built") <= c.max_candidates)
    lost = cut_required(items, delta, c)
    rows = rows.join(lost, "session", "left").withColumn("required_selection_complete", F.coalesce(~F.col("lost"), F.lit(True)))
    rows = rows.withColumn("fraction", lexical_fraction(query, F.col("text"), c))
    fallback = F.when(F.col("fraction") > 0, "LEXICAL_MATCH").otherwise("STRUCTURED_FALLBACK")
    reason = F.when(F.col("phase") == 0, "ACTIVE_REQUIRED").when(F.col("phase") == 1, "UNCOMPACTED_DELTA").when(F.col("phase") == 2, "ACTIVE_EXACT_ANCHOR").otherwise(fallback)
    rows = rows.withColumn("score", F.col("weight") + F.lit(c.lexical_weight) * F.col("fraction")).withColumn("reason", reason)
    is_raw = F.col("slot") == "raw_delta"
    order = Window.partitionBy("session").orderBy(slot_rank(), F.when(is_raw, 0.0).otherwise(-F.col("score")), F.when(is_raw, F.col("event_sequence")).otherwise(0), "block_id")
    rows = rows.withColumn("position", F.row_number().over(order).cast("long") - 1)
    return rows.select("session", "block_id", "slot", "kind", "text", "sources", "required", "capsule_id", "event_sequence", "score", "reason", "position", "required_selection_complete")


def session_blocks(store, query: str, c: Retrieval = Retrieval()) -> DataFrame:
    return candidates(store.capsules, store.items, store.delta, query, c)

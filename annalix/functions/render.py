"""Text projections of events and capsule items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Claim groups in rendering order, and their labels.
CLAIM_LABELS = {"goal": "GOAL", "constraint": "CONSTRAINT", "progress": "PROGRESS", "open_loop": "OPEN_LOOP", "preference": "PREFERENCE", "emotional_context": "EMOTIONAL_CONTEXT"}
ORDER = (*CLAIM_LABELS, "decision", "entity", "anchor")


def raw_event() -> Column:
    return F.format_string("[%s/%s %s]\n%s", "event_type", "role", "event_id", "content")


def item_line() -> Column:
    """The line of one item of the long form."""
    source = F.concat(F.lit(" [source:"), "source", F.lit("]"))
    label = F.create_map(*[F.lit(x) for kv in CLAIM_LABELS.items() for x in kv])
    kind = F.col("kind")
    return (
        F.when(kind.isin(*CLAIM_LABELS), F.concat(label[kind], F.lit(": "), "text", source))
        .when(kind == "decision", F.concat(F.lit("DECISION: "), "text", source))
        .when(kind == "entity", F.concat(F.lit("ENTITY: "), "text", F.lit(" (topic)"), source))
        .when(kind == "anchor", F.concat(F.lit("EXACT_QUOTE: "), "text", source))
    )


def render_capsules(capsules: DataFrame, items: DataFrame) -> DataFrame:
    """(capsule_id, rendered): a header and a line for each active item, groups in fixed order."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    lines = items.filter(F.col("kind").isin(*ORDER) & (F.col("status") == "active")).groupBy("capsule_id").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "sequence", "item_id", item_line().alias("line")))).alias("lines")
    )
    header = F.format_string("[CAPSULE %s EVENTS %d-%d]", "capsule_id", "covered_event_start", "covered_event_end")
    body = F.transform(F.coalesce("lines", F.array().cast("array<struct<rank:bigint,sequence:bigint,item_id:string,line:string>>")), lambda x: x["line"])
    return capsules.join(lines, "capsule_id", "left").select("capsule_id", F.array_join(F.concat(F.array(header), body), "\n").alias("rendered"))

"""The journal and what is derived from it, as typed DataFrames over ``conversations`` and ``events``.

The two journals are stored once an application, bucketed by session, with their sequence numbers (``stored``): what goes by
session needs no shuffle, and filters on session or sequence reach the files. All other tables are lazy plans over them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators import prefix
from . import stored
from .prelude import CLAIM_KINDS, JOB_STATES, LEVELS, PROFILE

#: An event.
JOURNAL = ("session", "event_id", "sequence", "event_type", "role", "content", "source_hook", "idempotency_key", "token_count")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def of(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Events of a session in order of ``turn``, without numbers. Roles other than user and assistant are no events."""
    user = F.col("role") == "user"
    key = F.concat_ws(":", "conv_id", "turn")
    return conversations.filter(F.col("role").isin("user", "assistant")).select(
        F.col("conv_id").alias("session"),
        key.alias("event_id"),
        F.when(user, "USER_MESSAGE").otherwise("ASSISTANT_MESSAGE").alias("event_type"),
        F.when(user, "USER").otherwise("ASSISTANT").alias("role"),
        F.col("text").alias("content"),
        F.when(user, "ON_LLM_REQUEST").otherwise("ON_AGENT_DONE").alias("source_hook"),
        key.alias("idempotency_key"),
        F.octet_length("text").cast("long").alias("token_count"),
        "turn",
    )


def activity_events(events: DataFrame) -> DataFrame:
    """The ``events`` stream as events in order of ``ts`` and id: session is the user, content the props."""
    return events.select(
        F.col("user_id").alias("session"),
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        F.col("props").alias("content"),
        F.octet_length("props").cast("long").alias("token_count"),
        "ts",
        F.col("event_id").alias("id"),
    )


def numbered(events: DataFrame, order: list[str]) -> DataFrame:
    """Events with a dense ``sequence`` in their session, in range blocks so that a session may have any length; the order's columns go."""
    rows = prefix.running(events, ["session"], [F.col(c) for c in order], {"sequence": F.lit(1)})
    return rows.withColumn("sequence", F.col("sequence").cast("long")).drop(*order)


def in_capsules(covered: DataFrame) -> DataFrame:
    """Covered events with the segment and capsule that hold them."""
    segment = F.floor((F.col("sequence") - 1) / 2)
    return covered.withColumn("segment", segment).withColumn("capsule_id", F.concat(F.lit("cap-"), "session", F.lit("-"), segment))


def items_of(covered: DataFrame) -> DataFrame:
    """Capsule items in long form, one row an item, from one pass over the covered events."""
    n = F.col("sequence")

    def item(when: Column, kind: Column, prefix: str, text: Column, status: Column = F.lit("active"), importance: Column = F.lit(1.0)) -> Column:
        made = F.struct(kind.alias("kind"), F.concat(F.lit(prefix), "event_id").alias("item_id"), text.alias("text"), status.alias("status"), importance.alias("importance"))
        return F.when(when, made)

    rows = F.array(
        item(F.lit(True), of(CLAIM_KINDS, (n + F.col("session")) % 6), "claim-", F.col("content"), F.when(n % 5 == 0, "superseded").otherwise("active")),
        item(n % 2 == 1, F.lit("anchor"), "anchor-", F.left("content", F.lit(40)), importance=F.when(n % 4 == 1, 1.0).otherwise(0.5)),
        item(n % 3 == 1, F.lit("decision"), "dec-", F.left("content", F.lit(60))),
        item(n % 4 == 2, F.lit("entity"), "ent-", F.left("content", F.lit(12))),
        item((F.col("segment") >= 1) & (n % 2 == 1), F.lit("dependency"), "dep-", F.concat(F.lit("cap-"), "session", F.lit("-"), F.col("segment") - 1)),
    )
    long = covered.select("session", "capsule_id", "segment", "sequence", F.col("event_id").alias("source"), F.explode(F.array_compact(rows)).alias("i"))
    return long.select("session", "capsule_id", "segment", "i.*", "source", "sequence")


@dataclass(frozen=True)
class Store:
    """All tables of one data folder."""

    spark: SparkSession
    sf_dir: str

    def _kept(self, name: str, source: str, build, sort: tuple[str, ...] = ("sequence",)) -> DataFrame:
        return stored.kept(self.spark, name, f"{self.sf_dir}/{source}.parquet", build, list(sort))

    @cached_property
    def journal(self) -> DataFrame:
        """Columns as in ``StoredJournal``."""
        return self._kept("journal", "conversations", lambda: numbered(conversation_events(read(self.spark, self.sf_dir, "conversations")), ["turn"]).select(*JOURNAL))

    @cached_property
    def activity(self) -> DataFrame:
        return self._kept("activity", "events", lambda: numbered(activity_events(read(self.spark, self.sf_dir, "events")), ["ts", "id"]).select("session", "event_id", "sequence", "event_type", "content", "token_count"))

    @cached_property
    def active(self) -> DataFrame:
        """(session, snapshot_id, pointer_version, covered_event_end) of the active snapshots, stored beside the journal's buckets."""
        return self._kept("active", "conversations", lambda: self.pointers.join(self.snapshots.select("snapshot_id", "covered_event_end"), "snapshot_id").select("session", "snapshot_id", "pointer_version", "covered_event_end"), ())

    @cached_property
    def marks(self) -> DataFrame:
        """High-water mark of every session, and what its snapshot covers."""
        top = F.max("sequence")
        return self.journal.groupBy("session").agg(top.alias("high_water"), F.floor(top / 2).alias("covered"))

    @cached_property
    def _marked(self) -> DataFrame:
        """Events with their session's marks: the journal is already dealt by session, so a window needs no second scan."""
        top = F.max("sequence").over(Window.partitionBy("session"))
        return self.journal.withColumn("high_water", top).withColumn("covered", F.floor(F.col("high_water") / 2))

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.marks.filter("covered >= 1").select(
            F.concat(F.lit("snap-"), "session").alias("snapshot_id"), "session", F.col("covered").alias("covered_event_end"), F.col("covered").alias("source_high_water_mark")
        )

    @cached_property
    def pointers(self) -> DataFrame:
        return self.snapshots.select("session", "snapshot_id", (F.col("session") % 3 + 1).alias("pointer_version"))

    @cached_property
    def covered(self) -> DataFrame:
        return in_capsules(self._marked.filter("sequence <= covered").drop("high_water", "covered"))

    @cached_property
    def audited(self) -> DataFrame:
        """Covered events of the sessions that have three or more, with their number (``covered``): stored beside the journal's buckets, as an audit reads them for each of its inputs."""
        return self._kept("audited", "conversations", lambda: in_capsules(self._marked.filter("sequence <= covered AND covered >= 3").drop("high_water")))

    @cached_property
    def capsules(self) -> DataFrame:
        return self.covered.groupBy("capsule_id", "session", "segment").agg(
            F.min("sequence").alias("covered_event_start"), F.max("sequence").alias("covered_event_end"), F.sum("token_count").alias("token_cost")
        ).withColumn("level", of(LEVELS, (F.col("segment") + F.col("session")) % 4))

    @cached_property
    def memberships(self) -> DataFrame:
        return self.capsules.select(F.concat(F.lit("snap-"), "session").alias("snapshot_id"), F.col("segment").alias("ordinal"), "capsule_id", F.col("level").alias("slot"))

    @cached_property
    def items(self) -> DataFrame:
        return items_of(self.covered)

    @cached_property
    def delta(self) -> DataFrame:
        return self._marked.filter("sequence > covered").drop("high_water", "covered")

    @cached_property
    def metrics(self) -> DataFrame:
        events = self.journal.filter("session % 2 = 0").select(F.lit("EVENT").alias("artifact_kind"), F.col("event_id").alias("artifact_id"), F.lit(PROFILE).alias("profile"), "token_count")
        capsules = self.capsules.filter("segment % 2 = 0").select(F.lit("CAPSULE").alias("artifact_kind"), F.col("capsule_id").alias("artifact_id"), F.lit(PROFILE).alias("profile"), F.col("token_cost").alias("token_count"))
        return events.unionByName(capsules)

    @cached_property
    def intents(self) -> DataFrame:
        return self.journal.filter("session % 2 = 1 AND session % 3 = 0").select(F.lit("EVENT").alias("artifact_kind"), F.col("event_id").alias("artifact_id"), F.lit(PROFILE).alias("profile"), "session")

    @cached_property
    def jobs(self) -> DataFrame:
        s = F.col("session")
        stamp = lambda day: F.concat(F.lit("2026-01-0"), day, F.lit("T00:00:00.000000Z"))
        leased = (s % 10).between(1, 4)
        return self.marks.select(
            F.concat(F.lit("job-"), s).alias("job_id"), "session", of(JOB_STATES, s % 10).alias("state"),
            F.col("high_water").alias("target"), (F.col("high_water") + s % 2).alias("intent"), F.col("covered").alias("base_coverage"),
            F.when(leased, F.concat(F.lit("worker-"), s % 3)).alias("lease_owner"), (s % 4 + 1).alias("lease_epoch"), (s % 3).alias("attempt_count"),
            F.when(leased, stamp(s % 4 + 1)).alias("lease_expires_at"), F.when(s % 10 == 5, stamp(s % 3 + 1)).alias("next_retry_at"),
            F.when((s % 10).isin(5, 8), "TIMEOUT").alias("error_code"), F.concat(F.lit("2025-12-"), s % 20 + 10, F.lit("T00:00:00.000000Z")).alias("created_at"),
        )

"""Durable job state as row rewrites: each function returns the table after the step.

Times are UTC ISO text of fixed width, so text order is time order. The compare-and-swap of a session's
pointer is an exclusive file creation (``Pointers``), that of many sessions at once a version of the tables (``publish_all``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..sources import versions
from ..sources.prelude import OPEN_STATES, WORKING_STATES
from ..sources.scratch import materialise
from . import mutations

#: Steps a worker may take.
STEPS = (("LEASED", "COMPILING"), ("COMPILING", "AUDITING"), ("COMPILING", "READY_TO_COMMIT"), ("AUDITING", "READY_TO_COMMIT"))


def raise_intents(jobs: DataFrame, intents: DataFrame, now: str) -> DataFrame:
    """Intents (session, target, base_coverage) fold into the session's open job by maximum; a session without one gets a pending job."""
    wanted = intents.filter("target > base_coverage").groupBy("session").agg(F.max("target").alias("wanted"), F.max("base_coverage").alias("wanted_base"))
    open_ = F.col("state").isin(*OPEN_STATES)
    held = jobs.filter(open_).select("session").distinct()
    folded = jobs.join(wanted, "session", "left").withColumn("intent", F.when(open_ & (F.col("wanted") > F.col("intent")), F.col("wanted")).otherwise(F.col("intent"))).drop("wanted", "wanted_base")
    new = wanted.join(held, "session", "left_anti").select(
        F.concat(F.lit("job-new-"), "session").alias("job_id"), "session", F.lit("PENDING").alias("state"), F.col("wanted").alias("target"), F.col("wanted").alias("intent"),
        F.col("wanted_base").alias("base_coverage"), F.lit(0).cast("long").alias("lease_epoch"), F.lit(0).cast("long").alias("attempt_count"), F.lit(now).alias("created_at"),
    )
    return folded.unionByName(new, allowMissingColumns=True)


def eligible(now: str):
    return (F.col("state") == "PENDING") | ((F.col("state") == "RETRY_WAIT") & (F.col("next_retry_at") <= now))


def claim(jobs: DataFrame, worker: str, now: str, until: str) -> DataFrame:
    """The oldest eligible job whose intent is not yet covered is leased; covered ones that are older are cancelled."""
    can = eligible(now)
    ranked = jobs.filter(can).select("job_id", "created_at", (F.col("intent") > F.col("base_coverage")).alias("due"))
    winner = ranked.filter("due").orderBy("created_at", "job_id").limit(1).select(F.col("job_id").alias("won"), F.col("created_at").alias("won_at"), "due")
    rows = jobs.withColumn("can", can).join(F.broadcast(winner), F.col("can") == F.col("due"), "left")  # the winner is one row
    take = F.col("job_id") == F.col("won")
    older = F.col("won").isNull() | (F.struct("created_at", "job_id") < F.struct(F.col("won_at"), F.col("won")))
    cancel = can & (F.col("intent") <= F.col("base_coverage")) & older
    take, cancel = F.coalesce(take, F.lit(False)), F.coalesce(cancel, F.lit(False))
    put = lambda k, v: F.when(take, v).otherwise(F.col(k)).alias(k)
    clear = F.when(take | cancel, None)
    return rows.select(
        "job_id", "session", F.when(take, "LEASED").when(cancel, "CANCELLED").otherwise(F.col("state")).alias("state"), put("target", F.col("intent")), "intent", "base_coverage",
        put("lease_owner", F.lit(worker)), put("lease_epoch", F.col("lease_epoch") + 1), put("attempt_count", F.col("attempt_count") + 1), put("lease_expires_at", F.lit(until)),
        clear.otherwise(F.col("next_retry_at")).alias("next_retry_at"), F.when(take, None).otherwise(F.col("error_code")).alias("error_code"), "created_at",
    )


def live_fence(owner: str, epoch: int, now: str):
    return F.coalesce((F.col("lease_owner") == owner) & (F.col("lease_epoch") == epoch) & (F.col("lease_expires_at") > now), F.lit(False))


def legal_steps(jobs: DataFrame, to_state: str) -> DataFrame:
    """(job_id, state, legal): whether a worker may move the job there."""
    ok = F.col("state").isin(*[a for a, b in STEPS if b == to_state])
    return jobs.select("job_id", "state", ok.alias("legal"))


def transition(jobs: DataFrame, owner: str, epoch: int, now: str, to_state: str) -> DataFrame:
    ok = live_fence(owner, epoch, now) & F.col("state").isin(*[a for a, b in STEPS if b == to_state])
    return jobs.withColumn("state", F.when(ok, to_state).otherwise(F.col("state")))


def renew(jobs: DataFrame, owner: str, epoch: int, now: str, until: str) -> DataFrame:
    """A live lease is extended, never shortened."""
    ok = live_fence(owner, epoch, now) & (F.col("lease_expires_at") < until)
    return jobs.withColumn("lease_expires_at", F.when(ok, until).otherwise(F.col("lease_expires_at")))


def fail(jobs: DataFrame, owner: str, now: str, code: str, retry_at: str | None, keep_attempt: bool = False) -> DataFrame:
    """Live leases of the owner end in RETRY_WAIT, or FAILED without a retry time; a kept attempt is given back."""
    ok = F.coalesce((F.col("lease_owner") == owner) & (F.col("lease_expires_at") > now) & F.col("state").isin(*WORKING_STATES), F.lit(False))
    attempts = F.greatest(F.col("attempt_count") - 1, F.lit(0)) if keep_attempt else F.col("attempt_count")
    put = lambda k, v: F.when(ok, v).otherwise(F.col(k))
    values = {"attempt_count": put("attempt_count", attempts), "error_code": put("error_code", F.lit(code)), "next_retry_at": put("next_retry_at", F.lit(retry_at)), "state": put("state", F.lit("FAILED" if retry_at is None else "RETRY_WAIT")), "lease_owner": put("lease_owner", F.lit(None)), "lease_expires_at": put("lease_expires_at", F.lit(None))}
    return jobs.withColumns(values)


def recover(jobs: DataFrame, now: str) -> DataFrame:
    """Expired leases go back to PENDING."""
    ok = F.coalesce(F.col("state").isin(*WORKING_STATES) & (F.col("lease_expires_at") <= now), F.lit(False))
    return jobs.withColumns({"state": F.when(ok, "PENDING").otherwise(F.col("state")), "lease_owner": F.when(ok, None).otherwise(F.col("lease_owner")), "lease_expires_at": F.when(ok, None).otherwise(F.col("lease_expires_at"))})


def finish(jobs: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """Jobs that are ready and hold a live lease end as their proposals did (job_id, outcome); a lease that has run out changes nothing."""
    rows = jobs.join(outcomes.select("job_id", F.col("outcome").alias("_outcome")), "job_id", "left")
    ok = (F.col("state") == "READY_TO_COMMIT") & F.coalesce(F.col("lease_expires_at") > now, F.lit(False)) & F.col("_outcome").isin("COMMITTED", "SUPERSEDED")
    put = lambda k, v: F.when(F.coalesce(ok, F.lit(False)), v).otherwise(F.col(k))
    return rows.withColumns({"lease_owner": put("lease_owner", F.lit(None)), "lease_expires_at": put("lease_expires_at", F.lit(None)), "state": put("state", F.col("_outcome"))}).drop("_outcome")


def follow_ups(finished: DataFrame) -> DataFrame:
    """(job_id, session, target) of jobs to add: (session, job_id, snapshot_id, pointer_version, intent, covered) whose intent exceeds what was covered."""
    parts = F.concat_ws("\0", "job_id", "snapshot_id", F.col("pointer_version").cast("string"), F.col("intent").cast("string"))
    return finished.filter("intent > covered").select(F.concat(F.lit("followup-"), F.substring(F.sha2(parts, 256), 1, 32)).alias("job_id"), "session", F.col("intent").alias("target"))


class Pointers:
    """A session's active snapshot: one file a version, created exclusively, so of two writers one wins. Readers take the largest version."""

    def __init__(self, folder: str):
        self.fs, self.folder = versions.place(folder)

    def read(self, session: str) -> tuple[int, str | None]:
        n = versions.latest(self.fs, f"{self.folder}/{session}")
        return n, self._at(session, n)["snapshot_id"] if n else None

    def _at(self, session: str, version: int) -> dict:
        return versions.manifest(self.fs, f"{self.folder}/{session}", version)

    def swap(self, session: str, expected: int, snapshot: str) -> bool:
        """Moves from the expected version to the next; False if another writer was first."""
        if self.read(session)[0] != expected:
            return False
        return versions.create_new(self.fs, f"{self.folder}/{session}/versions/{expected + 1}.json", json.dumps({"snapshot_id": snapshot}).encode())


def publish(tables: dict[str, DataFrame], folder: str, pointers: Pointers, session: str, expected: int, snapshot: str) -> str:
    """Writes one candidate's tables as a snapshot of their own, then swaps the pointer: COMMITTED, or SUPERSEDED and nothing visible. Many sessions at once: ``publish_all``."""
    spark = next(iter(tables.values())).sparkSession
    own = versions.Versions(spark, f"{folder}/snapshots/{snapshot}")
    if not own.commit(0, append=tables, note=session):
        return "SUPERSEDED"
    if pointers.swap(session, expected, snapshot):
        return "COMMITTED"
    own.fs.delete_dir(own.root)
    return "SUPERSEDED"


def publish_all(store: versions.Versions, proposals: DataFrame, reports: DataFrame, rows: dict[str, DataFrame]) -> tuple[int, DataFrame]:
    """(version made, outcomes) of candidates of many sessions, published in one step.

    proposals: (session, snapshot_id, expected, covered_event_end); reports: (session, passed); rows: tables with session and snapshot_id,
    of which those of committed snapshots are appended. Outcomes follow from the pointers of the version that the commit builds on: if another
    writer publishes first, they are decided anew against its pointers. The tables ``pointers`` and ``snapshots`` go along; a version's outcomes are its table ``outcomes``.
    """
    spark = store.spark

    def change(base: int) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        known = store.manifest(base)["tables"]
        now = store.read("pointers", base) if "pointers" in known else spark.createDataFrame([], "session long, snapshot_id string, pointer_version long")
        told = materialise(mutations.publish(now, proposals.select("session", "snapshot_id", "expected"), reports), "outcomes")
        won = told.filter("outcome = 'COMMITTED'").select("session", "snapshot_id", (F.col("expected") + 1).alias("pointer_version"))
        kept = now.join(won.select("session"), "session", "left_anti").select("session", "snapshot_id", "pointer_version")
        new = {t: df.join(won.select("session", "snapshot_id"), ["session", "snapshot_id"], "left_semi") for t, df in rows.items()}
        snapshots = proposals.join(won.select("session", "snapshot_id"), ["session", "snapshot_id"], "left_semi").select("session", "snapshot_id", "covered_event_end")
        return {**new, "snapshots": snapshots}, {"outcomes": told, "pointers": kept.unionByName(won)}

    version = store.update(change)
    return version, store.read("outcomes", version)

"""Triggers to stored jobs, exactly once: each micro-batch folds the largest target of every session into the jobs of a ``Versions`` folder.

A version holds the jobs and the number of the last batch of each queue that is in them. A batch that comes again, after a
restart or because its commit wasn't noted, finds its number there and changes nothing; a batch that loses the race against
another writer is folded anew into the jobs of the version that won.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import jobs
from ..sources.prelude import NOW
from ..sources.scratch import materialise
from ..sources.versions import Versions

JOBS = "job_id string, session long, state string, target long, intent long, base_coverage long, lease_owner string, lease_epoch long, attempt_count long, lease_expires_at string, next_retry_at string, error_code string, created_at string"


class Queue:
    """Triggers (session, target, base_coverage) of one stream. Sessions and targets that are null trigger nothing; a target that isn't beyond its base raises no intent."""

    def __init__(self, store: Versions, name: str, now: Callable[[], str] = lambda: NOW):
        self.store, self.name, self.now = store, name, now

    def jobs(self, version: int | None = None) -> DataFrame:
        known = self.store.manifest(version)
        if "jobs" not in known["tables"]:
            return self.store.spark.createDataFrame([], JOBS)
        return self.store.read("jobs", known["version"])

    def _marks(self, base: int) -> DataFrame:
        if "queues" not in self.store.manifest(base)["tables"]:
            return self.store.spark.createDataFrame([], "queue string, batch long")
        return self.store.read("queues", base)

    def last_batch(self, version: int | None = None) -> int:
        version = self.store.latest() if version is None else version
        row = self._marks(version).filter(F.col("queue") == self.name).agg(F.max("batch")).first()
        return -1 if row[0] is None else row[0]

    def apply(self, batch: DataFrame, batch_id: int, tries: int = 8) -> bool:
        """Folds a batch in; False if it is in already. What ``foreachBatch`` calls."""
        wanted = batch.filter("session IS NOT NULL AND target IS NOT NULL").groupBy("session").agg(F.max("target").alias("target"), F.max(F.coalesce("base_coverage", F.lit(0))).alias("base_coverage"))
        wanted = materialise(wanted, "triggers")  # one row a session, whatever the batch holds
        for _ in range(tries):
            base = self.store.latest()
            if self.last_batch(base) >= batch_id:
                return False
            raised = jobs.raise_intents(self.jobs(base), wanted, self.now())
            rows = raised.select(*[F.col(c).cast(t) for c, t in (x.split() for x in JOBS.split(", "))])
            others = self._marks(base).filter(F.col("queue") != self.name)
            mark = self.store.spark.createDataFrame([(self.name, batch_id)], "queue string, batch long")
            if self.store.commit(base, replace={"queues": others.unionByName(mark), "jobs": rows}, note=f"{self.name} {batch_id}"):
                return True
        raise RuntimeError(f"{tries} other versions came first")

    def run(self, triggers: DataFrame, checkpoint: str, available_now: bool = True):
        """Starts the stream; the checkpoint numbers its batches, so it goes with the queue's name."""
        out = triggers.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.apply(df, n) and None)
        return (out.trigger(availableNow=True) if available_now else out).start()

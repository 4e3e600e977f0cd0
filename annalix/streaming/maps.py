"""State with an end: maps that forget what was used longest ago, and leases that run out by themselves.

``Recent`` keeps for each shard of keys a map state of its most recently used ones, which a time to live bounds as
well; the last few of all shards are the last few of all. ``Leases`` keeps the lease of a job and a timer at its end:
when the watermark passes it without a renewal, the job is pending again, without a scan over all jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Map states, timers and times to live need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Recent(StatefulProcessor):
    """A shard's ``most`` last used keys. After each batch that changes them they are given out, with the batch's number in the shard."""

    def __init__(self, most: int, ttl_ms: int | None = None):
        self.most, self.ttl = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "key long", "at long", self.ttl)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, int] = {}
        for part in rows:  # what a batch can leave behind is as little as the map itself
            for k, at in part.groupby("key")["at"].max().items():
                new[int(k)] = max(int(at), new.get(int(k), int(at)))
            new = dict(sorted(new.items(), key=lambda x: (-x[1], x[0]))[: self.most])
        old = {int(k[0]): int(v[0]) for k, v in self.held.iterator()}
        both = old | {k: max(at, old.get(k, at)) for k, at in new.items()}
        kept = dict(sorted(both.items(), key=lambda x: (-x[1], x[0]))[: self.most])
        for k in old.keys() - kept.keys():
            self.held.removeKey((k,))
        for k, at in kept.items():
            if old.get(k) != at:
                self.held.updateValue((k,), (at,))
        n = (self.count.get()[0] if self.count.exists() else 0) + 1
        self.count.update((n,))
        yield pd.DataFrame({"shard": [key[0]] * len(kept), "round": [n] * len(kept), "key": list(kept), "at": list(kept.values())}).astype("int64")

    def close(self) -> None:
        pass


def recent(uses: DataFrame, most: int, shards: int = 16, ttl_ms: int | None = None) -> DataFrame:
    """(shard, round, key, at) of a stream of uses (key long, at: microseconds). Ties in time go to the lesser key."""
    rows = uses.filter("key IS NOT NULL AND at IS NOT NULL").select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "at")
    return rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=Recent(most, ttl_ms), outputStructType="shard long, round long, key long, at long", outputMode="append", timeMode="none" if ttl_ms is None else "ProcessingTime")


def last_of_all(given: DataFrame, most: int) -> DataFrame:
    """(key, at): what one map of ``most`` entries would hold, from the newest round of every shard."""
    newest = given.withColumn("newest", F.max("round").over(_shard())).filter("round = newest")
    return newest.orderBy(F.desc("at"), "key").limit(most).select("key", "at")


def _shard():
    from pyspark.sql import Window

    return Window.partitionBy("shard")


class Leases(StatefulProcessor):
    """A job's lease, and a timer at its end. A later end renews the lease, an earlier one changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "owner string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until, owner = self.lease.get()[::-1] if self.lease.exists() else (None, None)
        for part in rows:
            for r in part.itertuples():
                if r.until == r.until and r.until is not None and (until is None or int(r.until) > until):
                    if until is not None:
                        self.handle.deleteTimer(until)
                    until, owner = int(r.until), r.owner
                    self.handle.registerTimer(until)
                    self.lease.update((owner, until))
        yield pd.DataFrame({"job_id": pd.Series(dtype=str), "owner": pd.Series(dtype=str), "until": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        owner, until = self.lease.get()
        self.lease.clear()
        yield pd.DataFrame({"job_id": [key[0]], "owner": [owner], "until": [until]})

    def close(self) -> None:
        pass


def expired_leases(leases: DataFrame) -> DataFrame:
    """(job_id, owner, until) of leases that have run out, as soon as the watermark on ``ts`` shows it. Input: (job_id, owner, until in milliseconds, ts); rows without an end only move the watermark."""
    rows = leases.withWatermark("ts", "0 seconds").select("job_id", "owner", "until", "ts")
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Leases(), outputStructType="job_id string, owner string, until long", outputMode="append", timeMode="EventTime")

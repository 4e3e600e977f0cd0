"""Streams whose state ends: trigger queues, maps and leases."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalix.sources.versions import Versions
from annalix.streaming import maps, queue

TRIGGERS = "session long, target long, base_coverage long"


def frame(spark, rows):
    return spark.createDataFrame(rows, TRIGGERS)


def intents(q, version=None):
    return {r.session: (r.intent, r.target) for r in q.jobs(version).collect()}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    q = queue.Queue(Versions(spark, str(tmp_path)), "a")
    assert q.last_batch() == -1 and intents(q) == {}
    assert q.apply(frame(spark, [(1, 5, 0), (1, 7, 0), (2, 3, 3), (3, 4, 1), (None, 9, 0), (4, None, 0)]), 0)
    assert intents(q) == {1: (7, 7), 3: (4, 4)}
    assert not q.apply(frame(spark, [(1, 99, 0)]), 0) and q.store.latest() == 1
    assert q.apply(frame(spark, [(1, 9, 0), (3, 2, 0)]), 1)
    assert intents(q) == {1: (9, 7), 3: (4, 4)} and intents(q, 1) == {1: (7, 7), 3: (4, 4)}
    assert q.apply(frame(spark, []), 2) and q.last_batch() == 2


def test_two_queues_share_jobs_and_race(spark, tmp_path, monkeypatch):
    a, b = (queue.Queue(Versions(spark, str(tmp_path)), n) for n in "ab")
    old, raced = Versions.commit, []

    def commit(self, base, append=None, replace=None, note=""):
        if self is a.store and not raced:  # the other queue is faster
            raced.append(1)
            b.apply(frame(spark, [(1, 8, 0), (5, 2, 0)]), 4)
        return old(self, base, append, replace, note)

    monkeypatch.setattr(Versions, "commit", commit)
    assert a.apply(frame(spark, [(1, 6, 0), (6, 1, 0)]), 0)
    assert intents(a) == {1: (8, 8), 5: (2, 2), 6: (1, 1)} and (a.last_batch(), b.last_batch()) == (0, 4)


def test_recent_keys_over_batches(spark, tmp_path):
    """The map after each batch is that of all uses so far, and no state holds more keys than it may."""
    maps.use_rocksdb(spark)
    rows = [[(k * 7 % 23, n) for n, k in enumerate(range(60))], [(3, 70), (3, 60), (9, 70), (None, 99)], [(k, 100 + k) for k in range(40, 46)]]
    schema, folder, seen, given = "key long, at long", str(tmp_path / "in"), [], []
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = maps.recent(spark.readStream.schema(schema).parquet(folder), 5, shards=3)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: given.extend(map(tuple, df.collect()))).start().awaitTermination()
        seen += [r for r in part if r[0] is not None]
        latest = {k: max(a for x, a in seen if x == k) for k, _ in seen}
        want = sorted(latest.items(), key=lambda x: (-x[1], x[0]))[:5]
        got = maps.last_of_all(spark.createDataFrame(given, "shard long, round long, key long, at long"), 5)
        assert [tuple(r) for r in got.orderBy(F.desc("at"), "key").collect()] == want
    assert max(sum(1 for r in given if r[:2] == s) for s in {r[:2] for r in given}) <= 5


def test_leases_run_out_unless_renewed(spark, tmp_path):
    maps.use_rocksdb(spark)
    schema, folder, gone = "job_id string, owner string, until long, ts timestamp", str(tmp_path / "in"), []
    second = lambda n: F.timestamp_seconds(F.lit(n))
    parts = [
        [("a", "w1", 10_000, 1), ("b", "w2", 20_000, 1), ("c", None, None, 1), ("d", "w4", 90_000, 1)],
        [("a", "w1", 40_000, 5), ("b", "w2", 15_000, 5)],  # a is renewed, b's earlier end changes nothing
        [("clock", None, None, 21)],
        [("clock", None, None, 41), ("b", "w9", 60_000, 41)],
        [("clock", None, None, 61)],
    ]
    told = []
    for part in parts:
        rows = spark.createDataFrame([(j, o, u) for j, o, u, _ in part], "job_id string, owner string, until long").withColumn("ts", second(part[0][3]))
        rows.coalesce(1).write.mode("append").parquet(folder)
        stream = maps.expired_leases(spark.readStream.schema(schema).parquet(folder))
        gone.clear()
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: gone.extend(map(tuple, df.collect()))).start().awaitTermination()
        told.append(sorted(gone))
    assert told == [[], [], [("b", "w2", 20_000)], [("a", "w1", 40_000)], [("b", "w9", 60_000)]]

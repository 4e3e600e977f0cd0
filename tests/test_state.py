"""Capture, conflicts, pointers, encryption, audits and streams."""

from __future__ import annotations

import hashlib
import json

from conftest import SMALL
from pyspark.sql import functions as F

from annalix.functions import scalars
from annalix.operators import audit, checks, jobs, mutations, windows
from annalix.plans.composite_queries import _FAULTS, candidates
from annalix.sources import Store, read
from annalix.streaming import ingest


def test_session_key_json(spark):
    null = F.lit(None)
    key = scalars.session_key_json(F.lit("local"), F.lit("friend_message"), F.lit("s1"), null, F.lit("u1"), F.lit("c1"), null)
    got = spark.range(1).select(key.alias("k")).first()[0]
    assert got == '{"platform_instance_id":"local","message_type":"friend_message","session_id":"s1","group_id":null,"user_id":"u1","conversation_id":"c1","persona_id":null}'
    assert hashlib.sha256(got.encode()).hexdigest() == spark.range(1).select(F.sha2(key, 256)).first()[0]


def test_only_four_triples_are_legal(spark):
    kinds, roles, hooks = zip(*checks.TRIPLES)
    every = [(k, r, h) for k in kinds for r in dict.fromkeys(roles) for h in hooks]
    legal = spark.createDataFrame(every, "event_type string, role string, source_hook string").filter(checks.legal_triple())
    assert {tuple(r) for r in legal.collect()} == set(checks.TRIPLES)


def test_pressure(spark):
    def decide(trusted, estimate, current):
        got = scalars.pressure(F.lit(trusted), F.lit(estimate), F.lit(current), 100, 0, 0.75, 0.80)
        return tuple(spark.range(1).select(*[got[k].alias(k) for k in ("used", "compact_at", "project_at", "should_compact", "should_project")]).first())

    assert decide(80, 10, 1) == (81, 75, 80, True, True)
    assert decide(0, 76, 4) == (76, 75, 80, True, False)


def test_casefold_is_not_lower(spark):
    df = spark.createDataFrame([("Straße İ",)], "t string")
    assert df.select(scalars.casefold("t")).first()[0] == "Straße İ".casefold() != "Straße İ".lower()


def test_model_identity(spark):
    rows = [(" gpt ",), ("a b",), ("",), ("x" * 257,), (None,), ("a​b",)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string").select(scalars.model_identity(F.col("m"))).collect()]
    assert got == ["gpt", None, None, None, None, None]


def test_capture_is_idempotent(spark):
    s = Store(spark, SMALL)
    stored = s.journal.select(*mutations.KEY, "sequence")
    batch = stored.select(*mutations.KEY, F.col("sequence").alias("arrival"))
    assert mutations.capture(stored, batch).isEmpty()
    assert mutations.replay_conflicts(s.journal.unionByName(s.journal), mutations.KEY, ["content"]).isEmpty()


def test_a_batch_that_repeats_itself(spark):
    """Replays and conflicts within one batch, as if its rows came one by one."""
    M = "artifact_kind string, artifact_id string, profile string, token_count long"
    stored = spark.createDataFrame([("E", "s", "p", 3), ("E", "n", "p", None)], M)
    new = spark.createDataFrame([("E", "a", "p", 1), ("E", "a", "p", 1), ("E", "b", "p", 1), ("E", "b", "p", 2), ("E", "s", "p", 3), ("E", "s", "p", 4), ("E", "n", "p", None)], M)
    fresh, bad = mutations.put_metrics(stored, new)
    assert [tuple(r) for r in fresh.collect()] == [("E", "a", "p", 1)]
    assert sorted((r.artifact_id, r.token_count) for r in bad.collect()) == [("b", 1), ("b", 2), ("s", 4)]
    seen = spark.createDataFrame([("E", "x", "p", None, 1), ("E", "x", "p", None, 1), ("E", "y", "p", 5, 1), ("E", "y", "p", 5, 1), ("E", "z", "p", None, 1)], M + ", session long")
    counted, intents = mutations.observations(seen, stored.filter("false").unionByName(spark.createDataFrame([("E", "z", "p", None)], M)))
    assert [tuple(r) for r in counted.collect()] == [("E", "y", "p", 5)] and [r.artifact_id for r in intents.collect()] == ["x"]
    C = "id string, body string"
    told = mutations.insert_or_verify(spark.createDataFrame([("v", "1"), ("c", "1"), ("w", "1")], C), spark.createDataFrame([("v", "1"), ("v", "1"), ("c", "2"), ("w", "1"), ("w", "2"), ("i", "1"), ("i", "1"), ("j", "1"), ("j", "2")], C), "id", F.col("body"))
    assert {r.id: r.action for r in told.collect()} == {"v": "VERIFIED", "c": "CONFLICT", "w": "CONFLICT", "i": "INSERT", "j": "CONFLICT"} and told.count() == 5
    S = "session long, covered_event_end long, snapshot_id string"
    added = mutations.new_snapshots(spark.createDataFrame([(1, 5, "a")], S), spark.createDataFrame([(1, 5, "b"), (1, 6, "d"), (1, 6, "c"), (2, 5, "e"), (2, 5, "e")], S))
    assert sorted(map(tuple, added.collect())) == [(1, 6, "c"), (2, 5, "e")]


def test_pointer_swap_has_one_winner(tmp_path, spark):
    p, q = jobs.Pointers(str(tmp_path)), jobs.Pointers(str(tmp_path))
    assert p.read("s") == (0, None)
    assert p.swap("s", 0, "a") and not q.swap("s", 0, "b") and q.swap("s", 1, "b")
    assert p.read("s") == (2, "b")
    rows = spark.range(3)
    assert jobs.publish({"capsules": rows}, str(tmp_path / "d"), p, "t", 0, "snap-1") == "COMMITTED"
    assert jobs.publish({"capsules": rows}, str(tmp_path / "d"), p, "t", 0, "snap-2") == "SUPERSEDED"
    assert not (tmp_path / "d/snapshots/snap-2").exists() and p.read("t") == (1, "snap-1")


def test_one_code_for_each_fault(spark):
    got = {r["session"]: r["failure_codes"] for r in audit.validate(candidates(Store(spark, "/root/testdata/sf0.01"))).collect()}
    assert {s % 19 for s in got} >= set(range(1, 17))
    for session, codes in got.items():
        want = _FAULTS.get(session % 19)
        assert (want in codes) if want else codes == []


def test_streamed_sequences_are_those_of_the_batch(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{SMALL}/events.parquet", tmp_path / "in/events.parquet")
    schema = read(spark, SMALL, "events").schema
    stream = ingest.event_stream(spark, str(tmp_path / "in"), schema).withColumnRenamed("user_id", "session")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ingest.run_once(ingest.allocate(ingest.once(stream, ["event_id"])), "sequences", str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.table("sequences").select("session", "event_id", "sequence").collect()}
    want = {(r["session"], int(r["event_id"]), r["sequence"]) for r in Store(spark, SMALL).activity.collect()}
    assert got == want


def test_streamed_tool_loop_over_two_batches(spark, tmp_path):
    call = json.dumps({"kind": "call", "tool": "t", "arguments": {}})
    result = json.dumps({"kind": "result", "tool": "t", "arguments": {}})
    schema = "session long, sequence long, event_type string, content string"
    folder = str(tmp_path / "in")
    parts = [[(1, 1, "TOOL_CALL", call), (2, 1, "USER_MESSAGE", "x")], [(1, 2, "TOOL_RESULT", result), (1, 3, "ASSISTANT_MESSAGE", "done"), (2, 3, "USER_MESSAGE", "gap")]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        q = ingest.track_tools(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q.foreachBatch(lambda df, _: found.extend(tuple(r) for r in df.collect())).start().awaitTermination()
    assert set(found) == {(2, 1, 1, "unit"), (1, 1, 3, "unit"), (2, 3, 3, "invalid")}


def test_folded_segments_are_those_of_the_loop(spark):
    s = Store(spark, SMALL)
    folded = windows.fold_segments(s.activity, 16, 120).groupBy("session", "segment").agg(F.min("sequence").alias("start"), F.max("sequence").alias("end"))
    plain = s.activity.withColumn("event_type", F.lit("USER_MESSAGE"))
    looped = windows.segment_sessions(plain, windows.Caps(16, 120)).select("session", "segment", "start", "end")
    assert folded.exceptAll(looped).isEmpty() and looped.exceptAll(folded).isEmpty()

"""The stored journal: what its plans read and shuffle, and what appends add."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from annalix.operators import scans
from annalix.sources import Store, StoredJournal, stored
from annalix.sources.stored import SPLIT

BATCH = "session long, event_id string, event_type string, role string, content string, source_hook string, idempotency_key string, token_count long, arrival long"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def merge_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_scans_shuffle_nothing_and_reach_the_files(spark, merge_joins):
    s = Store(spark, SMALL)
    ranged = plan(scans.event_range(s.journal, 1, 4))
    assert "Exchange" not in ranged and re.search(r"PushedFilters: \[[^]]*GreaterThan\(sequence,1\)[^]]*LessThanOrEqual\(sequence,4\)", ranged)
    for df in (scans.request_view(s.journal, s.active), scans.frozen_view(s.journal, s.jobs), s.marks, s.delta, s.capsules, s.journal.join(s.pointers, "session")):
        assert "Exchange" not in plan(df)
    found = s.journal.select("session", F.regexp_extract(F.input_file_name(), r"_(\d+)\.c\d+", 1).alias("bucket")).distinct().collect()
    assert len(found) == len({r.session for r in found}) and all(r.bucket for r in found)


def test_the_stored_journal_is_the_window_over_the_files(spark):
    from pyspark.sql import Window

    from annalix.sources import conversation_events, read

    rows = conversation_events(read(spark, SMALL, "conversations"))
    want = rows.withColumn("sequence", F.row_number().over(Window.partitionBy("session").orderBy("turn")).cast("long")).drop("turn")
    got = Store(spark, SMALL).journal
    assert got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == want.count()


def test_changed_files_make_a_new_table(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string").write.parquet(path)
    assert Store(spark, str(tmp_path)).journal.count() == 1
    spark.createDataFrame([(1, 1, "assistant", "b"), (1, 2, "tool", "c")], "conv_id long, turn long, role string, text string").write.mode("append").parquet(path)
    assert [(r.sequence, r.role) for r in Store(spark, str(tmp_path)).journal.orderBy("sequence").collect()] == [(1, "USER"), (2, "ASSISTANT")]


def batch(spark, rows):
    return spark.createDataFrame([(s, f"{s}:{k}", "USER_MESSAGE", "USER", c, "H", k, 1, a) for s, k, c, a in rows], BATCH)


def test_appends_number_on_and_can_be_sent_again(spark, tmp_path):
    j = StoredJournal(spark, str(tmp_path / "j"))
    first = batch(spark, [(1, "a", "x", 5), (1, "b", "y", 3), (2, "a", "z", 1), (1, "b", "late", 9), (None, "n", "q", 1)])
    assert j.append(first) == 3 and j.append(first) == 0 and j.append(first.limit(0)) == 0
    assert j.append(batch(spark, [(1, "c", "w", 2), (1, "a", "again", 1), (3, "a", "v", 4)])) == 2
    got = {(r.session, r.idempotency_key): (r.sequence, r.content) for r in j.table.collect()}
    assert got == {(1, "b"): (1, "y"), (1, "a"): (2, "x"), (2, "a"): (1, "z"), (1, "c"): (3, "w"), (3, "a"): (1, "v")}
    assert {r.session: r.high_water for r in j.heads().collect()} == {1: 3, 2: 1, 3: 1} and "Exchange" not in plan(j.heads())
    # Another application finds the folder, with its number of buckets, whatever its own settings are.
    spark.sql(f"DROP TABLE {j.name}")
    spark.conf.set("annalix.journal.buckets", "9")
    try:
        again = StoredJournal(spark, str(tmp_path / "j"))
        assert again.n == j.n and again.table.count() == 5 and again.append(batch(spark, [(2, "b", "u", 1)])) == 1
    finally:
        spark.conf.unset("annalix.journal.buckets")


def test_a_hot_session_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "SPLIT", 500)
    j = StoredJournal(spark, str(tmp_path / "j"))
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("session"), F.col("id").cast("string").alias("event_id"), F.lit("USER_MESSAGE").alias("event_type"), F.lit("USER").alias("role"), F.lit("c").alias("content"), F.lit("H").alias("source_hook"), F.col("id").cast("string").alias("idempotency_key"), F.lit(1).cast("long").alias("token_count"), F.col("id").alias("arrival"))
    assert j.append(rows) == 4000 and SPLIT > 500
    files = j.table.groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 3 and max(r["count"] for r in files) < 4000
    assert j.table.filter("sequence <> CAST(event_id AS LONG) + 1").isEmpty()

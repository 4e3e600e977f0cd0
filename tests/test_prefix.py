"""Blocked running sums against a plain window."""

from __future__ import annotations

import pytest
from pyspark.sql import Window, functions as F

from annalix.operators import prefix


@pytest.mark.parametrize("blocks", (1, 3, 7))
def test_running_sums_equal_a_window(spark, blocks):
    rows = [(None if n % 11 == 0 else ("hot" if n % 3 else f"k{n % 5}"), n * 7919 % 1009, None if n % 13 == 0 else n % 17) for n in range(1000)]
    df = spark.createDataFrame(rows, "key string, at long, cost long").withColumn("_extra", F.lit(1))
    got = prefix.running(df, ["key"], [F.col("at")], {"total": F.col("cost"), "seen": F.lit(1)}, blocks)
    w = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"total": F.sum(F.coalesce("cost", F.lit(0))).over(w), "seen": F.count("*").over(w)})
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_running_without_keys_and_rows(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    got = prefix.running(df, [], [F.col("id").desc()], {"s": F.col("x")}, 5)
    assert {r.id: r.s for r in got.collect()} == {i: sum(2 * j for j in range(i, 100)) for i in range(100)}
    assert prefix.running(df.filter("id < 0"), [], [F.col("id")], {"s": F.col("x")}).count() == 0


def test_no_task_holds_a_whole_group(spark):
    df = spark.range(20_000).select(F.lit("one").alias("key"), F.col("id"))
    cut = prefix.in_blocks(df, ["key"], [F.col("id")], 8)
    sizes = [r["count"] for r in cut.groupBy(prefix.BLOCK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


@pytest.mark.parametrize("most", (1 << 22, 40))
def test_windows_of_a_hot_session(spark, most):
    """A session of half of the rows: numbers, runs and suffixes are the same by a window and block by block."""
    from annalix.operators import windows

    rows = [(0 if n % 2 else n % 9 + 1, n * 37 % 1009, n % 5 + 1, n % 13 + 1) for n in range(1000)]
    df = spark.createDataFrame(rows, "session long, event_sequence long, n_sources long, cost long")
    got = windows.allocate(df, ["event_sequence"], most)
    order = {}
    for s, e, *_ in sorted(rows):
        order[s, e] = sum(1 for x in order if x[0] == s) + 1
    assert {(r.session, r.event_sequence): r.sequence for r in got.collect()} == order
    by = {s: sorted(r for r in rows if r[0] == s) for s in {r[0] for r in rows}}
    runs, suffixes, units = set(), {}, set()
    for s, own in by.items():
        start = max([k for k in range(1, len(own)) if own[k][1] != own[k - 1][1] + own[k - 1][2]], default=0)
        runs |= {(s, r[1]) for r in own[start:]}
        for k in range(len(own)):
            cost = sum(r[3] for r in own[k:]) + 2 * (len(own) - k - 1)
            if cost <= 90:
                suffixes[s, own[k][1]] = cost
            if sum(r[2] for r in own[k:]) <= 17 or k == len(own) - 1:
                units.add((s, own[k][1]))
    assert {(r.session, r.event_sequence) for r in windows.tail_run(df, most).collect()} == runs
    assert {(r.session, r.event_sequence): r.suffix_cost for r in windows.suffix_within(df, 90, most=most).collect()} == suffixes
    named = df.select("session", F.col("event_sequence").alias("start"), F.col("n_sources").alias("size"))
    assert {(r.session, r.start) for r in windows.last_units(named, 17, most).collect()} == units
    line = spark.createDataFrame([(s, 3 * k - (2 if k > 700 else 0), 3, 1) for s in (1, 2) for k in range(1000)], df.schema)
    assert windows.tail_run(line, most).count() == 2 * 299

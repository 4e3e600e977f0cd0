"""Segments by blocks against the sequential machine."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalix.operators import greedy, windows
from annalix.operators.windows import Caps
from annalix.sources.scratch import materialise

UNITS = "session long, k long, start long, end long, tokens long"


def random_units(draw, n, sizes=(1, 1, 1, 2, 5, 9), tokens=(0, 1, 3, 10, 40)):
    at, out = 1, []
    for _ in range(n):
        size = int(draw.choice(sizes))
        out.append((at, at + size - 1, int(draw.choice(tokens))))
        at += size
    return out


@pytest.mark.parametrize("seed", range(6))
def test_ends_are_the_machine_s(seed):
    """From every unit on, the first segment is the one that the machine would make there."""
    draw = np.random.default_rng(seed)
    units = random_units(draw, 120)
    for caps, wanted in ((Caps(8, 50), []), (Caps(3, 1000), [7, 13, 60, 61]), (Caps(100, 30), [1, 2, 300]), (Caps(4, 9, 2), [40, 5, 9])):
        start, end, tokens = (np.array(c, np.int64) for c in zip(*units))
        last, why = greedy.ends(start, end, tokens, caps, wanted, True)
        for i in range(len(units)):
            s = windows.segments(units[i:], caps, wanted)[0]
            assert (end[last[i]], greedy.REASONS[why[i]]) == (s[1], s[3]), (caps, i)


@pytest.mark.parametrize("block", (12, 17, 1 << 16))
def test_sessions_in_blocks_equal_the_machine(spark, block):
    draw = np.random.default_rng(block)
    sessions = {s: random_units(draw, n) for s, n in ((1, 300), (2, 1), (3, block), (4, 2 * block if block < 100 else 40), (5, block + 1 if block < 100 else 41), (6, block + 9 if block < 100 else 50))}
    rows = [(s, k, *u) for s, us in sessions.items() for k, u in enumerate(us)]
    df = spark.createDataFrame(rows, UNITS).orderBy(F.rand(1))
    for caps, wanted in ((Caps(10, 60), []), (Caps(6, 1000), [7, 13, 200]), (Caps(10, 20), list(range(3, 900, 31)))):
        got = sorted(map(tuple, greedy.segment_units(df, caps, wanted, block).collect()))
        assert got == sorted((s, n, *g) for s, us in sessions.items() for n, g in enumerate(windows.segments(us, caps, wanted)))


@pytest.mark.parametrize("block", (20, 1 << 16))
def test_fold_of_events(spark, block):
    draw = np.random.default_rng(9)
    rows = [(s, k + 1, int(draw.choice([0, 5, 30, 119, 120, 121, 500]))) for s, n in ((1, 700), (2, 1), (3, 41)) for k in range(n)]
    df = spark.createDataFrame(rows, "session long, sequence long, token_count long")
    got = sorted(map(tuple, greedy.fold(df, 16, 120, block).collect()))
    assert got == sorted(map(tuple, windows.fold_segments(df, 16, 120).collect()))


def test_one_session_uses_all_tasks(spark):
    """A session is dealt over tasks, and none holds more than a few blocks of it."""
    df = spark.range(200_000).select(F.lit(1).cast("long").alias("session"), (F.col("id") + 1).alias("sequence"), (F.col("id") % 50).alias("token_count"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else little data makes few tasks
    try:
        got = materialise(greedy.fold(df, 16, 120, 1 << 12).withColumn("task", F.spark_partition_id()), "folded")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.select("task").distinct().count() == 4
    want = {}
    segment, n, t = -1, 0, 0
    for i in range(200_000):
        cost = i % 50
        if segment < 0 or n >= 16 or t >= 120 or t + cost > 120:
            segment, n, t = segment + 1, 0, 0
        n, t = n + 1, t + cost
        want[i + 1] = segment
    assert {r.sequence: r.segment for r in got.collect()} == want


def test_empty_and_refused(spark):
    assert greedy.segment_units(spark.createDataFrame([], UNITS), Caps()).collect() == []
    with pytest.raises(ValueError):
        greedy.segment_units(spark.createDataFrame([], UNITS), Caps(20), block=20)

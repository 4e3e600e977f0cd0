"""Filters of keys and the anti-join behind them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from annalix.operators import joins


@pytest.mark.parametrize("most", (joins.FILTER_BYTES, 4096))
def test_anti_join_is_exact(spark, most):
    """With a filter that tells apart and with one that is full."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 101 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 20_000).cast("string"))).alias("key"), F.col("id").alias("map"), F.lit(1).alias("x"))
    keys = spark.range(0, 40_000, 3).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS key"))
    got = joins.anti_join(rows.withColumnRenamed("map", "m"), keys, "key", most)
    want = rows.withColumnRenamed("map", "m").join(keys, "key", "left_anti")
    assert got.columns == ["key", "m", "x"]
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and want.select(*got.columns).exceptAll(got).isEmpty()
    none = keys.filter("false")
    assert joins.anti_join(rows.drop("map"), none, "key").count() == 30_000 and joins.anti_join(rows.drop("map").limit(0), keys, "key").isEmpty()


def test_a_filter_rules_out_most_of_what_it_lacks(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    rows = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    marked = joins.may_hold(rows, "key", joins.key_filter(keys, "key"))
    told = {r["held"]: r for r in marked.groupBy((F.substring("key", 2, 9).cast("int") < 5000).alias("held")).agg(F.count_if("may_hold").alias("yes"), F.count("*").alias("n")).collect()}
    assert told[True]["yes"] == 5000 and told[False]["yes"] < 0.02 * told[False]["n"]

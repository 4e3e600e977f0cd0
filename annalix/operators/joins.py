"""Joins over the journal's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def without_metric(artifacts: DataFrame, metrics: DataFrame, kind: str, profile: str) -> DataFrame:
    """Artifacts of one kind that have no count under the profile; artifacts have (session, artifact_id, ...)."""
    known = metrics.filter((F.col("artifact_kind") == kind) & (F.col("profile") == profile)).select("artifact_id")
    return anti_join(artifacts, known, "artifact_id").withColumn("artifact_kind", F.lit(kind))


#: Bits that a stored key gets in a filter, bits that are set for it, bits of a bitmap, and most bytes of a filter.
KEY_BITS, HASHES, MAP_BITS, FILTER_BYTES = 16, 4, 1 << 15, 32 << 20


def key_filter(keys: DataFrame, key: str, most_bytes: int = FILTER_BYTES) -> tuple[DataFrame, int]:
    """(map, bits) of a Bloom filter of the keys, and how many maps there are: a key sets its bits in one map, so a look-up is one join.

    Tasks make partial maps and the aggregate ors them. The size follows from the number of keys and is at most ``most_bytes``, so that the filter can be broadcast.
    """
    n = max(1, min(-(-keys.count() * KEY_BITS // MAP_BITS), most_bytes * 8 // MAP_BITS))
    rows = keys.filter(F.col(key).isNotNull()).select(_map_of(key, n).alias("map"), F.explode(_bits_of(key)).alias("bit"))
    return rows.groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits")), n


def _map_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def _bits_of(key: str) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(k + 1)), F.lit(MAP_BITS)) for k in range(HASHES)])


def may_hold(rows: DataFrame, key: str, keys: tuple[DataFrame, int]) -> DataFrame:
    """rows with ``may_hold``: false only if their key is surely none of the filter's. A null key is held by none."""
    maps, n = keys
    byte = lambda p: F.conv(F.hex(F.substring(F.col("bits"), (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.forall(_bits_of(key), lambda p: byte(p).bitwiseAND(F.pow(F.lit(2), p % 8).cast("int")) != 0)
    found = rows.withColumn("map", _map_of(key, n)).join(F.broadcast(maps), "map", "left")  # at most ``most_bytes``
    return found.withColumn("may_hold", F.col(key).isNotNull() & F.col("bits").isNotNull() & F.coalesce(there, F.lit(False))).drop("map", "bits")


def anti_join(rows: DataFrame, keys: DataFrame, key: str, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """``left_anti``, for rows of which many have no partner: those that a filter of the keys rules out are decided where they are read, and only the rest is shuffled.

    Exact at every size of the filter: what it lets through is joined. rows are read twice.
    """
    marked = may_hold(rows, key, key_filter(keys.select(key), key, most_bytes))
    return marked.filter(~F.col("may_hold")).unionByName(marked.filter("may_hold").join(keys.select(key), key, "left_anti").select(*marked.columns)).drop("may_hold")


def relation_weight(a: str = "a", b: str = "b") -> Column:
    """Strength of the relation of two blocks: 1 for a shared source, 3/4 for the same capsule, 1/2 for neighbouring raw events, 1/4 for the same kind, 1/8 for the same slot."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    part = lambda test, w: F.when(test, w).otherwise(0.0)
    raw = (x("kind") == "raw_event") & (y("kind") == "raw_event") & (F.abs(x("event_sequence") - y("event_sequence")) == 1)
    return (
        part(F.arrays_overlap(x("sources"), y("sources")), 1.0) + part(x("capsule_id") == y("capsule_id"), 0.75)
        + part(raw, 0.5) + part(x("kind") == y("kind"), 0.25) + part(x("slot") == y("slot"), 0.125)
    )


def relations(blocks: DataFrame, cap: int | None = 1024) -> DataFrame:
    """(session, i, j, weight) for all pairs i < j of a session's blocks with a positive weight.

    The session is an equi-key, so this is a hash join with a residual. A session has at most 256
    blocks, which bounds its pairs. Of them the first ``cap`` in (i, j) order are kept.
    """
    from pyspark.sql import Window

    pairs = blocks.alias("a").join(blocks.alias("b"), (F.col("a.session") == F.col("b.session")) & (F.col("a.position") < F.col("b.position")))
    made = pairs.select(F.col("a.session").alias("session"), F.col("a.position").alias("i"), F.col("b.position").alias("j"), F.col("a.block_id").alias("left_id"), F.col("b.block_id").alias("right_id"), relation_weight().alias("weight")).filter("weight > 0")
    if cap is None:
        return made
    return made.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("i", "j"))).filter(F.col("n") <= cap).drop("n")


def companions(blocks: DataFrame) -> DataFrame:
    """(session, a, b): dependency blocks with the blocks of their capsule or of a shared source, as equi-joins."""
    keyed = blocks.select("session", "block_id", "kind", F.explode(F.array_union(F.transform("sources", lambda x: F.concat(F.lit("s:"), x)), F.array_compact(F.array(F.concat(F.lit("c:"), "capsule_id"))))).alias("key"))
    left = keyed.filter("kind = 'dependency'").select("session", "key", F.col("block_id").alias("a"))
    right = keyed.select("session", "key", F.col("block_id").alias("b"))
    return left.join(right, ["session", "key"]).filter("a <> b").select("session", "a", "b").distinct()


def pending_tools(events: DataFrame) -> DataFrame:
    """(session, tool, arguments, pending): calls without a result, as a multiset."""
    sign = F.when(F.col("event_type") == "TOOL_CALL", 1).otherwise(-1)
    return events.groupBy("session", "tool", "arguments").agg(F.sum(sign).alias("pending")).filter("pending > 0")

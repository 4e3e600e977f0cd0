"""Components of relations between items of a session, from edge tables: dependency groups, their closure, and equality constraints.

Relations are stars: of the blocks that share a key (a capsule, a source) each is tied to the least dependency
block with that key, so a key of n blocks makes n edges and not n * n. Components come from contraction: in a
round every node takes its least neighbour, edges move to what was taken, and inner edges go. Least is by number in one round, which
folds stars at once, and by a new hash in the next, so that a chain shrinks by a constant factor however it is numbered. Every step is an
aggregate or a join by (session, node); nothing is gathered in a task or on the driver, and sessions may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import materialise

KEYS = ["session", "node"]


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(session, node, component) of the nodes of an edge: component is the least node that they are connected with.

    edges: (session, a, b), nodes of an orderable type. Defined cases: edges with a null node and edges of a node with itself tie nothing and are left
    out, repeated edges count once, an empty table gives an empty one.
    """
    left = materialise(edges.select("session", "a", "b").filter("a <> b").distinct(), "edges")
    out = None
    rank = lambda c, r: F.struct((F.xxhash64("session", F.col(c), F.lit(r)) if r % 2 else F.lit(0).cast("long")).alias("h"), F.col(c).alias("id"))
    for r in range(rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select("session", F.col("b").alias("a"), F.col("a").alias("b")))
        taken = both.groupBy("session", "a").agg(F.min(rank("b", r)).alias("m")).select("session", "a", F.least("m", rank("a", r))["id"].alias("to"))
        taken = materialise(taken, "taken")
        moved = left.join(taken, ["session", "a"]).select("session", F.col("to").alias("x"), F.col("b").alias("a")).join(taken, ["session", "a"]).select("session", "x", F.col("to").alias("y")).filter("x <> y")
        left = materialise(moved.select("session", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if out is None:
            out = taken.select("session", F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            hop = taken.select("session", F.col("a").alias("root"), "to")
            out = materialise(out.join(hop, ["session", "root"], "left").select("session", "node", F.coalesce("to", "root").alias("root")), "roots")
    else:
        raise RuntimeError("components did not settle")
    if out is None:
        return edges.select("session", F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    least = out.groupBy("session", "root").agg(F.min("node").alias("component"))
    return out.join(least, ["session", "root"]).select("session", "node", "component")


def companion_edges(blocks: DataFrame) -> DataFrame:
    """(session, a, b): every block of a capsule or source that has a dependency block, with the least of those. Nodes are positions."""
    keys = F.array_union(F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda x: F.concat(F.lit("s:"), x)), F.array_compact(F.array(F.concat(F.lit("c:"), "capsule_id"))))
    rows = blocks.select("session", "position", F.col("kind") == "dependency", F.explode(keys)).toDF("session", "position", "dependency", "key")
    hub = F.min(F.when(F.col("dependency"), F.col("position"))).over(Window.partitionBy("session", "key"))
    return rows.select("session", F.col("position").alias("a"), hub.alias("b")).filter("b IS NOT NULL")


def grouped(blocks: DataFrame, selected: Column) -> DataFrame:
    """The blocks with component (the position of the first block of their dependency group), removable and closed.

    removable: no block of the group is required; closed: one of the group is required or ``selected``, so that the closure of those holds the whole group.
    A block without companions is a group of its own. Positions are unique in a session; sources may be null.
    """
    of = components(companion_edges(blocks)).withColumnRenamed("node", "position")
    own = blocks.withColumn("_selected", F.col("required") | F.coalesce(selected, F.lit(False))).join(of, ["session", "position"], "left").withColumn("component", F.coalesce("component", "position"))
    group = Window.partitionBy("session", "component")
    return own.withColumn("removable", ~F.bool_or("required").over(group)).withColumn("closed", F.bool_or("_selected").over(group)).drop("_selected")


def closure(blocks: DataFrame, selected: Column, most: int | None = None) -> DataFrame:
    """(session, block_id, position, place, code) of the blocks that ``selected`` and required ones pull in, in the blocks' order.

    code: NONE, or DEPENDENCY_CLOSURE_CAPACITY_EXCEEDED in all rows of a session whose closure has more than ``most`` blocks. place counts from 0 in a session.
    """
    whole = Window.partitionBy("session")
    rows = grouped(blocks, selected).filter("closed")
    over = F.count("*").over(whole) > F.lit(most) if most is not None else F.lit(False)
    return rows.select("session", "block_id", "position", (F.row_number().over(whole.orderBy("position")) - 1).cast("long").alias("place"), F.when(over, "DEPENDENCY_CLOSURE_CAPACITY_EXCEEDED").otherwise("NONE").alias("code"))


def closed_packs(blocks: DataFrame, packed: DataFrame, most: int | None = None) -> DataFrame:
    """(session, valid): whether a pack (session, block_id, place) is its own closure, in the blocks' order. A pack with an unknown or repeated block is not."""
    known = blocks.join(packed.select("session", "block_id").distinct().withColumn("_packed", F.lit(True)), ["session", "block_id"], "left")
    want = closure(known, F.coalesce("_packed", F.lit(False)), most).select("session", "block_id", F.col("place").alias("want"), "code")
    both = packed.select("session", "block_id", F.col("place").alias("got")).join(want, ["session", "block_id"], "full_outer")
    good = F.coalesce((F.col("got") == F.col("want")) & (F.col("code") == "NONE"), F.lit(False))
    return both.groupBy("session").agg((F.bool_and(good) & (F.count_distinct("block_id") == F.count("*"))).alias("valid"))


def constraints(coordinates: DataFrame, equal: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compiled equality systems of all sessions: (coordinates with their group, sessions with their verdict).

    coordinates: (session, node); equal: (session, a, b), a coordinate equals another; fixed: (session, node, value). The first table is
    (session, node, label, value): label is the least coordinate of the group, value what the group is fixed to. The second is (session, code, given, independent):
    CONSTRAINT_CONTRADICTORY if a group is fixed to two values, and then no independent rows; else NONE and the number of rows that are left when those that follow from others go:
    one less than the group's size, and one for a group that is fixed. Repeated rows are given, and follow from each other.
    """
    of = components(equal)
    rows = coordinates.join(of, ["session", "node"], "left").select("session", "node", F.coalesce("component", "node").alias("label"))
    told = fixed.join(rows, ["session", "node"]).groupBy("session", "label").agg(F.min("value").alias("value"), (F.min("value") != F.max("value")).alias("contradicts"))
    rows = rows.join(told, ["session", "label"], "left")
    groups = rows.groupBy("session", "label").agg(F.count("*").alias("n"), F.max("value").alias("value"), F.bool_or(F.coalesce("contradicts", F.lit(False))).alias("contradicts"))
    given = equal.select("session").unionByName(fixed.select("session")).groupBy("session").agg(F.count("*").alias("given"))
    sums = groups.groupBy("session").agg(F.bool_or("contradicts").alias("bad"), F.sum(F.col("n") - 1 + F.when(F.col("value").isNotNull(), 1).otherwise(0)).alias("rows"))
    verdict = sums.join(given, "session", "left").select(
        "session", F.when(F.col("bad"), "CONSTRAINT_CONTRADICTORY").otherwise("NONE").alias("code"), F.coalesce("given", F.lit(0)).alias("given"), F.when(F.col("bad"), 0).otherwise(F.col("rows")).cast("long").alias("independent")
    )
    return rows.select("session", "node", "label", "value"), verdict

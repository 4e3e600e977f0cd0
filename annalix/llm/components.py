"""Connected components of an edge table, by repeated contraction; nothing is gathered on the driver.

In a round every node takes the label with the least hash among itself and its neighbours, edges move
to the labels, and inner edges go. The hash differs by round, so chains shrink by a constant factor
however they are numbered. All steps are aggregates with partial sums and joins that can be split. Once
no more than ``local`` edges are left, counted first, one task finishes them: many small rounds would cost
more than that. A round's tables are written by as many tasks as its edges need, so that small ones don't
make many files. Joins are merge joins: both sides grow with the edges, and executors keep every broadcast
table for long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._shared import materialise, tasks_for, tidy


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' component under edges i, j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for end in (i, j):
            np.minimum.at(new, label[end], low)
        new = new[new]
        while not (new == (further := new[new])).all():
            new = further
        if (new == label).all():
            break
        label = new
        live = label[i] != label[j]
        i, j = i[live], j[live]
    return label


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        nodes = pc.unique(pa.chunked_array([*t["a"].chunks, *t["b"].chunks]))
        nodes = nodes.take(pc.sort_indices(nodes))
        label = least_labels(len(nodes), *(pc.index_in(t[c], nodes).to_numpy() for c in ("a", "b")))
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["a", "to"])


def components(edges: DataFrame, rounds: int = 60, local: int = 1 << 18) -> DataFrame:
    """edges: a written table (a, b) of one orderable type, no nulls. A written table (node, component) of the nodes of an edge between two."""
    maps: list[DataFrame] = []
    left = edges.select("a", "b").filter("a <> b")
    kind = edges.schema["a"].dataType.simpleString()
    for r in range(rounds):
        n = left.count()
        if n <= local:
            if n:
                maps.append(materialise(left.coalesce(1).mapInArrow(tidy(_finish), f"a {kind}, to {kind}"), "labels"))
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        label = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a"))["id"].alias("to"))
        label = materialise(label.coalesce(tasks_for(2 * n)), f"labels{r}")
        maps.append(label)
        x = left.join(label.select("a", F.col("to").alias("na")).hint("merge"), "a").select("b", "na")
        x = x.join(label.select(F.col("a").alias("b"), F.col("to").alias("nb")).hint("merge"), "b").filter("na <> nb")
        x = x.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        left = materialise(x.coalesce(tasks_for(n)), f"edges{r}")
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    out = maps[0].select(F.col("a").alias("node"), F.col("to").alias("component"))
    if len(maps) == 1:
        return out
    for m in maps[1:]:
        hop = m.select(F.col("a").alias("component"), "to")
        out = out.join(hop.hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialise(out.coalesce(tasks_for(maps[0].count())), "components")

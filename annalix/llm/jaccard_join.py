"""Near copies: all links between texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

1. Texts with equal sets of shingles are one class; from here on a class is one row with its count.
2. Classes that agree in a band of MinHash values meet. Inside a bucket, values are compared in steps
   of 16, and a pair is dropped once the posterior probability of reaching the threshold (uniform
   prior) falls below ``tolerance``. Only a spanning forest of the surviving pairs leaves the task.
3. Survivors' components hold every link. Within them each pair is pruned the same way once more and
   then decided by exact set intersection; tasks return each class's number of linked texts and a
   spanning forest, never the pairs.

Large buckets and components are cut into blocks, and a task gets two. A component's blocks hold classes
whose least bucket is the same, as far as they fit, and only blocks that have a bucket in common meet: so
a long chain of texts costs what its links cost, and not the square of its length. A link is missed only
if no band agrees: with 24 bands of 4 values that is 3e-6 at a similarity of 0.8, and less above.

Defined cases: words are runs of non-space bytes, A-Z as a-z. A text of one to four words has one
shingle of all its words; one without words (null, empty, blank) has none, links to nothing and is its
own class. Rows that repeat an id are separate rows, and copies of one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import arrow_batches, materialise, tasks_for, tidy
from ._text import digest128, minhash, minhash_params, mix, shingle_column
from .components import components, least_labels


@dataclass(frozen=True)
class Settings:
    least: float = 0.8
    bands: int = 24
    band_rows: int = 4
    step: int = 16
    tolerance: float = 1e-6
    #: Classes in a block of a bucket; classes and shingles in a block of a component.
    bucket_block: int = 256
    block: int = 256
    block_shingles: int = 1 << 19
    #: Bytes up to which a side is broadcast, at ``row_bytes`` a row as hashed in memory; beyond, a shuffled join.
    broadcast_bytes: int = 32 << 20
    row_bytes: int = 192

    @property
    def hashes(self) -> int:
        return self.bands * self.band_rows


#: Rows of a class, of its buckets or of a result that one task writes: about 16 MB, so that small tables don't make many files.
TASK_ROWS = 1 << 15


def fewest_matches(s: Settings) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones) such that P(similarity >= least | equal) >= tolerance.

    A value is one byte of a MinHash value, equal by chance once in 256 times. With a uniform prior on
    the rate of equal bytes the posterior is a Beta, and its tail a binomial sum.
    """
    rate = s.least + (1 - s.least) / 256
    out = []
    for n in range(s.step, s.hashes + 1, s.step):
        tail, need = 0.0, 0
        for m in range(n + 1):  # P(rate >= x | m of n) = sum over j <= m of C(n+1, j) x^j (1-x)^(n+1-j)
            tail += math.comb(n + 1, m) * rate**m * (1 - rate) ** (n + 1 - m)
            if tail >= s.tolerance:
                need = m
                break
        out.append((n, need))
    return out


def _profile(s: Settings):
    """doc_id, text key -> class digest, number of shingles, bucket of each band, first bytes of the MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = minhash_params(s.hashes, seed=11)
        for b in batches:
            flat, at = shingle_column(b.column("text"))
            sig = minhash(flat, at, *params)
            key = np.zeros((len(sig), s.bands), np.uint64)
            for r in range(s.band_rows):
                key = mix(key * np.uint64(31) + sig[:, r :: s.band_rows] + np.arange(s.bands, dtype=np.uint64) * np.uint64(1 << 40))
            node, n = [], []
            for i in range(len(sig)):
                own = np.unique(flat[at[i] : at[i + 1]])
                node.append(digest128(own.tobytes()) if len(own) else None)
                n.append(len(own))
            low = np.ascontiguousarray((sig & 0xFF).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("key"), pa.array(node, pa.binary()), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * s.bands, pa.int32()), pa.array(key.view(np.int64).ravel())),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                ],
                ["doc_id", "key", "node", "n", "buckets", "sig"],
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Rows that come sorted by keys, as tables of whole groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = t.num_rows - 1
        same = np.ones(t.num_rows, bool)
        for k in keys:
            col = np.array(t[k].to_pylist(), object) if pa.types.is_binary(t[k].type) else t[k].to_numpy()
            same &= col == col[last]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _group_ids(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        col = np.array(t[k].to_pylist(), object) if pa.types.is_binary(t[k].type) else t[k].to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.cumsum(new) - 1


def _sig(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(t.num_rows, -1)


def _survivors(gid: np.ndarray, block: np.ndarray, one: np.ndarray, sig: np.ndarray, tests: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group that pass all tests. Where one is false, the pair must come from two blocks."""
    size = np.bincount(gid)[gid]
    for shift in range(1, int(size.max())):
        big = np.flatnonzero(size > shift)
        i = big[big < len(gid) - shift]
        j = i + shift
        ok = (gid[i] == gid[j]) & (one[i] | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        done, equal = 0, np.zeros(len(i), np.int32)
        for n, need in tests:
            if not len(i):
                break
            equal = equal + (sig[i, done:n] == sig[j, done:n]).sum(1, dtype=np.int32)
            ok = equal >= need
            i, j, equal, done = i[ok], j[ok], equal[ok], n
        if len(i):
            yield i, j


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row of each row's component."""
    return least_labels(n, *(np.concatenate(x) for x in zip(*pairs))) if pairs else np.arange(n)


def _prune(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = fewest_matches(s)
        for t in _groups(batches, ["bucket", "bi", "bj"]):
            gid = _group_ids(t, ["bucket", "bi", "bj"])
            one = t["bi"].to_numpy() == t["bj"].to_numpy()
            label = _forest(t.num_rows, list(_survivors(gid, t["block"].to_numpy(), one, _sig(t), tests)))
            far = np.flatnonzero(label != np.arange(len(label)))
            nodes = t["node"].combine_chunks()
            nodes = nodes.chunk(0) if isinstance(nodes, pa.ChunkedArray) else nodes
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(label[far])), nodes.take(pa.array(far))], ["a", "b"])

    return run


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Shared values of each pair. Many pairs among few rows: a product of 0/1 matrices, by slices of columns."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, cols = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    width = max(256, (1 << 20) // len(sets))
    for lo in range(0, int(cols[-1]) + 1, width):
        a, b = np.searchsorted(cols, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[rows[a:b], cols[a:b] - lo] = 1
        total += part @ part.T
    return total[i, j].round().astype(np.int64)


def _verify(s: Settings):
    keys = ["comp", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = fewest_matches(s)
        for t in _groups(batches, keys, rows=64):
            gid = _group_ids(t, keys)
            one = t["bi"].to_numpy() == t["bj"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
            n, copies = np.array([len(x) for x in sets]), t["copies"].to_numpy()
            got = list(_survivors(gid, t["block"].to_numpy(), one, _sig(t), tests))
            links, linked = np.zeros(len(sets), np.int64), []
            if got:
                i, j = (np.concatenate(x) for x in zip(*got))
                ok = np.minimum(n[i], n[j]) >= s.least * np.maximum(n[i], n[j]) - 1e-9
                i, j = i[ok], j[ok]
                for g in np.unique(gid[i]):
                    own = np.flatnonzero(gid == g)
                    here = gid[i] == g
                    a, b = i[here], j[here]
                    both = _intersections([sets[k] for k in own], a - own[0], b - own[0])
                    ok = both / np.maximum(n[a] + n[b] - both, 1) >= s.least
                    a, b = a[ok], b[ok]
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    linked.append((a, b))
            label = _forest(len(sets), linked)
            nodes = t["node"].combine_chunks()
            nodes = nodes.chunk(0) if isinstance(nodes, pa.ChunkedArray) else nodes
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(some)), nodes.take(pa.array(label[some])), pa.array(links[some])], ["node", "root", "links"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat, at = shingle_column(b.column("text"))
        sets = [np.unique(flat[at[i] : at[i + 1]]).tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "set"])


def _blocked(df: DataFrame, blocks) -> DataFrame:
    """Each row once for every pair of blocks that its block is part of: (bi, bj), bi <= bj."""
    df = df.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("blocks", "other")


def _fill(count, weight, s: Settings):
    """Blocks that so many classes with so many shingles need."""
    return F.ceil(F.greatest(F.col(count) / s.block, F.col(weight) / s.block_shingles))


def _component_blocks(near: DataFrame, live: DataFrame, s: Settings) -> DataFrame:
    """(node, comp, block, bi, bj): the pairs of blocks in which a class of a component is compared."""
    sizes = near.groupBy("comp").agg(F.count("*").alias("many"), F.sum("n").alias("weight")).withColumn("parts", _fill("many", "weight", s))
    sizes = materialise(sizes.filter("parts > 1").select("comp", "parts").coalesce(tasks_for(near.count())), "large")
    zero = F.lit(0).cast("long")
    small = near.join(sizes.hint("merge"), "comp", "left_anti").select("node", "comp", zero.alias("block"), zero.alias("bi"), zero.alias("bj"))
    if sizes.isEmpty():
        return small
    large = near.join(sizes.hint("merge"), "comp").select("node", "comp", "n", "parts")
    met = live.join(large.select("node", "comp").hint("merge"), "node").select("node", "comp", "bucket")
    home = met.groupBy("node").agg(F.min("bucket").alias("least")).join(large.hint("merge"), "node")
    home = home.select("node", "comp", "n", F.pmod(F.xxhash64("least"), F.col("parts")).alias("home"))
    fit = home.groupBy("comp", "home").agg(F.count("*").alias("many"), F.sum("n").alias("weight")).select("comp", "home", _fill("many", "weight", s).alias("subs"))
    placed = home.join(fit.hint("merge"), ["comp", "home"]).select("node", "comp", F.shiftleft("home", 24).bitwiseOR(F.pmod(F.xxhash64("node"), F.col("subs"))).alias("block"))
    placed = materialise(placed, "blocks")
    there = met.join(placed.hint("merge"), ["node", "comp"]).select("comp", "bucket", "block").distinct()
    two = there.withColumnRenamed("block", "bi").join(there.withColumnRenamed("block", "bj").hint("merge"), ["comp", "bucket"]).filter("bi <= bj").select("comp", "bi", "bj").distinct()
    two = two.select("comp", "bi", "bj", F.explode(F.array_distinct(F.array("bi", "bj"))).alias("block"))
    return small.unionByName(placed.join(two.hint("merge"), ["comp", "block"]).select("node", "comp", "block", "bi", "bj"))


def link(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each row of docs: (doc_id, key, node, class_id, first, n_links).

    key is xxhash64 of the text and node the digest of the shingles (null: none). class_id is the least
    id in the row's component of links (its own id if it has no link; a null id is least of all). first is true for the rows whose
    (doc_id, key) is the least of the class. n_links counts the other rows it is linked to.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    rows = materialise(keyed.mapInArrow(tidy(_profile(s)), f"doc_id {kind}, key long, node binary, n long, buckets array<long>, sig binary"), "profiles")

    own = F.struct("doc_id", "key")
    classes = rows.filter("node is not null").groupBy("node").agg(
        F.min(own).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig")
    )
    count = rows.count()
    classes = materialise(classes.coalesce(tasks_for(count, TASK_ROWS)), "classes")

    placed = classes.select("node", F.explode("buckets").alias("bucket"))
    full = placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    live = materialise(placed.join(full.hint("merge"), "bucket").coalesce(tasks_for(count, TASK_ROWS)), "buckets")
    met = _blocked(live.join(classes.select("node", "sig").hint("merge"), "node"), F.ceil(F.col("size") / s.bucket_block)).select("bucket", "bi", "bj", "block", "node", "sig")
    met = met.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    forest = met.mapInArrow(tidy(_prune(s)), "a binary, b binary").coalesce(tasks_for(live.count(), 1 << 14))
    near = components(materialise(forest, "forest"))

    many = near.count()
    near = near.withColumnRenamed("component", "comp").join(classes.drop("buckets").hint("merge"), "node").select("comp", "node", "rep", "copies", "n", "sig")
    near = materialise(near.coalesce(tasks_for(many)), "near")
    reps = near.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.key").alias("rep_key"), "node")
    if s.row_bytes * many <= s.broadcast_bytes:
        reps = F.broadcast(reps)
    texts = keyed.join(reps, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("key") == F.col("rep_key"))).select("node", "text").dropDuplicates(["node"])
    sets = texts.mapInArrow(tidy(_sets), "node binary, set binary")
    pairs = _component_blocks(near, live, s).join(near.select("node", "copies", "sig").hint("merge"), "node").join(sets.hint("merge"), "node").select("comp", "bi", "bj", "block", "node", "copies", "sig", "set")
    pairs = pairs.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "block", "node")
    found = pairs.mapInArrow(tidy(_verify(s)), "node binary, root binary, links long").coalesce(tasks_for(many, 1 << 10))
    found = materialise(found, "links")

    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    ends = linked.join(near.select("node", "rep").hint("merge"), "node").join(links.hint("merge"), "node")
    heads = ends.groupBy("component").agg(F.min("rep").alias("head"))
    ends = materialise(ends.join(heads.hint("merge"), "component").select("node", "head", "links").coalesce(tasks_for(linked.count())), "ends")
    info = classes.select("node", "rep", "copies").join(ends.hint("merge"), "node", "left")
    info = info.select("node", F.coalesce("head", "rep").alias("head"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("doc_id", "key", "node").join(info.hint("merge"), "node", "left").coalesce(max(8, tasks_for(count, TASK_ROWS)))
    return out.select(
        "doc_id", "key", "node",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        (F.col("node").isNull() | own.eqNullSafe(F.struct(F.col("head.doc_id").alias("doc_id"), F.col("head.key").alias("key")))).alias("first"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


#: Names that documents won't have.
_ID, _KEY = "__near_copy_id", "__near_copy_key"


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs without all but one row of each component of links; columns as in docs.

    The row with the least (id, text hash) stays; rows without words all stay. Where the same id and
    text come several times, one of those rows stays.
    """
    made = materialise(link(docs, s), "linked")
    gone = made.filter("not first").select(F.col("doc_id").alias(_ID), F.col("key").alias(_KEY))
    again = made.filter("first and node is not null").groupBy("doc_id", "key").count().filter("count > 1").select(F.col("doc_id").alias(_ID), F.col("key").alias(_KEY))

    def checked(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if s.row_bytes * keys.count() <= s.broadcast_bytes else keys

    same = F.col("doc_id").eqNullSafe(F.col(_ID)) & (F.xxhash64("text") == F.col(_KEY))
    kept = docs.join(checked(gone), same, "left_anti")
    again = materialise(again, "again")
    if again.isEmpty():
        return kept
    once = kept.join(checked(again), same, "left_semi").withColumn(_KEY, F.xxhash64("text")).dropDuplicates(["doc_id", _KEY]).drop(_KEY)
    return kept.join(checked(again), same, "left_anti").unionByName(once)

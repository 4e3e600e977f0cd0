"""Which of several filters removes what: masks of failures, exact copies by routed texts, all orders of filters.

Five filters, each a bit of a mask: A too few words, B too few different words, C too many capitals,
D a forbidden sign, E the text of a smaller id. A pass over the texts makes A to D. For E texts go
through an RDD that is partitioned by their xxh3 fingerprint: a partition keeps, for each fingerprint, the chain
of different texts with the least id so far, and says of every other id that it isn't the least. A task sends a
text once while it remembers it, so a text that fills a third of the table arrives about once a task.
Masks are counted by part (``combineByKey``), as vectors over the 32 masks, and every order of filters is read off those.

Defined cases: a null text is the empty text. Rows with equal ids and texts are both least or both not. A null id is
no smaller than another, and nothing is smaller than it: it neither makes nor is a copy. A null
source counts as the empty string. An id that is labelled twice has each label that one of its rows has. Words are told
apart by 64 bits (``_text``), texts by themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, functions as F

from ._shared import arrow_batches, materialise, tidy
from ._text import SLICE, SPACE, as_bytes, word_hashes, words

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Least words (A), least different words and most capitals as per cent (B, C), and the signs of D.
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS, FORBIDDEN = 200, 50, 2, b"#$%&*|"
#: Bytes of texts that a task remembers as sent, and that a partition of the RDD should hold.
REMEMBERED, PARTITION_BYTES = 16 << 20, 32 << 20
_SIGN = np.zeros(256, bool)
_SIGN[list(FORBIDDEN)] = True


def pieces(data: np.ndarray, size: int = SLICE) -> Iterator[np.ndarray]:
    """The bytes of one text in slices of about ``size``, cut where a word ends."""
    i = 0
    while len(data) - i > size:
        gap = np.flatnonzero(SPACE[data[i + size : i + 2 * size]])
        far = 2 * size
        while not len(gap) and i + far < len(data):  # a word of a megabyte
            gap = np.flatnonzero(SPACE[data[i + far : i + far + size]]) + far - size
            far += size
        if not len(gap):
            break
        j = i + size + int(gap[0])
        yield data[i:j]
        i = j
    yield data[i:]


def _long(data: np.ndarray) -> tuple[int, int, int, int, bool]:
    """Words, different words, capitals, code points, and whether there is a sign. What stays of a slice is a hash a different word."""
    n = capitals = points = 0
    sign, known = False, np.zeros(0, np.uint64)
    for part in pieces(data):
        starts, ends, _ = words(part, np.array([0, len(part)]))
        n += len(starts)
        known = np.union1d(known, word_hashes(part, starts, ends, fold=False))
        capitals += int(((part >= 65) & (part <= 90)).sum())
        points += int(((part & 0xC0) != 0x80).sum())
        sign = sign or bool(_SIGN[part].any())
    return n, len(known), capitals, points, sign


def _short(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The same of many rows at once, a column each."""
    starts, ends, rows = words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    hashes = word_hashes(data, starts, ends, fold=False)
    order = np.lexsort((hashes, row))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    count = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])
    different = np.bincount(row[order][first], minlength=len(offsets) - 1)
    return np.stack([np.diff(rows), different, count((data >= 65) & (data <= 90)), count((data & 0xC0) != 0x80), count(_SIGN[data]) > 0], 1)


def masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits A to D of every row."""
    n = len(offsets) - 1
    found = np.zeros((n, 5), np.int64)
    long = np.flatnonzero(np.diff(offsets) > SLICE)
    for row in long.tolist():
        found[row] = _long(data[offsets[row] : offsets[row + 1]])
    for lo, hi in zip([0, *(long + 1)], [*long, n]):
        if lo < hi:
            found[lo:hi] = _short(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
    many, different, capitals, points, sign = found.T
    return (many < LEAST_WORDS) | (100 * different < LEAST_DIFFERENT * many) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | sign << 3


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fingerprint, mask, size): bits A to D, and the bytes of the text."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = as_bytes(b.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            cuts = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            prints = np.array([xxhash.xxh3_64_intdigest(view[i:j]) for i, j in cuts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(prints), pa.array(masks(data, offsets), pa.int32()), pa.array(np.diff(offsets))], ["doc_id", "part", "fingerprint", "mask", "size"])

    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, part string, fingerprint long, mask int, size long")


def _sent(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """(fingerprint, (text, least id, other ids)) of a task's rows. Texts seen twice stay when the memory is full."""
    held: dict[bytes, list] = {}  # text: least id, whether seen again
    size = 0
    for doc_id, text in rows:
        if doc_id is None:
            continue
        key = (text or "").encode()
        entry = held.get(key)
        if entry is None:
            held[key] = [doc_id, False]
            size += len(key) + 200
            if size > REMEMBERED:
                hot = [k for k, v in held.items() if v[1]]
                keep = set(hot) if sum(map(len, hot)) + 200 * len(hot) < REMEMBERED // 2 else set()
                for k in [k for k in held if k not in keep]:
                    yield xxhash.xxh3_64_intdigest(k), (k, held.pop(k)[0])
                size = sum(len(k) + 200 for k in held)
        else:
            entry[1] = True
            if doc_id != entry[0]:  # the larger one is a copy, whatever other tasks hold
                yield xxhash.xxh3_64_intdigest(key), (None, max(doc_id, entry[0]))
                entry[0] = min(doc_id, entry[0])
    for k, v in held.items():
        yield xxhash.xxh3_64_intdigest(k), (k, v[0])


def _not_least(routed: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """(id, fingerprint) of ids that aren't the least of their text, from a partition that holds all rows of its fingerprints."""
    chains: dict[int, list[list]] = {}
    for fingerprint, (text, doc_id) in routed:
        signed = fingerprint - (1 << 64) if fingerprint >> 63 else fingerprint
        if text is None:
            yield doc_id, signed
            continue
        chain = chains.setdefault(fingerprint, [])
        for link in chain:
            if link[0] == text:
                if doc_id != link[1]:
                    yield max(doc_id, link[1]), signed
                    link[1] = min(doc_id, link[1])
                break
        else:
            chain.append([text, doc_id])


def _spread(key: tuple) -> int:
    return key[0] if key[1] is None else key[1]


def copies(docs: DataFrame, partitions: int) -> RDD:
    """(id, fingerprint) of every document whose text a smaller id has; more than once where rows repeat."""

    def keyed(rows: Iterable) -> Iterator[tuple]:
        """Ids that a task has already found go anywhere; texts go by their fingerprint."""
        for n, (fingerprint, (text, doc_id)) in enumerate(_sent(rows)):
            yield (fingerprint, n if text is None else None), (text, doc_id)

    routed = docs.select("doc_id", "text").rdd.mapPartitions(keyed).partitionBy(partitions, _spread)
    return routed.mapPartitions(lambda rows: _not_least((k[0], v) for k, v in rows))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): all documents by what they fail and how they are labelled.

    Copied ids and labels are joined to rows that are summed by (id, part, fingerprint, mask) first. Rows without an id match neither and skip the joins.
    """
    spark = docs.sparkSession
    rows = materialise(failures(docs), "audit-masks")
    size = rows.agg(F.sum("size")).first()[0] or 0
    kind = rows.schema["doc_id"].dataType.simpleString()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    again = materialise(spark.createDataFrame(copies(docs, partitions), f"doc_id {kind}, fingerprint long").distinct(), "audit-copies")
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    summed = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "part", "fingerprint", "mask").agg(F.count("*").alias("n"))
    # A copied id and fingerprint: another text of the same 64 bits under the same id would count as copied too.
    joined = summed.join(again.withColumn("copied", F.lit(1 << 4)), ["doc_id", "fingerprint"], "left").join(marks, "doc_id", "left")
    value = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    with_id = joined.select("part", (F.col("mask") + F.coalesce("copied", F.lit(0))).alias("mask"), value("good"), value("toxic"), "n")
    bare = rows.filter("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.lit(1).cast("long").alias("n"))
    return with_id.unionByName(bare)


def vectors(rows: DataFrame) -> RDD:
    """(part, counts): 3 x 32 counts of all, good and toxic documents by mask, merged task by task."""

    def add(v: np.ndarray, row: tuple) -> np.ndarray:
        mask, good, toxic, n = row
        v[0, mask] += n
        v[1, mask] += n * good
        v[2, mask] += n * toxic
        return v

    pairs = rows.select("part", "mask", "good", "toxic", "n").rdd.map(lambda r: (r[0], tuple(r[1:])))
    return pairs.combineByKey(lambda row: add(np.zeros((3, MASKS), np.int64), row), add, lambda a, b: a + b)


def interactions(counts: np.ndarray, names: str = FILTERS) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    every, steps, gains = np.arange(counts.shape[1]), [], np.zeros(len(names), np.int64)
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            fails, reached = every >> f & 1 == 1, every & before == 0
            gone = fails & reached
            removed = counts[:, gone].sum(1)
            gains[f] += removed[0]
            before |= 1 << f
            steps.append((order, step, f, counts[0, every & before == 0].sum(), removed, counts[0, fails & ~reached].sum()))
    for order, step, f, kept, removed, redundant in steps:
        yield "".join(names[k] for k in order), step, int(kept), int(removed[0]), int(redundant), int(counts[0, 1 << f]), int(removed[1]), int(removed[2]), int(gains[f])


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part, order and step: what the filter at that step removes, what others had removed before, what only it removes."""
    rows = vectors(flagged(docs, labels)).flatMap(lambda kv: ((kv[0], *r) for r in interactions(kv[1])))
    return docs.sparkSession.createDataFrame(rows, RESULT)

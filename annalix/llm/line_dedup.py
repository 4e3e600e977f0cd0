"""Line dedup that can be undone: exact reference counts of lines, and cuckoo filters over the frequent ones.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased, hashed to 128 bits;
a document counts once for each of its keys. ``LineStore`` keeps the counts as an append-only Parquet
log of differences, so a document is taken out by appending its negated counts. Frequent keys (found in
``least_docs`` documents or more) go into cuckoo filters, one a shard of the key space; there are as many
shards as keep a filter small. A filter takes insertions and deletions of single keys, so an increment
touches the filters only where a key crosses the threshold. Keys of the counts that a filter reports in
error are found by probing all counts once, and kept as exceptions: for counted keys the filter with its
exceptions is exact.

The filters are used in one of two ways. Up to ``filter_bytes`` they are broadcast, and documents are
cleaned where they are read. Beyond, each stays in its row of a table: lines are dealt by shard (a shard
with many lines to several tasks), the task probes them with the shard's filter, and documents get the
keys found by a join on the text.

Defined cases: null and empty text are one empty line. Keys shorter than ``least_chars`` code points are
never dropped. Rows that repeat an id are separate documents. A document of which all lines go has
the empty text. Documents that were never counted are cleaned too, with the filter's error of 2**-29.
Taking out what was never put in leaves counts below zero, which ``below_zero`` shows and no line is dropped for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import arrow_batches, materialise, share, tasks_for, tidy

SPACES = b" \t\n\x0b\x0c\r"
KEY = np.dtype([("hi", ">u8"), ("lo", ">u8")])


@dataclass(frozen=True)
class Settings:
    least_docs: int = 10
    least_chars: int = 1
    #: Fewest shards, and frequent keys in a shard: about 2.6 MB of filter.
    shards: int = 64
    shard_keys: int = 1 << 18
    filter_bytes: int = 32 << 20
    #: Lines that are probed by one task.
    probe_lines: int = 4 << 20


def line_keys(text: bytes, s: Settings) -> tuple[list[bytes], np.ndarray]:
    """The lines and their keys; a key too short to count is all zero."""
    lines = text.split(b"\n")
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(k) if k and (s.least_chars < 2 or len(k.decode()) >= s.least_chars) else bytes(16) for k in (x.strip(SPACES).lower() for x in lines)])
    return lines, np.frombuffer(raw, KEY)


def among(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which keys are among the others; both halves are compared."""
    out = np.isin(keys["hi"].astype(np.uint64), others["hi"].astype(np.uint64), kind="sort")
    at = np.flatnonzero(out)
    if len(at):
        known = set(zip(others["hi"].tolist(), others["lo"].tolist()))
        out[at] = [k in known for k in zip(keys["hi"][at].tolist(), keys["lo"][at].tolist())]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = np.atleast_1d(x)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass
class Cuckoo:
    """Four 32-bit fingerprints a bucket, partial-key placement: the other bucket follows from fingerprint and bucket."""

    buckets: int
    table: np.ndarray = field(default=None)  # (buckets, 4) uint32, 0: free

    def __post_init__(self):
        assert self.buckets & (self.buckets - 1) == 0
        if self.table is None:
            self.table = np.zeros((self.buckets, 4), np.uint32)

    @staticmethod
    def sized(n: int) -> "Cuckoo":
        return Cuckoo(1 << max(1, int(np.ceil(np.log2(max(n, 1) / 3.2 + 1)))))

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (lo >> np.uint64(32)).astype(np.uint32)
        mark = np.where(mark == 0, np.uint32(1), mark)
        first = (_mix(hi) & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self.other(first, mark)

    def other(self, bucket, mark):
        return bucket ^ (_mix(np.asarray(mark).astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(hi, lo)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> "Cuckoo":
        """Returns itself, or a larger filter if it is full (None is returned by ``_place`` then)."""
        for mark, a, b in zip(*self.places(hi, lo)):
            if not self._place(np.uint32(mark), int(a), int(b)):
                raise OverflowError("cuckoo filter is full")
        return self

    def _place(self, mark: np.uint32, a: int, b: int) -> bool:
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = a
        for kick in range(500):
            slot = (kick * 7 + int(mark)) & 3
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self.other(np.int64(bucket), mark)[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> int:
        """Takes out one fingerprint of each key; returns how many were there."""
        n = 0
        for mark, a, b in zip(*self.places(hi, lo)):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    n += 1
                    break
        return n


def build_filter(hi: np.ndarray, lo: np.ndarray) -> Cuckoo:
    n = len(hi)
    while True:
        try:
            return Cuckoo.sized(n).insert(hi, lo)
        except OverflowError:
            n = n * 2 + 8


def shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return (hi >> np.uint64(40)).astype(np.int64) % shards


@dataclass
class Filters:
    """The cuckoo filter of every shard, and the counted keys that they report in error."""

    by_shard: dict[int, Cuckoo]
    shards: int
    wrong: np.ndarray = field(default_factory=lambda: np.zeros(0, KEY))

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tables below one another, and each shard's first bucket and mask, so that one probe serves all shards."""
        if "_flat" not in self.__dict__:
            sizes = np.array([self.by_shard[k].buckets if k in self.by_shard else 1 for k in range(self.shards)], np.int64)
            tables = [self.by_shard[k].table if k in self.by_shard else np.zeros((1, 4), np.uint32) for k in range(self.shards)]
            self._flat = np.concatenate(tables), np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes - 1
        return self._flat

    def has(self, keys: np.ndarray) -> np.ndarray:
        hi, lo = keys["hi"].astype(np.uint64), keys["lo"].astype(np.uint64)
        table, first, most = self.flat()
        shard = shard_of(hi, self.shards)
        mark = (lo >> np.uint64(32)).astype(np.uint32)
        mark[mark == 0] = 1
        a = _mix(hi).view(np.int64) & most[shard]
        b = a ^ (_mix(mark.astype(np.uint64)).view(np.int64) & most[shard])
        out = (table[first[shard] + a] == mark[:, None]).any(1) | (table[first[shard] + b] == mark[:, None]).any(1)
        out &= (hi != 0) | (lo != 0)
        if len(self.wrong) and out.any():
            at = np.flatnonzero(out)
            out[at] = ~among(keys[at], self.wrong)
        return out

    def change(self, hi: np.ndarray, lo: np.ndarray, take_out: bool) -> None:
        """Inserts or deletes frequent keys; a shard that is full is left to the caller (OverflowError)."""
        shard = shard_of(hi, self.shards)
        for k in np.unique(shard).tolist():
            own = shard == k
            f = self.by_shard.setdefault(k, Cuckoo.sized(int(own.sum())))
            f.delete(hi[own], lo[own]) if take_out else f.insert(hi[own], lo[own])
        self.__dict__.pop("_flat", None)


@dataclass(frozen=True)
class Sharded:
    """Filters beyond what is broadcast: (shard, buckets, data), and (shard, hi, lo) of the exceptions."""

    table: DataFrame
    wrong: DataFrame
    shards: int


def _shard(shards: int):
    return F.pmod(F.shiftrightunsigned("hi", 40), F.lit(shards))


_PROBE = "shard long, salt long, kind int, buckets long, data binary, text_key binary, hi long, lo long"


def _as_probe(df: DataFrame, kind: int) -> DataFrame:
    """df with the columns of ``_PROBE``, null where it has none; within a shard filters (0) come before exceptions (1) and lines (2)."""
    have = {"kind": F.lit(kind)} | {c: F.col(c) for c in df.columns}
    return df.select(*(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in _PROBE.split(", "))))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard, salt and kind, the lines that are in their shard's filter and no exceptions."""
    own, f, wrong = None, None, []
    for b in batches:
        at = np.stack([b.column("shard").to_numpy(), b.column("salt").to_numpy(), b.column("kind").to_numpy()], 1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), b.num_rows] if b.num_rows else []
        for lo, hi in zip(cuts, cuts[1:]):
            shard, salt, kind = at[lo].tolist()
            if own != (shard, salt):
                own, f, wrong = (shard, salt), None, []
            part = b.slice(lo, hi - lo)
            if kind == 0:
                f = Cuckoo(part.column("buckets")[0].as_py(), np.frombuffer(part.column("data")[0].as_py(), np.uint32).reshape(-1, 4))
            elif f is not None:
                keys = _as_keys(part.column("hi"), part.column("lo"))
                if kind == 1:
                    wrong.append(keys)
                    continue
                hit = f.has(keys["hi"].astype(np.uint64), keys["lo"].astype(np.uint64))
                if wrong:
                    hit &= ~among(keys, np.concatenate(wrong))
                yield part.filter(pa.array(hit)).select(["text_key", "hi", "lo"])


def _keys_of(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = []
        for text in b.column("text").to_pylist():
            keys = np.unique(line_keys((text or "").encode(), s)[1])
            own.append(keys[(keys["hi"] != 0) | (keys["lo"] != 0)])
        flat = np.concatenate(own) if own else np.zeros(0, KEY)
        yield pa.RecordBatch.from_arrays([pa.array(flat["hi"].astype(np.uint64).view(np.int64)), pa.array(flat["lo"].astype(np.uint64).view(np.int64))], ["hi", "lo"])


def _as_keys(hi, lo) -> np.ndarray:
    out = np.zeros(len(hi), KEY)
    out["hi"], out["lo"] = np.asarray(hi, np.int64).view(np.uint64), np.asarray(lo, np.int64).view(np.uint64)
    return out


class LineStore:
    """Reference counts under ``path`` in the shared folder, and what follows from them."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        arrow_batches(spark)

    def _log(self, docs: DataFrame, sign: int) -> None:
        s = self.settings
        keys = docs.select("text").mapInArrow(tidy(lambda it: _keys_of(it, s)), "hi long, lo long")
        counts = keys.groupBy("hi", "lo").agg((F.count("*") * sign).alias("n"))
        counts.write.mode("append").parquet(f"{self.path}/log")

    def insert(self, docs: DataFrame) -> "LineStore":
        self._log(docs, 1)
        return self

    def delete(self, docs: DataFrame) -> "LineStore":
        """Takes documents out again; they must have been inserted with the same text."""
        self._log(docs, -1)
        return self

    def counts(self) -> DataFrame:
        """(hi, lo, n): the exact number of documents of every key."""
        log = self.spark.read.schema("hi long, lo long, n long").parquet(f"{self.path}/log")
        return log.groupBy("hi", "lo").agg(F.sum("n").alias("n")).filter("n <> 0")

    def below_zero(self) -> DataFrame:
        """(hi, lo, n) of the keys that were taken out more often than put in."""
        return self.counts().filter("n < 0")

    def filters(self) -> Filters | Sharded:
        """In memory if they fit ``filter_bytes`` with their exceptions, which is checked before anything is gathered."""
        s = self.settings
        logged = self.spark.read.parquet(f"{self.path}/log").count()
        counts = materialise(self.counts().coalesce(max(8, tasks_for(logged, 1 << 18))), "line-counts")
        keys = counts.filter(F.col("n") >= s.least_docs).select("hi", "lo")
        n = max(s.shards, -(-keys.count() // s.shard_keys))

        def build(pdf):
            import pandas as pd

            f = build_filter(pdf["hi"].to_numpy(np.int64).view(np.uint64), pdf["lo"].to_numpy(np.int64).view(np.uint64))
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "buckets": [f.buckets], "data": [f.table.tobytes()]})

        made = keys.withColumn("shard", _shard(n)).groupBy("shard").applyInPandas(build, "shard long, buckets long, data binary")
        made = materialise(made.coalesce(max(1, n // 16)), "filters")
        if (made.agg(F.sum(16 * F.col("buckets"))).first()[0] or 0) <= s.filter_bytes:
            out = Filters({r["shard"]: Cuckoo(r["buckets"], np.frombuffer(bytes(r["data"]), np.uint32).reshape(-1, 4).copy()) for r in made.collect()}, n)
            out = self._with_errors(out, counts)
            if out is not None:
                return out
        rare = counts.filter(F.col("n") < s.least_docs).select("hi", "lo").withColumn("shard", _shard(n))
        wrong = self._in_shards(rare, Sharded(made, None, n)).select("hi", "lo").withColumn("shard", _shard(n))
        return Sharded(made, materialise(wrong, "wrong"), n)

    def _in_shards(self, lines: DataFrame, filters: Sharded) -> DataFrame:
        """(text_key, hi, lo) of the lines that their shard's filter reports. A shard goes to as many tasks as its lines ask for."""
        salts = lines.groupBy("shard").agg(F.ceil(F.count("*") / self.settings.probe_lines).alias("salts"))
        salts = materialise(salts.coalesce(1), "salts")  # one row a shard
        draw = F.pmod(F.xxhash64("hi", "lo", *[c for c in ("text_key",) if c in lines.columns]), F.col("salts"))
        lines = lines.join(salts, "shard").withColumn("salt", draw)
        each = lambda df: df.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        rows = _as_probe(each(filters.table), 0).unionByName(_as_probe(lines, 2))
        if filters.wrong is not None:
            rows = rows.unionByName(_as_probe(each(filters.wrong), 1))
        rows = rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        return rows.mapInArrow(tidy(_probe), "text_key binary, hi long, lo long")

    def _with_errors(self, out: Filters, counts: DataFrame) -> Filters | None:
        """Sets the exceptions; None if they are too many."""
        s = self.settings
        out.wrong = np.zeros(0, KEY)
        shared = share(self.spark, out)

        def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(shared.value.has(_as_keys(b.column("hi"), b.column("lo")))))

        wrong = counts.filter(F.col("n") < s.least_docs).select("hi", "lo").mapInArrow(tidy(errors), "hi long, lo long")
        wrong = wrong.limit(s.filter_bytes // 16 + 1).toPandas()
        if 16 * len(wrong) > s.filter_bytes:
            return None
        out.wrong = np.sort(_as_keys(wrong["hi"], wrong["lo"]))
        return out

    def advance(self, filters: Filters | Sharded, docs: DataFrame, remove: bool = False) -> Filters | Sharded:
        """Inserts (or removes) documents and brings the filters up to date: only keys that cross the threshold change."""
        s = self.settings
        before = materialise(self.counts(), "line-counts")
        self._log(docs, -1 if remove else 1)
        after = materialise(self.counts(), "line-counts")
        was, now = (x.filter(F.col("n") >= s.least_docs).select("hi", "lo") for x in (before, after))
        come, go = now.join(was, ["hi", "lo"], "left_anti"), was.join(now, ["hi", "lo"], "left_anti")
        if isinstance(filters, Sharded) or 16 * (come.count() + go.count()) > s.filter_bytes or 10 * now.count() > s.filter_bytes:
            return self.filters()
        try:
            for keys, take_out in ((go.toPandas(), True), (come.toPandas(), False)):
                filters.change(keys["hi"].to_numpy(np.int64).view(np.uint64), keys["lo"].to_numpy(np.int64).view(np.uint64), take_out)
        except OverflowError:
            return self.filters()
        return self._with_errors(filters, after) or self.filters()

    def _texts_with(self, docs: DataFrame, filters: Sharded) -> DataFrame:
        """(text_key, keys): the frequent keys of each text that has some, each found by the filter of its shard."""
        s = self.settings

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                owner, own = [], []
                for d, text in zip(b.column("text_key").to_pylist(), b.column("text").to_pylist()):
                    keys = np.unique(line_keys((text or "").encode(), s)[1])
                    keys = keys[(keys["hi"] != 0) | (keys["lo"] != 0)]
                    own.append(keys)
                    owner += [d] * len(keys)
                flat = np.concatenate(own) if own else np.zeros(0, KEY)
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.binary()), pa.array(flat["hi"].astype(np.uint64).view(np.int64)), pa.array(flat["lo"].astype(np.uint64).view(np.int64))], ["text_key", "hi", "lo"])

        lines = docs.select(text_key(), "text").mapInArrow(tidy(keyed), "text_key binary, hi long, lo long")
        hot = self._in_shards(lines.withColumn("shard", _shard(filters.shards)), filters)
        return hot.groupBy("text_key").agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))  # at most the text's lines

    def map_texts(self, docs: DataFrame, run_on, schema) -> DataFrame:
        """run_on(batch, lines, masks) -> batch on docs; lines and masks (true: dropped) have a list for each row."""
        s = self.settings
        filters = self.filters()
        if isinstance(filters, Filters):
            shared = share(self.spark, filters)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        lines, keys = zip(*(line_keys((t or "").encode(), s) for t in b.column("text").to_pylist()))
                        hit = shared.value.has(np.concatenate(keys))
                        yield run_on(b, lines, np.split(hit, np.cumsum([len(k) for k in keys])[:-1]))

            return docs.mapInArrow(tidy(run), schema)
        hot = self._texts_with(docs, filters)
        joined = docs.withColumn("__line_key", text_key()).join(hot.select(F.col("text_key").alias("__line_key"), F.col("keys").alias("__line_hot")), "__line_key", "left").drop("__line_key")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lines, masks = [], []
                for t, hot in zip(b.column("text").to_pylist(), b.column("__line_hot").to_pylist()):
                    own_lines, keys = line_keys((t or "").encode(), s)
                    own = _as_keys([k["hi"] for k in hot or ()], [k["lo"] for k in hot or ()])
                    lines.append(own_lines)
                    masks.append(among(keys, own))
                yield run_on(b.drop_columns(["__line_hot"]), lines, masks)

        return joined.mapInArrow(tidy(run), schema)

    def report(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""
        kind = docs.schema["doc_id"].dataType.simpleString()

        def figures(b: pa.RecordBatch, lines, masks) -> pa.RecordBatch:
            sha = [hashlib.sha256(b"\n".join([x for x, m in zip(own, mask.tolist()) if not m])).hexdigest() for own, mask in zip(lines, masks)]
            return pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in lines], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

        return self.map_texts(docs.select("doc_id", "text"), figures, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs with the frequent lines gone from their texts; n_chars, if there, follows. A null text stays null."""

        def cut(b: pa.RecordBatch, lines, masks) -> pa.RecordBatch:
            texts, changed = b.column("text").to_pylist(), False
            for row, (own, mask) in enumerate(zip(lines, masks)):
                if texts[row] is not None and mask.any():
                    texts[row] = b"\n".join([x for x, m in zip(own, mask.tolist()) if not m]).decode()
                    changed = True
            if not changed:
                return b
            b = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, b.column("text").type))
            at = b.schema.get_field_index("n_chars")
            if at >= 0 and pa.types.is_integer(b.schema.field(at).type):
                b = b.set_column(at, b.schema.field(at), pa.array([None if t is None else len(t) for t in texts], b.schema.field(at).type))
            return b

        return self.map_texts(docs, cut, docs.schema)


def text_key():
    """128 bits of a text's content; null as empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key")

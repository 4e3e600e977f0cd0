"""Stored tables: bucketed by session, so that joins, aggregates and windows by session need no shuffle.

``StoredJournal`` keeps a journal for good: numbers are given once, when events come, and kept with them,
so a range of them reaches the Parquet files, and a session is one bucket. ``kept`` stores what is
derived from given files, once an application, under a name that changes with the files.

A session of any length is written by several tasks: its numbers come from range blocks (``prefix``), and
each block of ``SPLIT`` numbers of a session makes a file of its own in the session's bucket.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import prefix
from .scratch import shared_dir

#: Rows of one session that a task writes.
SPLIT = 1 << 22


def buckets(spark: SparkSession) -> int:
    """``annalix.journal.buckets``, else as many as shuffle partitions."""
    return int(spark.conf.get("annalix.journal.buckets", None) or spark.conf.get("spark.sql.shuffle.partitions"))


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_bucketed(rows: DataFrame, name: str, n: int, sort: list[str], path: str | None = None) -> None:
    """Adds rows to n buckets by session, one file a bucket and ``SPLIT`` numbers of a session, sorted by session and ``sort``.

    Tasks are dealt by bucket number: a task that held many buckets would write a file for each.
    """
    bucket = F.pmod(F.hash("session"), F.lit(n))  # the number that Spark gives the bucket
    dealt = [bucket, F.floor(F.col("sequence") / SPLIT)] if "sequence" in rows.columns else [bucket]
    out = rows.repartition(n, *dealt).write.mode("append").format("parquet").bucketBy(n, "session").sortBy("session", *sort)
    (out.option("path", path) if path else out).saveAsTable(name)


def register(spark: SparkSession, name: str, path: str, schema: str, n: int, sort: list[str]) -> None:
    """Makes a bucketed folder that another application wrote known to this one."""
    by = ", ".join(["session", *sort])
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (session) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")


class StoredJournal:
    """A journal at ``path``. Of several batches with one key only the first event counts, in a batch and over batches.

    Defined cases: an event without a session is refused by its null key and never stored; a batch without rows changes nothing;
    rows that tie in ``arrival`` are numbered in order of their key. One writer at a time: publish through ``versions`` where there are several.
    """

    #: Columns of an event, and the order of a session.
    SCHEMA = "session BIGINT, event_id STRING, sequence BIGINT, event_type STRING, role STRING, content STRING, source_hook STRING, idempotency_key STRING, token_count BIGINT"
    SORT = ("sequence",)

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = "annalix_journal_" + hashlib.sha256(self.path.encode()).hexdigest()[:20]
        self.n = self._known_buckets()

    def _known_buckets(self) -> int:
        """The number of buckets is part of the folder's name: it can't change once there are files."""
        at, fs = _fs(self.spark, self.path)
        if fs.exists(at):
            for s in fs.listStatus(at):
                if s.getPath().getName().startswith("buckets-"):
                    return int(s.getPath().getName().split("-")[1])
        return buckets(self.spark)

    @property
    def folder(self) -> str:
        return f"{self.path}/buckets-{self.n}"

    @property
    def table(self) -> DataFrame:
        """All events. Filters on session choose buckets, filters on sequence reach the files, and what goes by session is not shuffled."""
        self._open()
        return self.spark.table(self.name)

    def _open(self) -> None:
        if not self.spark.catalog.tableExists(self.name):
            at, fs = _fs(self.spark, self.folder)
            fs.mkdirs(at)
            register(self.spark, self.name, self.folder, self.SCHEMA, self.n, list(self.SORT))

    def heads(self) -> DataFrame:
        """(session, high_water): an aggregate within buckets."""
        return self.table.groupBy("session").agg(F.max("sequence").alias("high_water"))

    def append(self, batch: DataFrame) -> int:
        """Stores the new events of a batch with numbers that go on from their sessions' marks; how many there were.

        A batch has the columns of an event but sequence, and ``arrival``. Stored and repeated keys add nothing, so a batch can be sent again.
        """
        key = ["session", "source_hook", "idempotency_key"]
        names = [c.split()[0] for c in self.SCHEMA.split(", ")]
        seen = self.table.join(F.broadcast(batch.select("session").distinct()), "session", "left_semi") if self._small(batch) else self.table
        first = F.min_by(F.struct("arrival", *[c for c in names if c not in ("sequence", *key)]), F.struct("arrival", "event_id"))
        once = batch.filter("session IS NOT NULL").groupBy(*key).agg(first.alias("e")).select(*key, "e.*")
        fresh = once.join(seen.select(*key), key, "left_anti")
        numbered = prefix.running(fresh, ["session"], [F.col("arrival"), F.col("source_hook"), F.col("idempotency_key")], {"_n": F.lit(1)})
        heads = self.heads()
        rows = numbered.join(heads, "session", "left").withColumn("sequence", F.coalesce("high_water", F.lit(0)) + F.col("_n"))
        rows = prefix.materialise(rows.select(*[F.col(n).cast(t) for n, t in (c.split() for c in self.SCHEMA.split(", "))]), "append")
        added = rows.count()
        if added:
            write_bucketed(rows, self.name, self.n, list(self.SORT))
        return added

    def _small(self, batch: DataFrame, most: int = 1 << 16) -> bool:
        """Whether the batch's sessions are few enough to broadcast."""
        return batch.select("session").distinct().limit(most + 1).count() <= most


_kept: dict[tuple[str, str], str] = {}


def kept(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], sort: list[str]) -> DataFrame:
    """What ``build`` derives from the files at ``source``, stored once an application and bucketed by session. Changed files make a new table."""
    at, fs = _fs(spark, source)
    size = fs.getContentSummary(at)
    facts = f"{source} {size.getLength()} {size.getFileCount()} {fs.getFileStatus(at).getModificationTime()} {buckets(spark)}"
    key = (spark.sparkContext.applicationId, f"{name} {facts}")
    if key not in _kept or not spark.catalog.tableExists(_kept[key]):
        table = f"annalix_{name}_{uuid.uuid4().hex}"
        write_bucketed(build(), table, buckets(spark), sort, f"{shared_dir(spark)}/annalix-tables/{spark.sparkContext.applicationId}/{table}")
        _kept[key] = table
    return spark.table(_kept[key])


def forget(spark: SparkSession) -> None:
    """Drops this application's kept tables and deletes their files."""
    own = [k for k in _kept if k[0] == spark.sparkContext.applicationId]
    for k in own:
        spark.sql(f"DROP TABLE IF EXISTS {_kept.pop(k)}")
    at, fs = _fs(spark, f"{shared_dir(spark)}/annalix-tables/{spark.sparkContext.applicationId}")
    fs.delete(at, True)

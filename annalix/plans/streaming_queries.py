"""Queries that go through streams, over files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import Store, read
from ..sources.prelude import NOW
from ..sources.scratch import scratch
from ..sources.versions import Versions
from ..streaming import maps, queue
from .registry import query


def _as_stream(rows: DataFrame, name: str, files: int = 4, per_batch: int = 2) -> DataFrame:
    """The rows in files of equal shares, some files a micro-batch."""
    path, spark = scratch(rows.sparkSession, name), rows.sparkSession
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _into(stream: DataFrame, name: str) -> DataFrame:
    """All rows that a stream gives, as a written table."""
    spark, path, schema = stream.sparkSession, scratch(stream.sparkSession, name), stream.schema
    out = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, f"{name}-checkpoint"))
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path)


@query("sink_09_stream", "SELECT 'job-new-' || user_id AS job_id, 'PENDING' AS state, count(*) AS intent FROM events GROUP BY user_id")
def sink_09_stream(spark, sf_dir):
    """Every event triggers its session up to itself, in two micro-batches that each come twice: one pending job a session, which reaches its last event."""
    s = Store(spark, sf_dir)
    triggers = s.activity.select("session", F.col("sequence").alias("target"), F.lit(0).cast("long").alias("base_coverage"))
    jobs = queue.Queue(Versions(spark, scratch(spark, "jobs")), "events")

    def twice(batch: DataFrame, n: int) -> None:
        jobs.apply(batch, n)
        if jobs.apply(batch, n):
            raise RuntimeError("a batch that came again was counted again")

    stream = _as_stream(triggers, "triggers")
    stream.writeStream.option("checkpointLocation", scratch(spark, "triggers-checkpoint")).foreachBatch(twice).trigger(availableNow=True).start().awaitTermination()
    return jobs.jobs().select("job_id", "state", "intent")


@query("map_01_stream", "SELECT session, latest FROM (SELECT session, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest, row_number() OVER (ORDER BY max(ts) DESC, session) AS n FROM (SELECT user_id AS session, ts FROM events) GROUP BY session) WHERE n <= 64")
def map_01_stream(spark, sf_dir):
    """The map of map_01, held by map states over a stream."""
    maps.use_rocksdb(spark)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    uses = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("at"))
    given = _into(maps.recent(_as_stream(uses, "uses"), 64), "recent")
    return maps.last_of_all(given, 64).select(F.col("key").alias("session"), F.date_format(F.timestamp_micros("at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("latest"))


@query("sink_14_stream", f"SELECT job_id, lease_owner FROM jobs WHERE lease_expires_at <= '{NOW}'")
def sink_14_stream(spark, sf_dir):
    """Leases of all jobs as a stream, and one row of another kind a millisecond after now: what has run out by then comes from timers."""
    maps.use_rocksdb(spark)
    millis = lambda c: F.unix_millis(F.to_timestamp(c))
    leases = Store(spark, sf_dir).jobs.select("job_id", F.col("lease_owner").alias("owner"), millis("lease_expires_at").alias("until"), F.to_timestamp("created_at").alias("ts"))
    clock = spark.createDataFrame([("clock",)], "job_id string").select("job_id", F.lit(None).cast("string").alias("owner"), F.lit(None).cast("long").alias("until"), F.timestamp_millis(millis(F.lit(NOW)) + 1).alias("ts"))
    gone = _into(maps.expired_leases(_as_stream(leases.unionByName(clock), "leases", 2, 2)), "expired")
    return gone.select("job_id", F.col("owner").alias("lease_owner"))

"""Intermediate tables: written to the folder that all executors share, so that lost executors cost a rerun and no more."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where a local session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("annalix.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="annalix-")
        spark.conf.set("annalix.shared.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under this application's folder, the one ``annalix.llm._shared.clear`` deletes as well."""
    return f"{shared_dir(spark)}/annalix/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it: cuts lineage, and every later read sees the same rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; results that still read them must have been written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/annalix/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

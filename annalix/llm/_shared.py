"""Where intermediate tables go, and Arrow settings for whole-text columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of Arrow data handed to a Python worker at a time.
BATCH_BYTES = 2 << 20
#: Rows that a Parquet reader unpacks at a time.
READ_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where a local session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("annalix.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="annalix-")
        spark.conf.set("annalix.shared.dir", where)
    return where.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/annalix/{spark.sparkContext.applicationId}"


#: What the innermost open ``scope`` has been asked for: paths and broadcast values.
_scopes: list[tuple[list[str], list]] = []


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1][0].append(path)
    return path


def share(spark: SparkSession, value):
    """A broadcast variable. The caller has checked its size."""
    out = spark.sparkContext.broadcast(value)
    if _scopes:
        _scopes[-1][1].append(out)
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Intermediate tables and broadcast values made within go at its end; results that need them must have been written by then."""
    _scopes.append(([], []))
    try:
        yield
    finally:
        paths, values = _scopes.pop()
        for v in values:
            v.destroy()
        for p in paths:
            delete(spark, p)


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; results that still read them must have been written."""
    delete(spark, _own(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: int, each: int = 1 << 16) -> int:
    """Tasks for a table of so many narrow rows, to be given to ``coalesce``."""
    return max(1, -(-rows // each))


def arrow_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, and the rows that a reader unpacks at a time, so that very long texts don't pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def _libc():
    import ctypes

    with contextlib.suppress(OSError):
        return ctypes.CDLL("libc.so.6")
    return None


def steady_memory() -> None:
    """Large arrays get memory of their own, which goes back to the system when they go (glibc only)."""
    libc = _libc()
    if libc is not None and hasattr(libc, "mallopt"):
        for option, value in ((-3, 1 << 20), (-1, 4 << 20), (-8, 2)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            libc.mallopt(option, value)


def trim() -> None:
    """Gives memory that Python and Arrow no longer use back to the system: workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """A function for mapInArrow that keeps its worker small."""

    def wrapped(batches):
        steady_memory()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

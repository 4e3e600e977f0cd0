"""Token counts of whole texts behind a digest cache.

A text's digest is the SHA-256 of its normalised content, joined with the digest of the tokenizer's
file. Counts stored under both digests are joined; of the others, one text a digest is encoded and
appended to the cache, which is a Parquet folder with one part a run. Normalisation only trims ASCII
white space, and only for a tokenizer that drops it.

Defined cases: null counts as empty, with 0 bytes. Equal texts are encoded once, and each row gets
the count. An absent cache is an empty one; a stored digest twice counts once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._bpe import encoder, file_digest, splits_at_space
from ._shared import arrow_batches, materialise, tidy

CACHE = "content binary, tokenizer string, n_tokens long"


def cached(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of what the cache folder holds for one tokenizer digest."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not there.exists(hadoop):
        return spark.createDataFrame([], "content binary, n_tokens long")
    stored = spark.read.schema(CACHE).option("recursiveFileLookup", "true").parquet(path).filter(F.col("tokenizer") == tokenizer)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _keyed(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text, content): the text, never null, and the digest of its normalised content."""
    trims = False
    if tokenizer_path.endswith(".json"):
        with open(tokenizer_path, encoding="utf-8") as f:
            trims = splits_at_space(json.load(f))
    text = F.coalesce("text", F.lit(""))
    content = F.btrim(text, F.lit(" \t\n\x0b\f\r")) if trims else text
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(content, 256)).alias("content"))


def _store_missing(keyed: DataFrame, rows: DataFrame, tokenizer_path: str, cache_path: str, version: str) -> None:
    """Encodes one text of each digest of rows that the cache lacks, and appends the counts."""
    store = cached(keyed.sparkSession, cache_path, version)
    missing = rows.groupBy("content").agg(F.min("doc_id").alias("rep")).join(store, "content", "left_anti")
    missing = missing.select(F.col("content").alias("want"), "rep")
    # One row a digest goes on: the text of its least id (an id that repeats is encoded that often and stored once).
    texts = keyed.join(missing, (F.col("content") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            n = enc.counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"])

    texts.select("content", "text").mapInArrow(tidy(run), CACHE).write.mode("append").parquet(cache_path)


def store_counts(docs: DataFrame, tokenizer_path: str, cache_path: str) -> None:
    """Brings the cache up to date with docs, without a result."""
    arrow_batches(docs.sparkSession)
    keyed = _keyed(docs, tokenizer_path)
    _store_missing(keyed, keyed.select("doc_id", "content"), tokenizer_path, cache_path, file_digest(tokenizer_path))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs; misses are encoded and stored first."""
    spark = docs.sparkSession
    arrow_batches(spark)
    version = file_digest(tokenizer_path)
    keyed = _keyed(docs, tokenizer_path)
    rows = materialise(keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    _store_missing(keyed, rows, tokenizer_path, cache_path, version)
    counts = materialise(cached(spark, cache_path, version), "counts")  # a plain table on either side: a hot digest's rows can be split
    found = rows.join(counts, "content", "left")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

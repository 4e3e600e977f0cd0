"""Documents to training sequences: language, repeated lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of the one before; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalix.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from annalix.llm._shared import delete, held_out, scope, scratch, table
from annalix.llm.queries import tokenizer_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs, ~held_out()))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.LineStore(spark, scratch(spark, "lines")).insert(docs).clean(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_common_lines),
    ("jaccard_join", keep_one_near_copy),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: SQL has neither the classifier nor the tokenizer: tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's own tables and broadcast values go once its result is written, and that result once the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        with scope(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

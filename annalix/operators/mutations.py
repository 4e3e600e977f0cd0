"""Appends to the journal and its side tables: what a batch adds, and what it conflicts with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .checks import TRIPLES

KEY = ["session", "source_hook", "idempotency_key"]


def capture(journal: DataFrame, incoming: DataFrame) -> DataFrame:
    """New events of a batch with their sequence numbers; replays of stored or earlier events add none.

    incoming has an ``arrival`` order. Numbers go on from each session's high-water mark.
    """
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("arrival"))
    fresh = incoming.withColumn("_n", first).filter("_n = 1").drop("_n").join(journal.select(*KEY), KEY, "left_anti")
    marks = journal.groupBy("session").agg(F.max("sequence").alias("_mark"))
    n = F.row_number().over(Window.partitionBy("session").orderBy("arrival"))
    return fresh.join(marks, "session", "left").withColumn("sequence", F.coalesce("_mark", F.lit(0)) + n).drop("_mark")


#: What each typed entry point writes as event type, role and hook.
ENTRY_POINTS = dict(zip(("user", "assistant", "tool_call", "tool_result"), TRIPLES))


def typed(incoming: DataFrame, entry_point: str) -> DataFrame:
    """A batch as it comes through one entry point: type, role and hook follow from it, whatever the batch says."""
    names = zip(("event_type", "role", "source_hook"), ENTRY_POINTS[entry_point])
    return incoming.withColumns({n: F.lit(v) for n, v in names})


def replay_conflicts(rows: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Keys under which different contents were sent."""
    return rows.groupBy(*key).agg(F.count_distinct(F.struct(*content)).alias("versions")).filter("versions > 1")


def put_metrics(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows in conflict): an equal stored count is accepted, a different one is not.

    A key that a batch repeats with one count is one row; with several counts all of them are in conflict, and none is appended. A null count is a count of its own.
    """
    key = ["artifact_kind", "artifact_id", "profile"]
    once = new.dropDuplicates([*key, "token_count"]).withColumn("_versions", F.count("*").over(Window.partitionBy(*key)))
    both = once.join(stored.select(*key, F.col("token_count").alias("stored_count"), F.lit(True).alias("_stored")), key, "left")
    known = F.col("_stored").isNotNull()
    fresh = both.filter(~known & (F.col("_versions") == 1)).drop("stored_count", "_stored", "_versions")
    bad = both.filter((F.col("_versions") > 1) & ~known | known & ~F.col("stored_count").eqNullSafe(F.col("token_count"))).drop("_stored", "_versions")
    return fresh, bad


def observations(rows: DataFrame, stored_intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics, new intents) of counted artifacts: rows without a count become intents unless there is one, one for each artifact. Repeated counts come once; ``put_metrics`` judges different ones."""
    key = ["artifact_kind", "artifact_id", "profile"]
    intents = rows.filter("token_count IS NULL").select(*key, "session").dropDuplicates(key).join(stored_intents.select(*key), key, "left_anti")
    return rows.filter("token_count IS NOT NULL").select(*key, "token_count").distinct(), intents


def insert_or_verify(stored: DataFrame, new: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, action), one row a key: INSERT, VERIFIED for equal content, or CONFLICT, also where the new rows of a key differ."""
    old = stored.select(F.col(key).alias("_k"), F.sha2(content, 256).alias("_old"), F.lit(True).alias("_there"))
    told = new.select(F.col(key), F.sha2(content, 256).alias("_new")).groupBy(key).agg(F.min("_new").alias("_new"), (F.count_distinct("_new") + F.max(F.when(F.col("_new").isNull(), 1).otherwise(0))).alias("_versions"))
    both = told.join(old, F.col(key) == F.col("_k"), "left")
    same = F.col("_old").eqNullSafe(F.col("_new"))
    return both.select(key, F.when(F.col("_versions") > 1, "CONFLICT").when(F.col("_there").isNull(), "INSERT").when(same, "VERIFIED").otherwise("CONFLICT").alias("action"))


def encrypt(text: Column, table: str, column: str, key: Column, secret: Column, iv: Column) -> Column:
    """AES-GCM bound to the cell: table, column and record key are authenticated."""
    return F.base64(F.aes_encrypt(text, secret, F.lit("GCM"), F.lit("DEFAULT"), iv, F.concat_ws("\0", F.lit(table), F.lit(column), key)))


def decrypt(cell: Column, table: str, column: str, key: Column, secret: Column) -> Column:
    return F.aes_decrypt(F.unbase64(cell), secret, F.lit("GCM"), F.lit("DEFAULT"), F.concat_ws("\0", F.lit(table), F.lit(column), key)).cast("string")


def swap_pointers(pointers: DataFrame, proposals: DataFrame) -> DataFrame:
    """(session, snapshot_id, expected, outcome) of proposals to move pointers: of those that expect the current version the first by id wins."""
    current = pointers.select("session", F.col("pointer_version").alias("current"))
    joined = proposals.join(current, "session", "left").withColumn("fits", F.col("expected") == F.coalesce("current", F.lit(0)))
    first = F.row_number().over(Window.partitionBy("session", "fits").orderBy("snapshot_id"))
    return joined.select("session", "snapshot_id", "expected", F.when(F.col("fits") & (first == 1), "COMMITTED").otherwise("SUPERSEDED").alias("outcome"))


def publish(pointers: DataFrame, proposals: DataFrame, reports: DataFrame) -> DataFrame:
    """The same for audited candidates: one whose report didn't pass is REJECTED and takes no part."""
    passed = proposals.join(reports.filter("passed").select("session"), "session", "left_semi")
    rest = proposals.join(reports.filter("passed").select("session"), "session", "left_anti")
    return swap_pointers(pointers, passed).unionByName(rest.select("session", "snapshot_id", "expected", F.lit("REJECTED").alias("outcome")))


def new_snapshots(stored: DataFrame, committed: DataFrame) -> DataFrame:
    """Committed snapshots to append: those of sessions and ends that have none. Of several for one end in a batch the first by id is added."""
    key = ["session", "covered_event_end"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("snapshot_id"))
    once = committed.withColumn("_n", first).filter("_n = 1").drop("_n")
    return once.join(stored.select(*key), key, "left_anti").select(*committed.columns)


def pending_migrations(known: DataFrame, applied: DataFrame) -> DataFrame:
    """(version, state) of schema steps (version, checksum): APPLIED, PENDING, CHANGED, or UNKNOWN for one we don't know."""
    both = known.join(applied.select("version", F.col("checksum").alias("stored")), "version", "full_outer")
    state = F.when(F.col("checksum").isNull(), "UNKNOWN").when(F.col("stored").isNull(), "PENDING").when(F.col("stored") == F.col("checksum"), "APPLIED").otherwise("CHANGED")
    return both.select("version", state.alias("state"))


def rekey(cells: DataFrame, table: str, column: str, key: str, old: Column, new: Column) -> DataFrame:
    """Every cell decrypted with the old secret and encrypted with the new, in one pass; the iv follows from key and cell."""
    text = decrypt(F.col(column), table, column, F.col(key), old)
    iv = F.unhex(F.substring(F.sha2(F.concat_ws("\0", F.col(key), F.col(column)), 256), 1, 24))
    return cells.withColumn(column, encrypt(text, table, column, F.col(key), new, iv))

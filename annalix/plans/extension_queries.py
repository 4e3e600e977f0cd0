from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import metadata
from ..operators import audit, graph, joins, mutations, retrieval, solvers
from ..sources import Store
from .blocks_sql import BLOCKS, QUERY
from .composite_queries import candidates
from .registry import query
from .window_queries import tooled

_SEQ = "(SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)"
_NTH = "(sequence - 1) % 6"


@query("json_05", f"SELECT session, sequence, CASE WHEN {_NTH} BETWEEN 1 AND 4 THEN 't' || CASE WHEN session % 7 = 0 AND {_NTH} = 4 THEN 9 WHEN {_NTH} IN (1, 4) THEN 1 ELSE 2 END END AS tool, CASE WHEN {_NTH} BETWEEN 1 AND 4 THEN '{{\"k\":' || CASE WHEN {_NTH} IN (1, 4) THEN 1 ELSE 2 END || '}}' END AS arguments FROM {_SEQ}")
def json_05(spark, sf_dir):
    rows = tooled(Store(spark, sf_dir))
    return rows.select("session", "sequence", metadata.tool_fingerprint("event_type", "content").alias("f")).select("session", "sequence", "f.tool", "f.arguments")


@query("json_04", f"SELECT session, sequence, sequence % 4 = 0 AS lossy FROM {_SEQ}")
def json_04(spark, sf_dir):
    text = F.when(F.col("sequence") % 4 == 0, F.lit('{"a":[{"b":{"Truncated-Items":1}}]}')).otherwise(F.lit('{"a":[{"b":{"items":1}}]}'))
    return Store(spark, sf_dir).activity.select("session", "sequence", metadata.lossy_marker(text).alias("lossy"))


_CUT = "CASE WHEN length(content) <= 512 THEN to_json(content)::VARCHAR ELSE '{\"characters\":' || length(content) || ',\"text\":' || to_json(left(content, 512))::VARCHAR || ',\"truncated\":true}' END"


def _arguments():
    return F.to_json(F.struct(F.col("sequence").alias("n"), F.col("content").alias("content")))


@query("json_07", f"SELECT event_id, '{{\"content\":' || {_CUT} || ',\"n\":' || sequence || '}}' AS canonical FROM journal")
def json_07(spark, sf_dir):
    return Store(spark, sf_dir).journal.select("event_id", metadata.canonical_value(_arguments()).alias("canonical"))


@query("json_08", f"SELECT event_id, '{{\"arguments\":{{\"content\":' || {_CUT} || ',\"n\":' || sequence || '}},\"kind\":\"call\",\"tool\":\"' || event_type || '\"}}' AS metadata FROM journal")
def json_08(spark, sf_dir):
    return Store(spark, sf_dir).journal.select("event_id", metadata.call_metadata(F.col("event_type"), _arguments()).alias("metadata"))


def _ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("scan_14", lambda: f"SELECT hex(from_base64(token)) AS token, rank FROM read_csv('{_ranks_path()}', delim=' ', header=false, quote='', escape='', auto_detect=false, columns={{'token': 'VARCHAR', 'rank': 'BIGINT'}})")
def scan_14(spark, sf_dir):
    """Ranks of a public vocabulary file."""
    path = _ranks_path()
    return metadata.mergeable_ranks(spark, "file://" + path, *metadata.file_facts(path)).select(F.hex("token").alias("token"), "rank")


def _proposals(s: Store):
    return s.pointers.select("session", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit("c"))).alias("k"), "pointer_version").select(
        "session", F.concat(F.lit("next-"), "k", F.lit("-"), "session").alias("snapshot_id"), F.when(F.col("k") == "c", F.col("pointer_version") - 1).otherwise(F.col("pointer_version")).alias("expected")
    )


_PROPOSED = "SELECT session, 'next-' || k || '-' || session AS snapshot_id, pointer_version - CASE k WHEN 'c' THEN 1 ELSE 0 END AS expected, CASE k WHEN 'a' THEN 'COMMITTED' ELSE 'SUPERSEDED' END AS outcome FROM pointers, (VALUES ('a'), ('b'), ('c')) t(k)"


@query("sink_16", _PROPOSED)
def sink_16(spark, sf_dir):
    s = Store(spark, sf_dir)
    return mutations.swap_pointers(s.pointers, _proposals(s))


@query("sink_15", f"SELECT session, snapshot_id, expected, CASE WHEN session % 19 IN (0, 18) THEN outcome ELSE 'REJECTED' END AS outcome FROM ({_PROPOSED}) WHERE session IN (SELECT session FROM marks WHERE covered >= 3)")
def sink_15(spark, sf_dir):
    s = Store(spark, sf_dir)
    audited = s.marks.filter("covered >= 3").select("session")
    return mutations.publish(s.pointers, _proposals(s).join(audited, "session", "left_semi"), audit.validate(candidates(s)))


@query("sink_18", "SELECT session, high_water AS covered_event_end, 'snap2-' || session AS snapshot_id FROM marks WHERE high_water <> covered OR covered = 0")
def sink_18(spark, sf_dir):
    s = Store(spark, sf_dir)
    committed = s.marks.select("session", F.col("high_water").alias("covered_event_end"), F.concat(F.lit("snap2-"), "session").alias("snapshot_id"))
    return mutations.new_snapshots(s.snapshots, committed)


@query("sink_23", "SELECT * FROM (VALUES (1::BIGINT, 'APPLIED'), (2, 'CHANGED'), (3, 'PENDING'), (9, 'UNKNOWN')) t(version, state)")
def sink_23(spark, sf_dir):
    schema = "version long, checksum string"
    return mutations.pending_migrations(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema), spark.createDataFrame([(1, "a"), (2, "x"), (9, "z")], schema))


@query("sink_26", "SELECT event_id, content FROM journal")
def sink_26(spark, sf_dir):
    """The journal's contents under a new key, read back with it."""
    old, new = (F.unhex(F.sha2(F.lit(k), 256)) for k in ("old key", "new key"))
    iv = F.unhex(F.substring(F.sha2("event_id", 256), 1, 24))
    cells = Store(spark, sf_dir).journal.select("event_id", mutations.encrypt(F.col("content"), "journal", "content", F.col("event_id"), old, iv).alias("content"))
    moved = mutations.rekey(cells, "journal", "content", "event_id", old, new)
    return moved.select("event_id", mutations.decrypt(F.col("content"), "journal", "content", F.col("event_id"), new).alias("content"))


def _solved(spark, sf_dir, how):
    """(session, backend, status, position, x): each session's unconstrained system whose solution is 1, 2, 3, ..., by one solver."""
    blocks = retrieval.session_blocks(Store(spark, sf_dir), QUERY)
    entries = graph.propagation_entries(joins.relations(blocks), blocks)
    sizes = blocks.groupBy("session").agg(F.count("*").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        n, session = table["n"][0].as_py(), table["session"][0].as_py()
        a = solvers.Sparse(n, *(table[c].to_numpy() for c in ("row", "col", "value")))
        backend, got = how(session, a, a @ np.arange(1.0, n + 1))
        x = [None] * n if got.x is None else np.round(got.x, 4).tolist()
        return pa.table({"session": pa.array([session] * n, pa.int64()), "backend": [backend] * n, "status": [got.status] * n, "position": pa.array(range(n), pa.int64()), "x": pa.array(x, pa.float64())})

    return entries.join(sizes, "session").groupBy("session").applyInArrow(run, "session long, backend string, status string, position long, x double")


def _known(backend: str) -> str:
    return BLOCKS + f"SELECT session, {backend} AS backend, 'CONVERGED' AS status, position, (position + 1)::DOUBLE AS x FROM ordered"


@query("graph_10", BLOCKS + ", sized AS (SELECT *, count(*) OVER (PARTITION BY session) <= 64 AS small FROM ordered) SELECT session, 'elimination' AS backend, CASE WHEN small THEN 'CONVERGED' ELSE 'BACKEND_CAPACITY_EXCEEDED' END AS status, position, CASE WHEN small THEN (position + 1)::DOUBLE END AS x FROM sized")
def graph_10(spark, sf_dir):
    return _solved(spark, sf_dir, lambda session, a, b: ("elimination", solvers.elimination(a.dense(), b)))


@query("graph_11", _known("'dense'"))
def graph_11(spark, sf_dir):
    return _solved(spark, sf_dir, lambda session, a, b: ("dense", graph.dense_solve(a.dense(), b, graph.Limits())))


@query("graph_12", _known("CASE WHEN session % 2 = 0 THEN 'gmres' ELSE 'lu' END"))
def graph_12(spark, sf_dir):
    """Sparse systems by factors and by iteration."""
    return _solved(spark, sf_dir, lambda session, a, b: ("gmres", solvers.gmres(a, b, goal=1e-11)) if session % 2 == 0 else ("lu", solvers.sparse_lu(a, b)))


@query("graph_13", _known("CASE WHEN session % 2 = 0 THEN 'sparse' ELSE 'dense' END"))
def graph_13(spark, sf_dir):
    """The backend that is chosen: sparse where it is preferred."""
    return _solved(spark, sf_dir, lambda session, a, b: (solvers.choose(a.n, len(a.value), session % 2 == 0), solvers.solve(a, b, session % 2 == 0)))

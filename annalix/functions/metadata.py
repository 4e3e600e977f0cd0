"""Bounded, deterministic metadata of tool events, and what can be told from it.

Arguments are arbitrary nested JSON, which no built-in function can walk; these are Arrow functions.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.windows import _lossy, fingerprint

#: Bounds of what is kept.
DEPTH, ITEMS, CHARACTERS, BYTES = 4, 16, 512, 4096


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def cut_text(text: str) -> object:
    return text if len(text) <= CHARACTERS else {"text": text[:CHARACTERS], "truncated": True, "characters": len(text)}


def bounded(value: object, depth: int = 0) -> object:
    """The value with long texts, long collections and deep levels replaced by notes of what was left out."""
    if isinstance(value, str):
        return cut_text(value)
    if isinstance(value, float) and not math.isfinite(value):
        return {"type": "non_finite_float"}
    if not isinstance(value, dict | list):
        return value
    if depth >= DEPTH:
        return {"type": f"builtins.{type(value).__name__}", "truncated": True}
    more = len(value) - ITEMS
    if isinstance(value, list):
        kept = [bounded(v, depth + 1) for v in value[:ITEMS]]
        return [*kept, {"truncated_items": more}] if more > 0 else kept
    kept = {k: bounded(value[k], depth + 1) for k in sorted(value)[:ITEMS]}
    return kept | {"$truncated_items": more} if more > 0 else kept


def tool_metadata(kind: str, tool: str, arguments: object, result: object = None, most: int = BYTES) -> str:
    payload = {"arguments": bounded(arguments), "kind": kind, "tool": cut_text(tool)}
    if kind == "result":
        payload["result"] = bounded(result)
    text = canonical(payload)
    size = len(text.encode())
    return text if size <= most else canonical({"kind": kind, "truncated": True, "utf8_bytes": size})


@F.pandas_udf(T.StringType())
def canonical_value(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bounded canonical JSON of a JSON text; null for what isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return canonical(bounded(json.loads(text)))
        except (TypeError, ValueError):
            return None

    for t in texts:
        yield t.map(one, na_action=None)


@F.pandas_udf(T.StringType())
def call_metadata(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Metadata of a call of (tool, arguments as JSON)."""
    for tool, arguments in parts:
        yield pd.Series([tool_metadata("call", t, json.loads(a)) for t, a in zip(tool, arguments)], dtype=object)


@F.pandas_udf(T.BooleanType())
def lossy_marker(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a JSON text says, at any depth, that something was left out."""
    for t in texts:
        yield t.map(lambda x: _lossy(json.loads(x)))


@F.pandas_udf(T.StructType([T.StructField("tool", T.StringType()), T.StructField("arguments", T.StringType())]))
def tool_fingerprint(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(tool, canonical arguments) of (event type, content); nulls if they can't be told."""
    for kind, content in parts:
        got = [(fingerprint(k, c) if k in ("TOOL_CALL", "TOOL_RESULT") else None) or (None, None) for k, c in zip(kind, content)]
        yield pd.DataFrame(got, columns=["tool", "arguments"])


def tool_name(content: Column) -> Column:
    return F.get_json_object(content, "$.tool")


def mergeable_ranks(spark: SparkSession, path: str, size: int, sha256: str) -> DataFrame:
    """(token, rank) of a rank file of ``base64 rank`` lines whose size and digest must be those expected."""
    rows = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("digest")).first()
    if rows is None or rows["length"] != size or rows["digest"] != sha256:
        raise ValueError("TOKENIZER_ASSET_INVALID")
    parts = F.split("value", " ")
    return spark.read.text(path).select(F.unbase64(parts[0]).alias("token"), parts[1].cast("long").alias("rank"))


def invalid_ranks(ranks: DataFrame) -> DataFrame:
    """Rows that make a rank file unusable: empty, repeated or negative."""
    from pyspark.sql import Window

    n = lambda c: F.count("*").over(Window.partitionBy(c))
    checked = ranks.withColumns({"tokens": n("token"), "ranks": n("rank")})
    return checked.filter("token IS NULL OR length(token) = 0 OR rank IS NULL OR rank < 0 OR tokens > 1 OR ranks > 1")


def file_facts(path: str) -> tuple[int, str]:
    with open(path, "rb") as f:
        data = f.read()
    return len(data), hashlib.sha256(data).hexdigest()


def rank_line(token: bytes, rank: int) -> str:
    return f"{base64.b64encode(token).decode()} {rank}"


class Recent(OrderedDict):
    """A driver-side map that forgets what was used longest ago."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def put(self, key, value) -> None:
        self[key] = value
        self.move_to_end(key)
        while len(self) > self.most:
            self.popitem(last=False)

    def use(self, key, default=None):
        if key in self:
            self.move_to_end(key)
        return self.get(key, default)

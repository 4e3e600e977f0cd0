"""Scalar functions on columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: White space as Python's str.split() sees it.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Context limit when none is known, and the multiplier denominator.
SAFE_LIMIT = 128_000
BASIS = 10_000


def utf8_bytes(text: str | Column) -> Column:
    return F.octet_length(text).cast("long")


def normalised(text: Column, most: int = 2048) -> Column:
    """First ``most`` characters, lower case, runs of space as one, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.substring(text, 1, most)), SPACE + "+", " "))


@F.pandas_udf(T.StringType())
def casefold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Full Unicode case folding, which differs from lower case."""
    for t in texts:
        yield t.str.casefold()


def character_set(text: Column) -> Column:
    """Distinct letters and digits of the lower-cased text. Others go in one replacement; an empty rest has none."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), ""), lambda c: c != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")) if most > 1 else F.substring(text, 1, 1))


def bounded(text: Column, most: int = 512) -> Column:
    """The text, or a struct as JSON that says it was cut."""
    cut = F.to_json(F.struct(F.lit(True).alias("$truncated"), F.substring(text, 1, most).alias("text")))
    return F.when(F.length(text) > most, cut).otherwise(text)


def model_identity(name: Column, most: int = 256) -> Column:
    """Trimmed model name; null if empty, too long or with inner space or control characters."""
    t = F.regexp_replace(name, rf"^{SPACE}+|{SPACE}+$", "")
    return F.when((F.length(t) >= 1) & (F.length(t) <= most) & ~t.rlike(r"(?U)[\s\p{C}]"), t)


def snapshot_suffix(ident: Column) -> Column:
    tail = F.right(ident, F.lit(12))
    return F.when(tail.rlike("^[0-9a-f]{12}$"), tail).otherwise("REDACTED")


def unfenced(raw: Column) -> Column:
    """The inside of a Markdown code fence, or the trimmed text."""
    inner = F.regexp_extract(F.btrim(raw), r"(?s)^```[A-Za-z]*\s*\n(.*)\n```$", 1)
    return F.when(inner != "", inner).otherwise(F.btrim(raw))


def session_key_json(platform, message_type, session, group, user, conversation, persona) -> Column:
    """Compact JSON of the seven fields in order, nulls shown."""
    names = ("platform_instance_id", "message_type", "session_id", "group_id", "user_id", "conversation_id", "persona_id")
    values = (platform, message_type, session, group, user, conversation, persona)
    return F.to_json(F.struct(*[v.cast("string").alias(n) for n, v in zip(names, values)]), {"ignoreNullFields": "false"})


def stable_id(prefix: str, *parts: Column, digits: int = 64) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits))


def payload_id(prefix: str, **fields: Column) -> Column:
    """Prefix and SHA-256 of the compact JSON of the fields, by name."""
    made = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix + ":"), F.sha2(made, 256))


def strict_json(text: Column) -> Column:
    """True for JSON without repeated keys and without numbers that JSON lacks."""
    quoted = F.regexp_replace(text, r'"(?:[^"\\\\]|\\\\.)*+"', '""')  # names of numbers inside texts don't count
    return F.try_parse_json(text).isNotNull() & ~quoted.rlike("NaN|Infinity|INF")


def pressure(trusted: Column, estimated: Column, current: Column, limit: int, reserved: int, compact: float, project: float) -> dict[str, Column]:
    capacity = limit - reserved
    known = trusted.isNotNull() & (trusted > 0)
    used = F.when(known, trusted + current).otherwise(estimated)
    at = lambda ratio: F.ceil(F.lit(float(capacity)) * F.lit(float(ratio)))  # noqa: E731  doubles, not decimals
    return {
        "used": used, "capacity": F.lit(capacity).cast("long"), "compact_at": at(compact), "project_at": at(project), "should_compact": used >= at(compact), "should_project": used >= at(project),
        "source": F.when(known, "TRUSTED_PROVIDER_USAGE").otherwise("CONSERVATIVE_ESTIMATE"),
    }


def multiplied(n: Column, basis_points: int) -> Column:
    return F.floor((n * basis_points + (BASIS - 1)) / BASIS)


def backoff(attempt: Column, base: int, most: int) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2), attempt - 1), F.lit(float(most))).cast("long")


def context_limit(configured: Column, provider: Column, request_model: Column, provider_model: Column) -> dict[str, Column]:
    """A configured limit wins; else the provider's, at most the safe one if the models differ."""
    request, own = model_identity(request_model), model_identity(provider_model)
    differ = request.isNotNull() & ~request.eqNullSafe(own)
    bad, manual, none = configured.isNull() | (configured < 0), configured > 0, provider.isNull() | (provider < 1)
    limit = F.when(bad, SAFE_LIMIT).when(manual, configured).when(none, SAFE_LIMIT).when(differ, F.least(provider, F.lit(SAFE_LIMIT))).otherwise(provider)
    source = F.when(bad, "AUTO_SAFE_FALLBACK").when(manual, "MANUAL").when(none | differ, "AUTO_SAFE_FALLBACK").otherwise("AUTO_HOST")
    code = F.when(bad, "CONTEXT_LIMIT_CONFIG_INVALID").when(manual, "NONE").when(none | differ, "CONTEXT_LIMIT_UNAVAILABLE").otherwise("NONE")
    return {"limit": limit.cast("long"), "limit_source": source, "limit_code": code}


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def content_texts(parts: Column) -> Column:
    """Texts of content parts (struct of type, text, url), in order."""
    return F.filter(F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"].isin("image_url", "audio_url"), p["url"])), lambda t: t.isNotNull() & (t != ""))

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import packing, retrieval
from ..sources import Store, read
from .registry import query

_QUERY = "  The ou\tand  thnt "


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


@query("str_01", "SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents")
@query("tok_01", "SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents")
def str_01(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.utf8_bytes("text").alias("bytes"))


@query("str_02", r"SELECT doc_id, trim(regexp_replace(lower(left(text, 2048)), '[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ') AS normalised FROM documents")
def str_02(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.normalised(F.col("text")).alias("normalised"))


_FRACTION = "CASE WHEN contains(lower(left(text, 4096)), 'the ou and thnt') THEN 1.0 ELSE ((contains(lower(left(text, 4096)), 'the'))::INT + (contains(lower(left(text, 4096)), 'ou'))::INT + (contains(lower(left(text, 4096)), 'and'))::INT + (contains(lower(left(text, 4096)), 'thnt'))::INT) / 4.0::DOUBLE END::DOUBLE"


@query("str_03", f"SELECT doc_id, {_FRACTION} AS fraction FROM documents")
def str_03(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", retrieval.lexical_fraction(_QUERY, F.col("text")).alias("fraction"))


@query("str_04", f"SELECT doc_id, 40.0 + 10.0 * {_FRACTION} AS score, CASE WHEN {_FRACTION} > 0 THEN 'LEXICAL_MATCH' ELSE 'STRUCTURED_FALLBACK' END AS reason FROM documents")
def str_04(spark, sf_dir):
    f = retrieval.lexical_fraction(_QUERY, F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", (F.lit(40.0) + F.lit(10.0) * f).alias("score"), F.when(f > 0, "LEXICAL_MATCH").otherwise("STRUCTURED_FALLBACK").alias("reason"))


_SET = r"list_distinct(list_filter(string_split(lower(text), ''), lambda c: regexp_full_match(c, '[\p{L}\p{N}]')))"


@query("str_05", f"SELECT doc_id, round(len(list_intersect(s, q))::DOUBLE / len(list_distinct(s || q)), 9) AS score FROM (SELECT doc_id, {_SET} AS s, ['t','h','e','q','z','1'] AS q FROM documents)")
@query("set_03", f"SELECT doc_id, round(len(list_intersect(s, q))::DOUBLE / len(list_distinct(s || q)), 9) AS score FROM (SELECT doc_id, {_SET} AS s, ['t','h','e','q','z','1'] AS q FROM documents)")
def str_05(spark, sf_dir):
    q = F.array(*map(F.lit, "theqz1"))
    return _docs(spark, sf_dir).select("doc_id", F.round(S.jaccard(S.character_set(F.col("text")), q), 9).alias("score"))


@query("str_06", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE left(text, 499) || '…' END AS short FROM documents")
def str_06(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.truncated(F.col("text"), 500).alias("short"))


@query("str_07", "SELECT doc_id, length(text) > 512 AS cut, strlen(left(text, 512))::BIGINT AS kept FROM documents")
def str_07(spark, sf_dir):
    t = S.bounded(F.col("text"))
    cut = F.length("text") > 512
    kept = F.when(cut, F.get_json_object(t, "$.text")).otherwise(t)
    return _docs(spark, sf_dir).select("doc_id", cut.alias("cut"), S.utf8_bytes(kept).alias("kept"))


@query("str_08", "SELECT page_id, CASE WHEN page_id % 3 = 1 THEN NULL ELSE 'model-' || page_id END AS identity FROM pages")
def str_08(spark, sf_dir):
    n = F.col("page_id")
    name = F.when(n % 3 == 1, F.concat(F.lit("model "), n)).otherwise(F.concat(F.lit(" \tmodel-"), n, F.lit("\n")))
    return read(spark, sf_dir, "pages").select("page_id", S.model_identity(name).alias("identity"))


@query("str_09", "SELECT session, string_agg(content, chr(10) || chr(10) ORDER BY sequence) AS projection FROM journal GROUP BY session")
def str_09(spark, sf_dir):
    rows = Store(spark, sf_dir).journal.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("sequence", "content"))).alias("e"))
    return rows.select("session", F.array_join(F.transform("e", lambda x: x["content"]), "\n\n").alias("projection"))


@query("str_10", "SELECT doc_id, CASE WHEN regexp_full_match(tail, '[0-9a-f]{12}') THEN tail ELSE 'REDACTED' END AS suffix FROM (SELECT doc_id, right(CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE upper(sha256(text)) END, 12) AS tail FROM documents)")
def str_10(spark, sf_dir):
    digest = F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise(F.upper(F.sha2("text", 256)))
    return _docs(spark, sf_dir).select("doc_id", S.snapshot_suffix(digest).alias("suffix"))


@query("str_11", "SELECT conv_id, turn, trim(text) AS inner_text FROM conversations")
def str_11(spark, sf_dir):
    fenced = F.concat(F.lit(" ```json\n"), F.btrim("text"), F.lit("\n``` "))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", S.unfenced(fenced).alias("inner_text"))


@query("str_12", "SELECT session, arg_max(right(content, 512), sequence) AS anchor FROM journal GROUP BY session")
def str_12(spark, sf_dir):
    return Store(spark, sf_dir).journal.groupBy("session").agg(F.max_by(F.right("content", F.lit(512)), "sequence").alias("anchor"))


_KEY = """'{"platform_instance_id":"local","message_type":"friend_message","session_id":"' || session || '","group_id":null,"user_id":"u' || session % 17 || '","conversation_id":"' || session || '","persona_id":null}'"""


@query("json_01", f"SELECT session, {_KEY} AS key_json, sha256({_KEY}) AS key_hash FROM marks")
def json_01(spark, sf_dir):
    n, null = F.col("session"), F.lit(None)
    key = S.session_key_json(F.lit("local"), F.lit("friend_message"), n, null, F.concat(F.lit("u"), n % 17), n, null)
    return Store(spark, sf_dir).marks.select("session", key.alias("key_json"), F.sha2(key, 256).alias("key_hash"))


@query("json_02", """SELECT event_id, '{"a":' || (props->>'k') || ',"b":"' || event_type || '","z":null}' AS canonical FROM events""")
def json_02(spark, sf_dir):
    value = F.struct(F.get_json_object("props", "$.k").cast("long").alias("a"), F.col("event_type").alias("b"), F.lit(None).cast("string").alias("z"))
    return read(spark, sf_dir, "events").select("event_id", F.to_json(value, {"ignoreNullFields": "false"}).alias("canonical"))


@query("json_03", "SELECT event_id, event_id % 4 = 3 AS strict FROM events")
def json_03(spark, sf_dir):
    n = F.col("event_id") % 4
    text = F.when(n == 0, F.lit('{"k":1,"k":2}')).when(n == 1, F.lit('{"k":{"j":[1,NaN]}}')).when(n == 2, F.lit('{"k":-Infinity}')).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", S.strict_json(text).alias("strict"))


@query("json_06", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS tool FROM events")
def json_06(spark, sf_dir):
    content = F.when(F.col("event_id") % 4 != 0, F.to_json(F.struct(F.lit("call").alias("kind"), F.col("event_type").alias("tool")))).otherwise("not json")
    parsed = F.when(F.get_json_object(content, "$.kind") == "call", F.get_json_object(content, "$.tool"))
    return read(spark, sf_dir, "events").select("event_id", F.when(parsed != "", parsed).alias("tool"))


@query("json_09", "SELECT event_id, 'evt:' || sha256(session || chr(0) || source_hook || chr(0) || sequence) AS stable FROM journal")
def json_09(spark, sf_dir):
    parts = [F.col(c).cast("string") for c in ("session", "source_hook", "sequence")]
    return Store(spark, sf_dir).journal.select("event_id", S.stable_id("evt:", *parts).alias("stable"))


@query("json_10", """SELECT item_id, 'item:' || sha256('{"kind":"' || kind || '","name":"' || item_id || '","session":' || session || ',"sources":["' || source || '"]}') AS item,
 'capsule:' || sha256('{"base":null,"ordinal":' || segment || ',"session":' || session || '}') AS capsule FROM items""")
def json_10(spark, sf_dir):
    """Ids of items and capsules from canonical JSON of what identifies them, nulls shown."""
    c = F.col
    item = S.payload_id("item", session=c("session"), kind=c("kind"), name=c("item_id"), sources=F.array("source"))
    capsule = S.payload_id("capsule", session=c("session"), ordinal=c("segment"), base=F.lit(None).cast("string"))
    return Store(spark, sf_dir).items.select("item_id", item.alias("item"), capsule.alias("capsule"))


@query("json_11", "SELECT event_id, json_valid(props) AS valid, (props->>'k')::BIGINT AS k FROM events")
def json_11(spark, sf_dir):
    v = F.try_parse_json("props")
    return read(spark, sf_dir, "events").select("event_id", v.isNotNull().alias("valid"), F.variant_get(v, "$.k", "long").alias("k"))


_USED = "CASE WHEN session % 2 = 0 THEN total + 1 ELSE total END"


@query("math_01", f"SELECT session, {_USED} AS used, 7000::BIGINT AS capacity, ceil(7000 * 0.56::DOUBLE)::BIGINT AS compact_at, ceil(7000 * 0.80::DOUBLE)::BIGINT AS project_at, {_USED} >= ceil(7000 * 0.56::DOUBLE) AS should_compact, {_USED} >= ceil(7000 * 0.80::DOUBLE) AS should_project, CASE WHEN session % 2 = 0 THEN 'TRUSTED_PROVIDER_USAGE' ELSE 'CONSERVATIVE_ESTIMATE' END AS source FROM (SELECT session, sum(token_count)::BIGINT AS total FROM journal GROUP BY session)")
def math_01(spark, sf_dir):
    total = Store(spark, sf_dir).journal.groupBy("session").agg(F.sum("token_count").alias("total"))
    got = S.pressure(F.when(F.col("session") % 2 == 0, F.col("total")), F.col("total"), F.lit(1), 8000, 1000, 0.56, 0.80)
    return total.select("session", *[c.alias(k) for k, c in got.items()])


@query("math_02", "SELECT event_id, (token_count * 11000 + 9999) // 10000 AS scaled FROM journal")
def math_02(spark, sf_dir):
    return Store(spark, sf_dir).journal.select("event_id", S.multiplied(F.col("token_count"), 11_000).alias("scaled"))


@query("math_03", "SELECT session, least(9000, 8500, 10000 - total) AS b_input, (50 + 10 + 5)::BIGINT AS b_required, greatest(0, least(9000, 8500, 10000 - total) - 100 - 65) AS b_ac FROM (SELECT session, sum(token_count)::BIGINT AS total FROM journal GROUP BY session)")
def math_03(spark, sf_dir):
    total = Store(spark, sf_dir).journal.groupBy("session").agg(F.sum("token_count").alias("total"))
    got = packing.budget_columns(packing.Budget(9000, 8500, 10000, 0, 5), F.lit(50), F.lit(100), F.lit(10), reserved=F.col("total"))
    return total.select("session", *[c.alias(k) for k, c in got.items()])


@query("math_04", "SELECT job_id, least(30 * pow(2, attempt_count), 90)::BIGINT AS wait FROM jobs")
def math_04(spark, sf_dir):
    return Store(spark, sf_dir).jobs.select("job_id", S.backoff(F.col("attempt_count") + 1, 30, 90).alias("wait"))


@query("math_05", "SELECT session, coalesce(count(*) FILTER (WHERE kind = 'anchor')::DOUBLE / nullif(count(*) FILTER (WHERE kind = 'entity'), 0), 1.0) AS ratio FROM items GROUP BY session")
def math_05(spark, sf_dir):
    from ..operators.aggregates import safe_ratio

    n = lambda k: F.count_if(F.col("kind") == k)
    return Store(spark, sf_dir).items.groupBy("session").agg(safe_ratio(n("anchor"), n("entity"), 1.0).alias("ratio"))


@query("math_06", """SELECT job_id, CASE session % 4 WHEN 0 THEN 128000 WHEN 1 THEN 64000 WHEN 2 THEN 200000 ELSE 128000 END::BIGINT AS "limit",
 CASE session % 4 WHEN 1 THEN 'MANUAL' WHEN 2 THEN 'AUTO_HOST' ELSE 'AUTO_SAFE_FALLBACK' END AS limit_source, CASE session % 4 WHEN 0 THEN 'CONTEXT_LIMIT_CONFIG_INVALID' WHEN 3 THEN 'CONTEXT_LIMIT_UNAVAILABLE' ELSE 'NONE' END AS limit_code FROM jobs""")
def math_06(spark, sf_dir):
    k = F.col("session") % 4
    got = S.context_limit(F.when(k == 0, -1).when(k == 1, 64000).otherwise(0), F.lit(200000), F.lit("m1"), F.when(k == 3, "m2").otherwise("m1"))
    return Store(spark, sf_dir).jobs.select("job_id", *[c.alias(n) for n, c in got.items()])


@query("math_07", "SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'profile-a' WHEN 1 THEN 'profile-b' ELSE 'reference' END AS profile, CASE conv_id % 3 WHEN 2 THEN 'TOKENIZER_MODEL_UNKNOWN' ELSE 'NONE' END AS code FROM (SELECT DISTINCT conv_id FROM conversations)")
def math_07(spark, sf_dir):
    routes = F.broadcast(spark.createDataFrame([("model-0", "profile-a"), ("model-1", "profile-b")], "model string, profile string"))
    models = read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("model", S.model_identity(F.concat(F.lit("model-"), F.col("conv_id") % 3)))
    return models.join(routes, "model", "left").select("conv_id", F.coalesce("profile", F.lit("reference")).alias("profile"), F.when(F.col("profile").isNull(), "TOKENIZER_MODEL_UNKNOWN").otherwise("NONE").alias("code"))


@query("date_01", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, true AS round_trip FROM events")
def date_01(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    iso = S.iso_utc(ts)
    return read(spark, sf_dir, "events").select("event_id", iso.alias("iso"), (F.to_timestamp(iso) == ts).alias("round_trip"))


@query("date_02", "SELECT event_id, strftime(to_timestamp(epoch(ts)::BIGINT)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def date_02(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", S.iso_utc(F.timestamp_seconds(seconds)).alias("iso"))


@query("date_03", "SELECT job_id, lease_expires_at <= '2026-01-02T00:00:00.000000Z' AS expired, next_retry_at <= '2026-01-02T00:00:00.000000Z' AS due FROM jobs")
def date_03(spark, sf_dir):
    now = "2026-01-02T00:00:00.000000Z"
    return Store(spark, sf_dir).jobs.select("job_id", (F.col("lease_expires_at") <= now).alias("expired"), (F.col("next_retry_at") <= now).alias("due"))


@query("arr_01", "SELECT session, string_agg(source, ',' ORDER BY source) FILTER (WHERE n <= 2) AS firsts, count(*) AS n FROM (SELECT session, source, row_number() OVER (PARTITION BY session ORDER BY source) AS n FROM (SELECT DISTINCT session, source FROM items)) GROUP BY session")
def arr_01(spark, sf_dir):
    ids = Store(spark, sf_dir).items.groupBy("session").agg(F.array_sort(F.array_distinct(F.collect_list("source"))).alias("s"))
    return ids.select("session", F.array_join(F.slice("s", 1, 2), ",").alias("firsts"), F.size("s").cast("long").alias("n"))


@query("arr_02", "SELECT event_id, content || '|' || 'http://x/' || sequence AS texts FROM journal")
def arr_02(spark, sf_dir):
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), url.cast("string").alias("url"))
    null = F.lit(None)
    parts = F.array(part("text", F.col("content"), null), part("image_url", null, F.concat(F.lit("http://x/"), "sequence")), part("other", F.lit("no"), null))
    return Store(spark, sf_dir).journal.select("event_id", F.array_join(S.content_texts(parts), "|").alias("texts"))


@query("arr_03", "SELECT event_id, content || chr(10) || 'why' AS normalised, sequence % 5 <> 0 AS accepted FROM journal WHERE event_type = 'ASSISTANT_MESSAGE'")
def arr_03(spark, sf_dir):
    part = lambda kind, text: F.struct(kind.alias("type"), text.alias("text"))
    odd = F.when(F.col("sequence") % 5 == 0, "blob").otherwise("text")
    parts = F.array(part(odd, F.col("content")), part(F.lit("reasoning"), F.lit("why")))
    rows = Store(spark, sf_dir).journal.filter("event_type = 'ASSISTANT_MESSAGE'").withColumn("parts", parts)
    known = F.forall("parts", lambda p: p["type"].isin("text", "reasoning"))
    return rows.select("event_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("normalised"), known.alias("accepted"))


@query("set_02", "SELECT a.item_id AS a, b.item_id AS b FROM items a JOIN items b ON a.session = b.session AND a.source = b.source AND a.item_id < b.item_id")
def set_02(spark, sf_dir):
    """Items that share a source, which is the join's key: an event has a handful of items, however long its session."""
    items = Store(spark, sf_dir).items.select("session", "item_id", F.explode(F.array("source")).alias("source"))
    pairs = items.alias("a").join(items.alias("b"), ["session", "source"]).filter(F.col("a.item_id") < F.col("b.item_id"))
    return pairs.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")).distinct()


@query("set_04", "SELECT session, count(*) FILTER (WHERE sequence % 3 = 0) = 0 AS complete FROM covered GROUP BY session")
def set_04(spark, sf_dir):
    covered = Store(spark, sf_dir).covered
    left = covered.join(covered.filter("sequence % 3 <> 0").select("event_id"), "event_id", "left_anti").groupBy("session").agg(F.count("*").alias("missing"))
    return covered.select("session").distinct().join(left, "session", "left").select("session", F.col("missing").isNull().alias("complete"))


@query("set_05", "SELECT m.session, x AS sequence FROM marks m, (SELECT unnest(range(1, 1000)) AS x) WHERE x > covered AND x <= high_water AND x % 3 = 0")
def set_05(spark, sf_dir):
    s = Store(spark, sf_dir)
    expected = s.marks.filter("high_water > covered").select("session", F.explode(F.sequence(F.col("covered") + 1, "high_water")).alias("sequence"))
    return expected.join(s.journal.filter("sequence % 3 <> 0").select("session", "sequence"), ["session", "sequence"], "left_anti")


@query("set_06", "SELECT session, capsule_id, segment AS ordinal FROM capsules UNION ALL SELECT session, 'new-' || session, count(*) FROM capsules GROUP BY session")
def set_06(spark, sf_dir):
    capsules = Store(spark, sf_dir).capsules
    base = capsules.select("session", "capsule_id", F.col("segment").alias("ordinal"))
    new = capsules.groupBy("session").agg(F.count("*").alias("ordinal")).select("session", F.concat(F.lit("new-"), "session").alias("capsule_id"), "ordinal")
    return base.unionByName(new)


@query("tok_02", "SELECT 'id-' || session % 5 AS request_id, count(DISTINCT content) > 1 AS conflict FROM journal GROUP BY 1")
def tok_02(spark, sf_dir):
    rows = Store(spark, sf_dir).journal.withColumn("request_id", F.concat(F.lit("id-"), F.col("session") % 5))
    return rows.groupBy("request_id").agg((F.count_distinct(F.sha2("content", 256)) > 1).alias("conflict"))


@query("tok_03", "SELECT session, sum((token_count * 11000 + 9999) // 10000)::BIGINT AS cost FROM journal GROUP BY session")
def tok_03(spark, sf_dir):
    return Store(spark, sf_dir).journal.groupBy("session").agg(F.sum(S.multiplied(F.col("token_count"), 11_000)).alias("cost"))


@query("tok_04", "SELECT session, CASE WHEN bool_or(sequence % 7 = 0) THEN sum(token_count) ELSE sum((token_count + 3) // 4) END::BIGINT AS cost FROM journal GROUP BY session")
def tok_04(spark, sf_dir):
    """All or nothing: one failed count and the whole request is counted in bytes."""
    n = F.when(F.col("sequence") % 7 != 0, F.floor((F.col("token_count") + 3) / 4))
    return Store(spark, sf_dir).journal.groupBy("session").agg(F.when(F.bool_or(n.isNull()), F.sum("token_count")).otherwise(F.sum(n)).alias("cost"))

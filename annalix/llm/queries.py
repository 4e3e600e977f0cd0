"""The operators on their tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, decontaminate, filter_audit, jaccard_join, language_id, line_dedup, mixing, packing, pii, quality_rules, token_counts, toxicity, url_filter
from ._shared import held_out, scratch, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~held_out())
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, after an earlier run over a half of the texts: what that stored comes from the cache, the rest is encoded."""
    docs, cache = table(spark, sf_dir, "documents"), scratch(spark, "token-cache")
    token_counts.store_counts(docs.filter(F.xxhash64("text") < 0), tokenizer_path(), cache)
    return token_counts.count_tokens(docs, tokenizer_path(), cache)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.LineStore(spark, scratch(spark, "lines")).insert(docs).report(docs)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.HOST_RULES + url_filter.PATTERNS)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = mixing.rates(mixing.cyclic_weights(mixing.source_sizes(docs), (1, 2, 3)))
    return mixing.taken(docs, rated).drop("copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_line_dedup, op4_packing, op5_url_filter, op6_jaccard_join, op7_pii, op8_decontamination, op9_toxicity, op10_quality_rules, op11_filter_audit, op12_collocations, op13_mixing)}


_OP3_SQL = r"""
WITH l AS (
  SELECT row, doc_id, pos, line, lower_key(line) AS k FROM (
    SELECT row, doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
    FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY row, doc_id
"""


def _op3_sql() -> str:
    key = "translate(trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return _OP3_SQL.replace("lower_key(line)", key.format("line"))


def _op5_sql() -> str:
    rest = r"regexp_extract(url, '(?s)://(.*)', 1)"
    fits = {r.name: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in url_filter.HOST_RULES}
    order = sorted(url_filter.HOST_RULES, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    rule = "CASE " + " ".join(f"WHEN {fits[r.name]} THEN '{r.name}'" for r in order) + " END"
    told = "CASE " + " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in order)
    told += "".join(f" WHEN regexp_matches({p.part}, '{p.regex}') THEN 'block'" for p in url_filter.PATTERNS) + " ELSE 'allow' END"
    return f"""
WITH u AS (SELECT page_id, coalesce({rest}, '') AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '(?s)^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '(?s)^[^?#]*') AS path FROM h),
r AS (SELECT *, {rule} AS rule FROM p)
SELECT page_id, host, path, rule, {told} AS verdict FROM r
"""


_OP11_SQL = r"""
WITH letter AS (SELECT * FROM (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) AS v(l, b)),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT doc_id, part,
        (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
        + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask,
        coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
        coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM w),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m GROUP BY part, mask),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
      WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l),
s AS (SELECT filter_order, k AS step, b AS bit,
        (SELECT coalesce(sum(1 << y.b), 0) FROM letter y WHERE instr(left(filter_order, k - 1), y.l) > 0)::INT AS before
      FROM o, generate_series(1, 5) AS g(k), letter WHERE l = substr(filter_order, k, 1)),
r AS (SELECT part, filter_order, step, bit,
        sum(n) FILTER (WHERE mask & (before | (1 << bit)) = 0) AS kept, sum(n) FILTER (WHERE mask & (1 << bit) > 0 AND mask & before = 0) AS removed,
        sum(n) FILTER (WHERE mask & (1 << bit) > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (WHERE mask = 1 << bit) AS unique_fails,
        sum(g) FILTER (WHERE mask & (1 << bit) > 0 AND mask & before = 0) AS good_lost, sum(x) FILTER (WHERE mask & (1 << bit) > 0 AND mask & before = 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r
"""


_OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, k AS width, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
h AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(ws[:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < width),
cut AS (SELECT h.lang, h.phrase, a, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
        FROM h JOIN f l ON l.lang = h.lang AND l.phrase = h.head JOIN f r ON r.lang = h.lang AND r.phrase = h.tail),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < width AND i + m - 1 <= width),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY lang, phrase),
kept AS (SELECT low.* FROM low LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


_OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM s),
t AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_before,
             coalesce(sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before FROM w),
m AS (SELECT *, 3 * source_size::DOUBLE * (weights - w_before)::DOUBLE <= (total::DOUBLE - 3 * s_before::DOUBLE) * weight::DOUBLE AS capped FROM t),
f AS (SELECT max(total)::DOUBLE - 3 * coalesce(sum(source_size) FILTER (WHERE capped), 0)::DOUBLE AS rest, coalesce(sum(weight) FILTER (WHERE NOT capped), 0)::DOUBLE AS free FROM m),
r AS (SELECT source, source_size, CASE WHEN capped THEN 3 * source_size::DOUBLE WHEN free > 0 THEN least(3 * source_size::DOUBLE, rest * weight::DOUBLE / free) ELSE 0 END AS target FROM m, f),
k AS (SELECT d.doc_id, d.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN least(r.target / r.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
             ('0x' || left(md5('0:' || coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(d.source, '') || ':' || coalesce(md5(d.text), '')), 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": _OP11_SQL, "op12_collocations": _OP12_SQL, "op13_mixing": _OP13_SQL, "op3_line_dedup": _op3_sql(), "op5_url_filter": _op5_sql()}

"""Mixing sources to target weights, with DataFrame functions only.

Words are summed by source. A source's target is its share by weight of the target total, at most
``most`` times its own words; what is cut off goes to the others by weight, until none is above. That
is one level for all sources below their cap: sources become capped in the order of words over weight,
so running sums along that order (in range blocks, for any number of sources) give the level.
A source's rate is target over words. A document comes floor(rate) times, and once more with the
fraction as probability, drawn from a hash of its id, source and text: reruns agree.

Defined cases: a null or empty text has no words and is taken like others, with 0 words. A null source is
a source. Repeated rows draw alike. A source without words has target 0 and rate 0, as has every source if no
source has words or weight. A null id draws as the empty text. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import prefix
from ._shared import materialise

#: A word.
WORD = r"[^\x20\x09-\x0D]+"
#: Most times that a document comes.
MOST = 3
#: A table of rates is broadcast up to this size; beyond, documents are joined to it by source and a salt.
BROADCAST_BYTES = 32 << 20
#: Tasks over which the documents of one source are spread in that join.
SALTS = 64


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, source_size, source_bytes): partial sums by task, so a hot source is a row a task in the shuffle."""
    return docs.groupBy("source").agg(F.sum(n_words()).alias("source_size"), F.max(F.octet_length(F.col("source").cast("string"))).alias("source_bytes"))


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight``: the given ones in turn, along the sources by code point, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = prefix.running(sizes, [], order, {"rank": F.lit(1)})
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))).drop("rank")


def rates(sizes: DataFrame, most: float = MOST, total: Column | None = None) -> DataFrame:
    """(source, source_size, weight) with target and rate added; ``total``: words of the mix, by default all there are.

    Weights are summed as decimals of nine places and words as whole numbers, so no sum depends on the order of rows.
    """
    exact = sizes.withColumns({"_w": F.coalesce(F.col("weight"), F.lit(0)).cast("decimal(20,9)"), "_s": F.coalesce("source_size", F.lit(0))})
    along = [F.col("_s") / F.nullif(F.col("_w").cast("double"), F.lit(0.0)), F.col("source").isNull(), F.col("source")]
    live = exact.filter("_w > 0")
    summed = prefix.running(live, [], along, {"_s_to": F.col("_s"), "_w_to": F.col("_w")})
    weighs = F.col("_w") > 0
    totals = exact.agg(F.coalesce((total if total is not None else F.sum("_s")).cast("double"), F.lit(0.0)).alias("words"), F.coalesce(F.sum(F.when(weighs, F.col("_w"))), F.lit(0)).alias("weights")).first()
    words, weights = F.lit(totals.words), F.lit(totals.weights)
    cap = F.lit(float(most)) * F.col("_s").cast("double")
    before = F.lit(float(most)) * (F.col("_s_to") - F.col("_s")).cast("double")
    rest = (weights - (F.col("_w_to") - F.col("_w"))).cast("double")
    at_cap = cap * rest <= (words - before) * F.col("_w").cast("double")
    marked = materialise(summed.withColumn("_capped", at_cap), "mix-levels")
    end = marked.agg(F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_s"))), F.lit(0)).alias("capped"), F.coalesce(F.sum(F.when(~F.col("_capped"), F.col("_w"))), F.lit(0)).cast("double").alias("free")).first()
    left = totals.words - float(most) * end.capped
    level = F.when(F.col("_capped"), cap).otherwise(F.least(cap, F.lit(left) * F.col("_w").cast("double") / F.lit(end.free or 1.0)))
    good = marked.withColumn("target", level)
    none = exact.filter(~weighs).withColumn("target", F.lit(0.0))
    names = [*sizes.columns, "target"]
    out = good.select(*names).unionByName(none.select(*names))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))


def draw(doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 digest."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(source), F.lit("")), F.coalesce(F.md5(F.col(text)), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(seed: int = 0) -> Column:
    """How often a document comes, from its ``rate`` and its draw."""
    whole = F.floor("rate")
    return (whole + F.when(draw(seed=seed) < F.col("rate") - whole, 1).otherwise(0)).cast("long")


def with_rates(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """Documents with their source's columns of ``rated``, null sources too. A table of rates is broadcast if its measured size allows."""
    rated = materialise(rated, "mix-rates")
    n, size = rated.agg(F.count("*"), F.coalesce(F.sum(F.coalesce("source_bytes", F.lit(0)) + 64), F.lit(0))).first()
    side = rated.drop("source_bytes").withColumnRenamed("source", "_source")
    same = docs["source"].eqNullSafe(side["_source"])
    if size <= BROADCAST_BYTES:
        return docs.join(F.broadcast(side), same).drop("_source")
    dealt = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
    side = side.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(side, dealt["source"].eqNullSafe(side["_source"]) & (dealt["_salt"] == side["_to"])).drop("_source", "_salt", "_to")


def taken(docs: DataFrame, rated: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every document."""
    rows = with_rates(docs.select("doc_id", "source", "text"), rated.select("source", "source_bytes", "source_size", "target", "rate"))
    sized = rows.select("doc_id", n_words().alias("size"), "source_size", "target", copies(seed).alias("copies"))
    return sized.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, rated: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken."""
    names = docs.columns
    side = rated.select("source", "source_bytes", F.col("rate").alias("_rate"))
    rows = with_rates(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "source", "text"), side).withColumnRenamed("_rate", "rate")
    many = rows.select("_row", copies(seed).alias("_copies")).filter("_copies > 0")
    return many.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")

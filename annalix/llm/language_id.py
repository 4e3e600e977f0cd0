"""Language of whole texts: multinomial naive Bayes over hashed character n-grams.

Defined cases: a null text, or one without letters, is ``und`` with score 0. Without any labelled row
every text is ``und``. All languages of the labelled rows are learned; a table with so many values of
lang that the model would pass ``model_bytes`` is refused. Ties go to the language that sorts first. Repeated rows are predicted alike; other columns pass through
untouched, unless they are called lang_pred or score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ._shared import arrow_batches, share, tidy

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
PIECE = 1 << 19  # characters looked at together
_SPREAD, _SPACE = np.uint32(0x9E3779B1), np.array([32], np.uint32)
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Lower-cased code points. No cut stands beside a sigma, whose lower case depends on its neighbours."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and "Σ" in text[end - 1 : end + 1]:
            end += 1
        yield np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        at = end


def _add(counts: np.ndarray, tail: np.ndarray, new: np.ndarray) -> None:
    """Counts the n-grams that end in ``new``, which follows ``tail``."""
    x = np.concatenate([tail, new])
    grown = np.zeros(len(x), np.uint32)
    for n in range(1, min(max(ORDERS), len(x)) + 1):
        grown = (grown[: len(x) - n + 1] + x[n - 1 :]) * _SPREAD
        grown ^= grown >> np.uint32(15)
        if n in ORDERS:
            counts += np.bincount(grown[max(0, len(tail) - n + 1) :] % np.uint32(BUCKETS), minlength=BUCKETS)


def features(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, buckets, counts) of every text with letters: a sparse row of n-gram counts.

    Every run of other characters is one space, and a space stands before the first letter and behind the last. The last
    code points of a piece are carried over to the next, so no n-gram is lost between them.
    """
    letters = _letters()
    for row, text in enumerate(texts):
        total, tail, before = None, np.zeros(0, np.uint32), False
        for codes in _pieces(text or ""):
            known = letters[codes]
            keep = known.copy()
            keep[1:] |= known[:-1]
            keep[0] |= before
            before = bool(known[-1])
            new = np.where(known, codes, 32)[keep].astype(np.uint32)
            if not len(new):
                continue
            if total is None:
                total, tail = np.zeros(BUCKETS, np.int64), _SPACE[:0]
                new = np.concatenate([_SPACE, new])
            _add(total, tail, new)
            tail = np.concatenate([tail, new])[1 - max(ORDERS) :]
        if total is not None:
            if before:
                _add(total, tail, _SPACE)
            at = np.flatnonzero(total)
            yield row, at, total[at]


#: Log-probabilities gathered at a time in scoring.
GATHER = 1 << 18


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    log_prob: np.ndarray  # (BUCKETS, langs), float32: 64 KB a language
    prior: np.ndarray

    def joint(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(rows, langs): prior and likelihood of sparse rows of counts, as products with the rows of log_prob that they have."""
        out = np.empty((len(rows), len(self.langs)))
        size = np.cumsum([0, *(len(at) for at, _ in rows)])
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(size, size[i] + GATHER // len(self.langs), "right")) - 1)
            at, n = (np.concatenate(x) for x in zip(*rows[i:j]))
            out[i:j] = np.add.reduceat(self.log_prob[at] * n[:, None], size[i:j] - size[i], axis=0)
            i = j
        return out + self.prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        found = list(features(texts)) if self.langs else []
        if found:
            joint = self.joint([(at, n) for _, at, n in found])
            best = joint.argmax(1)
            share = 1.0 / np.exp(np.maximum(joint - joint.max(1, keepdims=True), -700)).sum(1)
            for (row, _, _), k, p in zip(found, best.tolist(), share.tolist()):
                names[row], scores[row] = self.langs[k], p
        return names, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sparse count vector a language and task."""
    totals: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column("lang").to_pylist()
        for row, at, n in features(b.column("text").to_pylist()):
            totals.setdefault(langs[row], np.zeros(BUCKETS, np.int64))[at] += n
    for lang, t in totals.items():
        at = np.flatnonzero(t)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(t[at], pa.int64())})


def fit(docs: DataFrame, usable: Column, per_lang: int = 1500, model_bytes: int = 512 << 20, alpha: float = 0.3) -> Model:
    """Learns from the rows that are ``usable`` and have a lang and a text.

    The sample is bounded: at most ``per_lang`` different texts of each language, those with the least hashes,
    however often each is repeated. Equal texts of a language count once; only the prior counts rows. The model
    has 4 * BUCKETS bytes a language, which is checked before any is learned.
    """
    arrow_batches(docs.sparkSession)
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = model_bytes // (4 * BUCKETS)
    sizes = known.groupBy("lang").count().limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"lang has more than {most} values, beyond model_bytes")
    if not sizes:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    hashed = known.select("lang", "text", F.xxhash64("text").alias("h"))
    least = Window.partitionBy("lang").orderBy("h")
    drawn = hashed.select("lang", "h").distinct().withColumn("k", F.row_number().over(least)).filter(F.col("k") <= per_lang)
    cuts = drawn.groupBy("lang").agg(F.max("h").alias("cut"))  # at most ``most`` rows
    sample = hashed.join(F.broadcast(cuts), "lang").filter("h <= cut").groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = sample.select("lang", "text").mapInArrow(tidy(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    rows = {r["lang"]: r["count"] for r in sizes}
    langs = tuple(sorted(got["lang"].unique()))
    counts, prior = np.full((BUCKETS, len(langs)), alpha), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        prior[k] = rows[lang]
        counts[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    if not langs:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    return Model(langs, np.log(counts / counts.sum(0)).astype(np.float32), np.log(prior / prior.sum()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and lang_pred and score (posterior, 0 to 1)."""
    arrow_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = share(docs.sparkSession, model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores)], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(tidy(run), schema)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with a posterior of ``least`` or more; columns as in docs."""
    arrow_batches(docs.sparkSession)
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column("text").to_pylist())
            yield b.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)

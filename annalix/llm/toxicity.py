"""Toxicity: a linear-chain conditional random field tags words, its marginals make document scores.

Words are runs of bytes other than ASCII space and punctuation, A-Z as a-z. A word's features are hashes
of itself, of its first four and five bytes, and of its neighbours; there are two states. Only documents
are labelled, so token labels come first: in toxic training documents a word counts as toxic if it, or
its beginning, is significantly more frequent in toxic than in clean training documents. The field is
fitted on those tags by gradient ascent, on pieces of ``CHAIN`` words, until its likelihood hardly gains.
A text is one chain: its marginals (forward-backward, where pieces of ``CHAIN`` words pass on their messages
and neighbours) give the largest and the expected number of toxic words, from which a logistic curve, fitted
on the same training documents, makes the score; words with a marginal of 0.5 or more are reported as spans.

Defined cases: a null or empty text has no words and gets the curve's value for none, under the
threshold. Without toxic or without clean training documents every score is 0. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import arrow_batches, share, steady_memory, tidy, trim
from ._text import as_bytes, word_hashes, words

CHAIN = 64
SIZE = 1 << 18
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = [not chr(c).isalnum() for c in range(128)]
PREFIXES = (4, 5)


def tokens(col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, starts, ends, row offsets); features has a bucket for the word and each prefix, one row a word."""
    data, offsets = as_bytes(col)
    starts, ends, rows = words(data, offsets, BETWEEN)
    cols = [word_hashes(data, starts, ends)]
    for n in PREFIXES:
        cut = np.minimum(ends, starts + n)
        cols.append(word_hashes(data, starts, cut) + np.uint64(n * 0x9E37))
    return (np.stack(cols, 1) % np.uint64(SIZE)).astype(np.int32), starts, ends, rows


def _chains(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the chains that the rows are cut into."""
    n = np.diff(rows)
    many = -(-n // CHAIN)
    first = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(n)), many)
    start = rows[row] + (np.arange(first[-1]) - first[row]) * CHAIN
    return start, np.minimum(CHAIN, rows[row + 1] - start)


@dataclass(frozen=True)
class Field:
    own: np.ndarray  # (SIZE,) log-odds of a word's features
    left: np.ndarray  # (SIZE,) of the word before
    right: np.ndarray  # (SIZE,) of the word after
    bias: float
    step: np.ndarray  # (2, 2)

    def odds(self, f: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray | bool = False, after: np.ndarray | bool = False) -> np.ndarray:
        """(chains, CHAIN), zero beyond the length. before, after: whether the chain's text has a word there."""
        out = np.zeros((len(start), CHAIN), np.float64)
        at = start[:, None] + np.arange(CHAIN)
        inside = np.arange(CHAIN) < length[:, None]
        out[inside] = self.own[f[at[inside]]].sum(1) + self.bias
        later = inside & ((np.arange(CHAIN) > 0) | np.reshape(before, (-1, 1)))
        out[later] += self.left[f[at[later] - 1, 0]]
        sooner = inside & ((np.arange(CHAIN) < length[:, None] - 1) | np.reshape(after, (-1, 1)))
        out[sooner] += self.right[f[at[sooner] + 1, 0]]
        return out

    @staticmethod
    def potentials(odds: np.ndarray) -> np.ndarray:
        psi = np.stack([np.ones_like(odds), np.exp(np.clip(odds, -30, 30))], 2)
        psi /= psi.sum(2, keepdims=True)
        return psi

    def messages(self, odds: np.ndarray, length: np.ndarray, ahead: np.ndarray | None = None, behind: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Potentials, and normalised forward and backward messages, (chains, CHAIN, 2) each.

        ahead, behind: the messages (chains, 2) that come into a chain from the one before and the one after.
        """
        psi = self.potentials(odds)
        t = np.exp(self.step)
        a, b = np.empty_like(psi), np.ones_like(psi)
        a[:, 0] = psi[:, 0]
        if ahead is not None:
            a[:, 0] *= ahead
            a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        b[:, CHAIN - 1] = behind
        for k in range(1, CHAIN):
            a[:, k] = (a[:, k - 1] @ t) * psi[:, k]
            a[:, k] /= a[:, k].sum(1, keepdims=True)
        for k in range(CHAIN - 2, -1, -1):
            m = (b[:, k + 1] * psi[:, k + 1]) @ t.T
            m /= m.sum(1, keepdims=True)
            b[:, k] = np.where((length > k + 1)[:, None], m, behind)
        return psi, a, b

    def transfer(self, odds: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(chains, 2, 2): what a chain makes of the message ahead of it, up to a factor; its transpose does so backward."""
        psi = self.potentials(odds)
        t = np.exp(self.step)
        out = np.eye(2) * psi[:, 0, None, :]
        for k in range(1, CHAIN):
            live = np.flatnonzero(length > k)
            if not len(live):
                break
            m = (out[live].reshape(-1, 2) @ t).reshape(-1, 2, 2) * psi[live, k, None, :]
            out[live] = m / m.sum((1, 2), keepdims=True)
        return out

    def between(self, many: np.ndarray, through: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Messages (chains, 2) that come into each chain from before and from after; many: chains of each row."""
        t = np.exp(self.step)
        first = np.cumsum(many) - many
        ahead, behind = np.ones((2, len(through), 2))
        steps, live = [], np.flatnonzero(many > 1)
        while len(live):  # the next chain of every row that has one
            at = first[live] + len(steps)
            steps.append(at)
            m = np.einsum("ci,cij->cj", ahead[at], through[at]) @ t
            ahead[at + 1] = m / m.sum(1, keepdims=True)
            live = live[many[live] > len(steps) + 1]
        for at in reversed(steps):
            m = np.einsum("cij,cj->ci", through[at + 1], behind[at + 1]) @ t.T
            behind[at] = m / m.sum(1, keepdims=True)
        return ahead, behind

    def marginals(self, f: np.ndarray, rows: np.ndarray, slice_: int = 2048) -> np.ndarray:
        """P(toxic) of every word, each row being one chain however long it is."""
        out = np.zeros(len(f))
        start, length = _chains(rows)
        many = -(-np.diff(rows) // CHAIN)
        before, after = ~np.isin(start, rows), ~np.isin(start + length, rows)
        slices = [slice(i, i + slice_) for i in range(0, len(start), slice_)]
        odds = [self.odds(f, start[i], length[i], before[i], after[i]) for i in slices]
        through = np.ones((len(start), 2, 2))
        for i, o in zip(slices, odds):
            part = np.flatnonzero(before[i] | after[i])
            if len(part):
                through[i.start + part] = self.transfer(o[part], length[i][part])
        ahead, behind = self.between(many, through)
        for i, o in zip(slices, odds):
            s, n = start[i], length[i]
            _, a, b = self.messages(o, n, ahead[i], behind[i])
            p = a * b
            inside = np.arange(CHAIN) < n[:, None]
            out[s[0] : s[-1] + n[-1]] = (p[:, :, 1] / p.sum(2))[inside]
        return out


def fit_field(f: np.ndarray, rows: np.ndarray, tags: np.ndarray, rounds: int = 40, rate: float = 0.3, l2: float = 2e-4, l2_near: float = 5e-3, slice_: int = 2048, most_chains: int = 40_000, seed: int = 3) -> Field:
    """Adam on the log-likelihood; chains without a toxic word are thinned to five times those with one.

    At most about ``most_chains`` chains take part, a third of them with a toxic word.

    Stops after two rounds in a row that lower the words' log loss by less than a hundredth.
    Neighbours' weights are held closer to zero (``l2_near``): most neighbours of a toxic word are there by chance.
    """
    start, length = _chains(rows)
    hit = np.array([tags[s : s + n].any() for s, n in zip(start, length)])
    draw = np.random.default_rng(seed)
    want = {True: most_chains // 3, False: min(2 * most_chains // 3, 5 * int(hit.sum()) + 200)}
    chance = np.where(hit, want[True] / max(1, hit.sum()), want[False] / max(1, (~hit).sum()))
    keep = draw.random(len(hit)) < chance
    start, length = start[keep], length[keep]
    step_ = np.arange(CHAIN)
    parts = []  # what a slice of chains needs in every round
    for i in range(0, len(start), slice_):
        n, grid = length[i : i + slice_], start[i : i + slice_, None] + step_
        inside, later, sooner = step_ < n[:, None], (step_ < n[:, None]) & (step_ > 0), step_ < n[:, None] - 1
        y = np.zeros(inside.shape)
        y[inside] = tags[grid[inside]]
        parts.append((start[i : i + slice_], n, f[grid[inside]], f[grid[later] - 1, 0], f[grid[sooner] + 1, 0], inside, later, sooner, y))
    pairs = max(1, sum(int(p[6].sum()) for p in parts))
    flat = np.zeros(3 * SIZE + 5)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    ridge = np.full_like(flat, l2)
    ridge[SIZE : 3 * SIZE] = l2_near
    words, last, still = max(1, int(length.sum())), np.inf, 0
    for k in range(1, rounds + 1):
        loss = 0.0
        field = Field(flat[:SIZE], flat[SIZE : 2 * SIZE], flat[2 * SIZE : 3 * SIZE], float(flat[-1]), flat[3 * SIZE : 3 * SIZE + 4].reshape(2, 2))
        t = np.exp(field.step)
        grad = np.zeros_like(flat)
        for s, n, own, before, after, inside, later, sooner, y in parts:
            psi, a, b = field.messages(field.odds(f, s, n), n)
            p = a * b
            q = p[:, :, 1] / p.sum(2)
            diff = np.where(inside, y - q, 0.0)
            loss -= float(np.log(np.maximum(1 - np.abs(diff[inside]), 1e-12)).sum()) / words
            joint = a[:, :-1, :, None] * t * (psi * b)[:, 1:, None, :]
            joint /= joint.sum((2, 3), keepdims=True)
            hot = np.stack([1 - y, y], 2)
            seen = hot[:, :-1, :, None] * hot[:, 1:, None, :]
            grad[3 * SIZE : 3 * SIZE + 4] += (((seen - joint) * later[:, 1:, None, None]).sum((0, 1)) / pairs * len(start)).ravel()
            for c in range(f.shape[1]):
                grad[:SIZE] += np.bincount(own[:, c], diff[inside], SIZE)
            grad[SIZE : 2 * SIZE] += np.bincount(before, diff[later], SIZE)
            grad[2 * SIZE : 3 * SIZE] += np.bincount(after, diff[sooner], SIZE)
            grad[-1] += diff.sum() / 10
        grad = grad / max(1, len(start)) - ridge * flat
        still = still + 1 if loss > 0.99 * last else 0
        last = loss
        if still == 2:
            break
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        flat = flat + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return Field(*(x.astype(np.float32) for x in (flat[:SIZE], flat[SIZE : 2 * SIZE], flat[2 * SIZE : 3 * SIZE])), float(flat[-1]), flat[3 * SIZE : 3 * SIZE + 4].reshape(2, 2))


def tag(f: np.ndarray, rows: np.ndarray, toxic: np.ndarray, chance: float = 1.0) -> np.ndarray:
    """Token labels from document labels: words with a feature that toxic documents have far more often.

    Far more: by a likelihood-ratio test whose level lets about ``chance`` features in all through by chance.
    """
    doc = np.repeat(np.arange(len(toxic)), np.diff(rows))
    out = np.zeros(len(f), bool)
    n = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    share = n[1] / (n[0] + n[1])
    for c in range(f.shape[1]):
        pair = np.unique(doc.astype(np.int64) * SIZE + f[:, c])
        d, bucket = pair // SIZE, pair % SIZE
        a, b = (np.bincount(bucket[toxic[d] == k], minlength=SIZE) for k in (1, 0))
        both = np.maximum(a + b, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.nan_to_num(a * np.log(a / (both * share))) + np.nan_to_num(b * np.log(b / (both * (1 - share)))))
        level = 2 * np.log(max(2, ((a + b) > 0).sum()) * f.shape[1] / chance)
        out |= ((ratio >= level) & (a / n[1] > 4 * b / n[0]))[f[:, c]]
    return out & (toxic[doc] == 1)


@dataclass(frozen=True)
class Model:
    field: Field | None
    curve: tuple[float, float, float]  # weights of the largest marginal and of log(1 + sum), and the bias

    def summary(self, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(p)])
        most = np.zeros(len(rows) - 1)
        full = np.flatnonzero(np.diff(rows))
        if len(full):
            most[full] = np.maximum.reduceat(p, rows[full])
        return np.stack([most, np.log1p(np.maximum(0, total[rows[1:]] - total[rows[:-1]]))], 1)

    def score(self, col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and marginals with the words' places."""
        f, starts, ends, rows = tokens(col)
        if self.field is None:
            return np.zeros(len(rows) - 1), np.zeros(len(f)), starts, ends, rows
        p = self.field.marginals(f, rows)
        s = self.summary(p, rows)
        return 1 / (1 + np.exp(-np.clip(s @ self.curve[:2] + self.curve[2], -30, 30))), p, starts, ends, rows


def train(texts: list[str], toxic: list[int]) -> Model:
    y = np.array(toxic, int)
    if not len(y) or y.min() == y.max():
        return Model(None, (0.0, 0.0, 0.0))
    steady_memory()
    f, _, _, rows = tokens(pa.array(texts, pa.string()))
    field = fit_field(f, rows, tag(f, rows, y))
    model = Model(field, (0.0, 0.0, 0.0))
    x = model.summary(field.marginals(f, rows), rows)
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(3)
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    for _ in range(50):  # Newton with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.01 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        w = w + np.linalg.solve(hess, grad)
    trim()
    return Model(field, tuple(w.tolist()))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = 1000, most_bytes: int = 30_000) -> Model:
    """On documents with the least hashes of the id among the usable labelled ones: ``per_label`` toxic and three times as many clean ids.

    Texts of more than ``most_bytes`` are not learned from, which bounds the sample to 6 * per_label * most_bytes.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(usable)
    drawn = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).toPandas() for k, n in ((1, per_label), (0, 3 * per_label))]
    if any(d.empty for d in drawn):
        return Model(None, (0.0, 0.0, 0.0))
    schema = f"doc_id {known.schema['doc_id'].dataType.simpleString()}, toxic int"
    ids = docs.sparkSession.createDataFrame([(i, k) for d, k in zip(drawn, (1, 0)) for i in d["doc_id"].tolist()], schema)
    short = docs.filter(F.octet_length("text") <= most_bytes).select("doc_id", "text")
    rows = short.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"])  # 4 * per_label ids are broadcast
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(6 * per_label).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """(doc_id, score, spans) of every text; spans are start:end of toxic words, in code points."""
    arrow_batches(docs.sparkSession)
    shared = share(docs.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, p, starts, ends, rows = shared.value.score(b.column("text"))
            out: list[list[str]] = [[] for _ in got]
            bad = np.flatnonzero(p >= 0.5)
            if spans and len(bad):
                data, offsets = as_bytes(b.column("text"))
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for k, row in zip(bad, np.searchsorted(rows, bad, "right") - 1):
                    base = lead[offsets[row]]
                    out[row].append(f"{lead[starts[k]] - base}:{lead[ends[k]] - base}")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got), pa.array(map(",".join, out), pa.string())], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double, spans string")

"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact check.

Items are partitioned by their number of five-word shingles, each class at most ``growth`` times as
wide as the one below. For a class that ends at u shingles, documents are read in windows of about 2u
shingles that start at least every u, so a passage of an item lies in one window, and the Jaccard
similarity of item and window stays above about least / (2 * growth) however long the document is. All
classes build their windows from one set of minima over blocks of ``block`` shingles. A window and an
item that share a MinHash value are a candidate; with ``hashes`` values a passage of an item is missed with
a probability under 1e-6. A window has two blocks at least, which is too wide for items of up to
``direct`` shingles: those are looked up by the shingles themselves, of which a text that contains the
item has one for sure. Candidates are decided by exact containment in the whole document.

Defined cases: a text or item without five words has no shingle and matches nothing; null counts as
empty. Items with equal text each match: they are searched as one text, by the digest of which the found
documents are joined with the items. A repeated document matches as often as it occurs. The distinct texts
of items are held in memory in parts of about ``part_bytes``, each with a pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import arrow_batches, share, tidy
from ._text import minhash, minhash_params, shingle_column


@dataclass(frozen=True)
class Settings:
    least: float = 0.8
    growth: float = 1.5
    hashes: int = 56
    block: int = 8
    direct: int = 3
    #: Bytes of an index in memory; an item takes ``item_bytes`` and eight bytes for each byte of its text (a word is two bytes at least).
    part_bytes: int = 64 << 20
    item_bytes: int = 1600


class Index:
    """Texts of one part by their ids: distinct shingles, a sorted list of MinHash values for each size class, and one of shingles for the shortest."""

    def __init__(self, ids: list, texts: list, s: Settings):
        self.settings = s
        flat, at = shingle_column(pa.array(texts, pa.string()), short=False)
        self.ids, self.sets = [], []
        for i, item in enumerate(ids):
            own = np.unique(flat[at[i] : at[i + 1]])
            if len(own):
                self.ids.append(item)
                self.sets.append(own)
        self.params = minhash_params(s.hashes)
        self.classes = []
        size = np.array([len(x) for x in self.sets], np.int64)
        level = np.ceil(np.log(np.maximum(size, 1)) / math.log(s.growth) - 1e-9).astype(int)
        short = size <= s.direct
        self._file_short(np.flatnonzero(short))
        for k in sorted(set(level[~short].tolist())):
            which = np.flatnonzero((level == k) & ~short)
            flat = np.concatenate([self.sets[i] for i in which])
            at = np.concatenate([[0], np.cumsum(size[which])])
            sig = minhash(flat, at, *self.params)
            key = self._keys(sig).ravel()
            owner = np.repeat(which, s.hashes)
            order = np.argsort(key, kind="stable")
            table = np.zeros(1 << 20, bool)
            table[self._place(sig.T).ravel()] = True
            self.classes.append((int(size[which].max()), table, key[order], owner[order]))

    def _file_short(self, which: np.ndarray) -> None:
        """Of n shingles of which m must be found, any n - m + 1 have one that is."""
        key, owner = [], []
        for i in which.tolist():
            n = len(self.sets[i])
            need = next((m for m in range(1, n) if m / n >= self.settings.least), n)
            key.append(self.sets[i][: n - need + 1])
            owner += [i] * (n - need + 1)
        key = np.concatenate(key) if key else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.short, self.short_owner = key[order], np.array(owner, np.int64)[order]
        self.short_table = np.zeros(1 << 20, bool)
        self.short_table[(key & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def _short_candidates(self, flat: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        for lo in range(0, len(flat) if len(self.short) else 0, 1 << 18):
            x = flat[lo : lo + (1 << 18)]
            maybe = np.flatnonzero(self.short_table[(x & np.uint64(0xFFFFF)).astype(np.int64)])
            first, last = (np.searchsorted(self.short, x[maybe], side) for side in ("left", "right"))
            rows = np.searchsorted(at, lo + maybe, "right") - 1
            for k in np.flatnonzero(last > first):
                found.update((int(rows[k]), int(i)) for i in self.short_owner[first[k] : last[k]])
        return found

    @staticmethod
    def _keys(sig: np.ndarray) -> np.ndarray:
        return sig.astype(np.uint64) * np.uint64(256) + np.arange(sig.shape[1], dtype=np.uint64)

    @staticmethod
    def _place(sig: np.ndarray) -> np.ndarray:
        """Where the (hashes, n) values are in a table of 2**20 flags; most windows end there."""
        return (sig ^ (np.arange(len(sig), dtype=np.uint32) * np.uint32(0x9E3779B1))[:, None]) & np.uint32(0xFFFFF)

    def _minima(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, blocks) of minima, and the rows' n+1 offsets into the blocks. The last block of a row repeats its last shingle."""
        g = self.settings.block
        n = np.diff(at)
        first = np.concatenate([[0], np.cumsum(-(-n // g))])
        row = np.repeat(np.arange(len(n)), np.diff(first))
        start = at[row] + (np.arange(first[-1]) - first[row]) * g
        out = np.empty((self.settings.hashes, first[-1]), np.uint32)
        for lo in range(0, first[-1], 2048):
            s = start[lo : lo + 2048]
            x = flat[np.minimum(s + np.arange(g)[:, None], at[row[lo : lo + 2048] + 1] - 1)]
            h = np.empty_like(x)
            for k, (mult, add) in enumerate(zip(*self.params)):
                np.multiply(x, mult, out=h)
                h += add
                out[k, lo : lo + 2048] = h.min(0) >> np.uint64(32)
        return out, first

    def candidates(self, flat: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) that share a MinHash value in a window, or a shingle that a short item is filed under."""
        found = self._short_candidates(flat, at)
        if not self.classes:
            return found
        minima, first = self._minima(flat, at)
        blocks, g = np.diff(first), self.settings.block
        for u, table, keys, owner in self.classes:
            step = max(1, u // g)
            long = step + -(-u // g)  # a passage that starts within the step ends inside
            many = -(-blocks // step)
            upto = np.concatenate([[0], np.cumsum(many)])
            row = np.repeat(np.arange(len(blocks)), many)
            start = first[row] + (np.arange(upto[-1]) - upto[row]) * step
            end = first[row + 1] - 1
            for lo in range(0, len(row), 4096):
                s, e = start[lo : lo + 4096], end[lo : lo + 4096]
                window = minima[:, s]
                for t in range(1, long):
                    np.minimum(window, minima[:, np.minimum(s + t, e)], out=window)
                k, w = np.nonzero(table[self._place(window)])
                if not len(k):
                    continue
                probe = window[k, w].astype(np.uint64) * np.uint64(256) + k.astype(np.uint64)
                at_key = np.searchsorted(keys, probe)
                hit = keys[np.minimum(at_key, len(keys) - 1)] == probe
                for i, value, r in zip(at_key[hit].tolist(), probe[hit], row[lo + w[hit]].tolist()):
                    while i < len(keys) and keys[i] == value:
                        found.add((r, int(owner[i])))
                        i += 1
        return found

    def matches(self, flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, shared shingles, the item's shingles) of every containment of ``least`` or more."""
        kept: tuple[int, np.ndarray] = (-1, flat[:0])
        for row, item in sorted(self.candidates(flat, at)):
            if kept[0] != row:
                kept = (row, np.unique(flat[at[row] : at[row + 1]]))
            own = self.sets[item]
            where = np.minimum(np.searchsorted(kept[1], own), len(kept[1]) - 1)
            shared = int((kept[1][where] == own).sum())
            if shared / len(own) >= self.settings.least:
                yield row, item, shared, len(own)


_KEY = "__item_text"


def _keyed(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.unhex(F.md5("text")).alias(_KEY), "text").filter("text IS NOT NULL")


def _parts(items: DataFrame, s: Settings) -> Iterator[Index]:
    """Distinct texts, dealt by their digest to as many parts as their measured size asks for."""
    texts = _keyed(items).groupBy(_KEY).agg(F.first("text").alias("text"))
    size = texts.agg(F.sum(s.item_bytes + 8 * F.octet_length("text").cast("long"))).first()[0] or 0
    many = max(1, math.ceil(size / s.part_bytes))
    for k in range(many):
        part = texts.filter(F.pmod(F.xxhash64(_KEY), F.lit(many)) == k) if many > 1 else texts
        rows = sorted((bytes(r[0]), r[1]) for r in part.collect())  # about part_bytes in memory
        yield Index([r[0] for r in rows], [r[1] for r in rows], s)


def find(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every item found in a document."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for index in _parts(items, s):
        shared = share(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                got = list(index.matches(*shingle_column(b.column("text"), short=False))) if index.ids else []
                row, item, n, of = (np.array(x, np.int64) for x in (zip(*got) if got else ([], [], [], [])))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row)), pa.array([index.ids[k] for k in item], pa.binary()), pa.array(n), pa.array(of), pa.array(n / np.maximum(of, 1))],
                    ["doc_id", _KEY, "shared", "item_shingles", "containment"],
                )

        part = docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, {_KEY} binary, shared long, item_shingles long, containment double")
        out = part if out is None else out.unionByName(part)
    return out.join(_keyed(items).drop("text"), _KEY).select("doc_id", "item_id", "shared", "item_shingles", "containment")


def clean(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents in which no item is found, with their columns."""
    arrow_batches(docs.sparkSession)
    schema = docs.schema
    for index in _parts(items, s):
        shared = share(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                free = np.ones(b.num_rows, bool)
                if index.ids:
                    for row, *_ in index.matches(*shingle_column(b.column("text"), short=False)):
                        free[row] = False
                yield b.filter(pa.array(free))

        docs = docs.mapInArrow(tidy(run), schema)
    return docs

"""Quality rules: counts over words and lines, and bands of zstandard compression ratios.

The ratio is compressed by plain bytes. Whole texts are held to a band that depends on their length;
those of a chunk or more are also cut into fixed chunks, the last of which ends where the text ends and
may overlap the one before, and the share of chunks outside the chunk band is limited.
Repetitive text compresses too well, random or encoded text too little.

Defined cases: a null or empty text has no words, fails the base rules and is not kept. Repeated rows
get equal results. Bytes that fill less than one chunk are judged as a whole only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ._shared import arrow_batches, tidy
from ._text import as_bytes, shingles, word_hashes, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    #: (from bytes, least ratio, most ratio) of whole texts, by length; the last that starts at or below counts.
    #: Below a hundred bytes or so no text gets smaller, and only what does is repetitive.
    whole: tuple[tuple[int, float, float], ...] = (
        (0, 1.2, 10.0), (16, 1.1, 1.6), (24, 0.75, 1.4), (32, 0.58, 1.3), (48, 0.38, 1.2), (64, 0.28, 1.145), (96, 0.2, 1.05), (128, 0.15, 1.0), (192, 0.11, 0.97),
        (256, 0.12, 0.95), (1024, 0.08, 0.85), (4096, 0.06, 0.75), (16384, 0.05, 0.70), (65536, 0.04, 0.66),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.06, 0.80)
    #: Most chunks outside the band, as a share.
    chunk_share: float = 0.25
    level: int = 3


def ratios(piece: memoryview, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole, and the share of chunks outside the chunk band."""
    n = len(piece)
    if not n:
        return 1.0, 0.0
    whole = len(packer.compress(piece)) / n
    size = bands.chunk_bytes
    if n < size:
        return whole, 0.0
    low, high = bands.chunk
    starts = [*range(0, n - size + 1, size), *([n - size] if n % size else [])]
    bad = sum(not low <= len(packer.compress(piece[i : i + size])) / size <= high for i in starts)
    return whole, bad / len(starts)


def verdict(n: int, whole: float, outside: float, bands: Bands) -> bool:
    _, low, high = [b for b in bands.whole if b[0] <= n][-1]
    return low <= whole <= high and outside <= bands.chunk_share


def repeated_words(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words a row that lie in a three-word window found at least twice in the row."""
    out = np.zeros(len(rows) - 1, np.int64)
    tri, at = shingles(hashes, rows, 3, short=False)
    for i in np.flatnonzero(np.diff(at) > 1):
        x = tri[at[i] : at[i + 1]]
        order = np.argsort(x, kind="stable")
        same = x[order[1:]] == x[order[:-1]]
        if same.any():
            twice = np.zeros(len(x) + 2, bool)
            where = np.concatenate([order[1:][same], order[:-1][same]])
            for k in range(3):
                twice[where + k] = True
            out[i] = twice.sum()
    return out


def duplicate_lines(piece: bytes) -> int:
    seen, n = set(), 0
    if b"\n" not in piece:
        return 0
    for line in piece.split(b"\n"):
        if line.strip():
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


def figures(b: pa.RecordBatch, bands: Bands, packer: zstandard.ZstdCompressor) -> dict[str, np.ndarray]:
    data, offsets = as_bytes(b.column("text"))
    starts, ends, rows = words(data, offsets)
    n_words = np.diff(rows)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points so far
    chars = np.concatenate([[0], np.cumsum(lead[ends] - lead[starts])])
    marks = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    repeat = repeated_words(word_hashes(data, starts, ends, fold=False), rows)
    view = memoryview(np.ascontiguousarray(data))
    lines, whole, outside, good = [], [], [], []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        piece = view[lo:hi]
        lines.append(duplicate_lines(bytes(piece)))
        w, o = ratios(piece, bands, packer)
        whole.append(w)
        outside.append(o)
        good.append(verdict(hi - lo, w, o, bands))
    failed = (n_words < 50) | (100 * repeat > 50 * n_words)
    return {
        "n_words": n_words, "word_chars": chars[rows[1:]] - chars[rows[:-1]], "n_symbols": marks[offsets[1:]] - marks[offsets[:-1]],
        "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": repeat, "base_failed": failed,
        "kept": ~failed & np.array(good, bool), "ratio": np.array(whole, float), "chunks_outside": np.array(outside, float),
    }


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_outside double"


def measure(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id and all figures of every text."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            got = figures(b, bands, packer)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, got.values())], ["doc_id", *got])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, {FIGURES}")


def apply_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            yield b.filter(pa.array(figures(b, bands, packer)["kept"]))

    return docs.mapInArrow(tidy(run), docs.schema)

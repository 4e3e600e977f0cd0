"""Words, shingles and MinHash of whole Arrow string columns, without a Python object per word.

A word is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]``. Work goes in slices of about a
megabyte, so memory follows the batch and not the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What is left of eight bytes of which only the first 0 to 8 belong to a word.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: A longer word is hashed whole by xxh3.
LONG_WORD = 256


def as_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 offsets; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, kind, len(col) + 1, col.offset * kind.itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run of bytes that aren't ``between``, and the n+1 offsets of the rows into them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~between[data]
    edge = np.ones(len(data) + 1, bool)  # a word may start here and must end here
    edge[1:-1] = ~solid[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(solid & edge[:-1])
    edge[:-1] = ~solid
    edge[offsets] = True
    ends = np.flatnonzero(solid & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each byte, as one number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, 0, (1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64 bits a word, mixed anew after every eight bytes; fold: A-Z count as a-z. Words of more than ``LONG_WORD`` bytes by xxh3."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # slices of about a megabyte, or one longer word
        j = max(int(np.searchsorted(ends, starts[i] + SLICE, "right")), i + 1)
        part = data[starts[i] : ends[j - 1]]
        if fold:
            part = _LOWER[part]
        s, n = starts[i:j] - starts[i], ends[i:j] - starts[i:j]
        h, at = n.astype(np.uint64) * _MULT, eights(part)
        live = np.flatnonzero(n <= LONG_WORD)
        for done in range(0, LONG_WORD, 8):
            live = live[n[live] > done]
            if not len(live):
                break
            h[live] = mix((h[live] ^ (at[s[live] + done] & _KEEP[np.minimum(n[live] - done, 8)])) * _MULT)
        for k in np.flatnonzero(n > LONG_WORD).tolist():
            h[k] = xxhash.xxh3_64_intdigest(part[s[k] : s[k] + n[k]])
        out[i:j] = h
        i = j
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the rows' n+1 offsets into them.

    short: a row of 1 to width-1 words gets one shingle of all its words, else none.
    """
    n = np.diff(rows)
    many = np.maximum(n - width + 1, np.minimum(n, 1) if short else 0)
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(at[-1], np.uint64)
    full = n >= width
    if full.any():
        reach = len(hashes) - width + 1
        total = np.zeros(reach, np.uint64)
        for k in range(width):
            total += hashes[k : k + reach] * np.uint64((int(_MULT) * (2 * k + 3)) & _MASK | 1)
        row = np.repeat(np.arange(len(n)), n)
        fits = row[:reach] == row[width - 1 :]
        where = np.repeat(full, many)
        out[where] = mix(total[fits])
    if short:
        for size in range(1, width):
            which = np.flatnonzero(n == size)
            if len(which):
                total = np.full(len(which), size, np.uint64)
                for k in range(size):
                    total += hashes[rows[which] + k] * np.uint64((int(_MULT) * (2 * k + 3)) & _MASK | 1)
                out[at[which]] = mix(total)
    return out, at


def shingle_column(col, width: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = as_bytes(col)
    starts, ends, rows = words(data, offsets)
    return shingles(word_hashes(data, starts, ends), rows, width, short)


def minhash_params(k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    return draw.integers(1, top, k, np.uint64) | np.uint64(1), draw.integers(0, top, k, np.uint64)


def minhash(values: np.ndarray, at: np.ndarray, mult: np.ndarray, add: np.ndarray, slice_: int = 1 << 15) -> np.ndarray:
    """(rows, k) of 32-bit minima; a row without values has the largest value throughout."""
    n = len(at) - 1
    out = np.full((n, len(mult)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    i = 0
    while i < len(full):
        j = max(int(np.searchsorted(at[full + 1], at[full[i]] + slice_, "right")), i + 1)
        lo, hi = at[full[i]], at[full[j - 1] + 1]
        for part in range(lo, hi, slice_ * 4) if j == i + 1 else (lo,):
            x = values[part : min(hi, part + slice_ * 4)] if j == i + 1 else values[lo:hi]
            cuts = [0] if j == i + 1 else at[full[i:j]] - lo
            buf = np.empty_like(x)
            for k in range(len(mult)):
                np.multiply(x, mult[k], out=buf)
                buf += add[k]
                got = (np.minimum.reduceat(buf, cuts) >> np.uint64(32)).astype(np.uint32)
                out[full[i:j], k] = np.minimum(out[full[i:j], k], got)
        i = j
    return out


def digest128(piece) -> bytes:
    return xxhash.xxh3_128_digest(piece)


def rows_between(values: np.ndarray, at: np.ndarray):
    for i in range(len(at) - 1):
        yield values[at[i] : at[i + 1]]

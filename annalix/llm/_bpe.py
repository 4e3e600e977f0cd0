"""Token ids of whole texts by a tokenizers file, with a memo of space-separated pieces.

Only for a tokenizer whose pre-tokens never hold white space (``splits_at_space`` checks the file):
then a text's ids are those of its pieces, one after the other, and frequent pieces need no second
encoding. Trailing ASCII punctuation is a pre-token of its own and is looked up apart. Pieces of more
than ``SHORT`` bytes are not remembered: the library encodes each of them. Other files are encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from ._text import _KEEP, as_bytes, eights, mix, words

#: Characters that always end a run of letters and occur in no special token or contraction.
_TAIL = b".,;:!?%*#$&)]}"
#: Pieces learned at a time.
LEARN = 16384
#: Most bytes of a piece in the memo: a key is all of them, and their number.
SHORT = 23
#: Pieces looked at together.
PIECES = 1 << 18
_IS_TAIL = np.zeros(256, bool)
_IS_TAIL[list(_TAIL)] = True
_IS_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])


def splits_at_space(spec: dict) -> bool:
    kinds = lambda x: [y for k in ("normalizers", "pretokenizers") for y in (x or {}).get(k, [])] or ([x] if x else [])
    norm, pre = kinds(spec.get("normalizer")), kinds(spec.get("pre_tokenizer"))
    known = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " " for n in norm)
    split = [p for p in pre if p["type"] == "Split"]
    removed = len(split) == 1 and split[0]["behavior"] == "Removed" and split[0]["invert"] and split[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    byte = all(p["type"] == "Split" or p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"[\s.,;:!?%*#$&)\]}]", t["content"])) for t in spec.get("added_tokens", []))
    model = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
    return known and removed and byte and added and model and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")


def piece_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(3, pieces): the bytes of pieces of at most ``SHORT`` bytes, the last being their number; all zero for an empty piece."""
    n = ends - starts
    lo, hi = int(starts[0]) if len(starts) else 0, int(ends.max()) if len(ends) else 0
    at, s = eights(data[lo:hi]), starts - lo
    out = np.zeros((3, len(starts)), np.uint64)
    out[0] = at[s] & _KEEP[np.minimum(n, 8)]
    for k in (1, 2):
        live = np.flatnonzero(n > 8 * k)
        out[k, live] = at[s[live] + 8 * k] & _KEEP[np.minimum(n[live] - 8 * k, 8)]
    out[2] |= n.astype(np.uint64) << np.uint64(56)
    return out


def _spread(keys: np.ndarray) -> np.ndarray:
    return mix(keys[0] + keys[1] * np.uint64(0xD6E8FEB86659FD93) + keys[2] * np.uint64(0xCA5A826395121157))


class Memo:
    """Ids of pieces by their bytes: an open-addressing table over one pool of ids. Keys are compared whole.

    Emptied between batches when full; it grows only where one batch has more new pieces than there is room for.
    """

    def __init__(self, bits: int = 20):
        self.least = bits
        self.clear()

    def clear(self) -> None:
        self.bits = self.least
        self.entry = np.zeros(1 << self.bits, np.int32)  # 0: free
        self.keys = np.zeros((3, 1), np.uint64)  # entry 0: the empty piece, no ids
        self.start = np.zeros(1, np.int64)
        self.length = np.zeros(1, np.int32)
        self.pool = np.zeros(0, np.uint32)
        self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 if unknown."""
        out = np.zeros(keys.shape[1], np.int32)
        at = np.flatnonzero(keys[2])
        slot = (_spread(keys[:, at]) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(at):
            got = self.entry[slot]
            free = got == 0
            hit = ~free & (self.keys[0, got] == keys[0, at]) & (self.keys[1, got] == keys[1, at]) & (self.keys[2, got] == keys[2, at])
            out[at[hit]] = got[hit]
            out[at[free]] = -1
            go = ~(hit | free)
            at, slot = at[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, fresh: np.ndarray, n: np.ndarray) -> None:
        """Distinct unknown keys, their ids one after the other, and how many each has."""
        first = len(self.start)
        self.start = np.concatenate([self.start, self.used + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.keys = np.concatenate([self.keys, keys], 1)
        if self.used + len(fresh) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(fresh), self.used // 2), np.uint32)])
        self.pool[self.used : self.used + len(fresh)] = fresh
        self.used += len(fresh)
        if len(self.start) > (7 << self.bits) >> 3:
            while len(self.start) > (3 << self.bits) >> 2:
                self.bits += 1
            self.entry = np.zeros(1 << self.bits, np.int32)
            first = 1
        self._put(np.arange(first, len(self.start), dtype=np.int32))

    def _put(self, entry: np.ndarray) -> None:
        slot = (_spread(self.keys[:, entry]) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(entry):
            free = np.flatnonzero(self.entry[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.entry[slot[put]] = entry[put]
            rest = np.ones(len(entry), bool)
            rest[put] = False
            entry, slot = entry[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    @property
    def full(self) -> bool:
        return len(self.start) > 3 << (self.least - 2)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.by_piece = splits_at_space(spec)
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.memo = Memo()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, sizes): the ids of all pieces in another order. Runs of letters are encoded in one line and cut at the ends of words, others one by one."""
        rest = [k for k, p in enumerate(pieces) if not p.isalpha()]
        plain = [k for k, p in enumerate(pieces) if p.isalpha()]
        order, ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            own = self._encode([" ".join(pieces[k] for k in some)])[0]
            cuts = np.flatnonzero(self.ends[own]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(own):
                order.append(np.array(some))
                ids.append(own)
                sizes.append(np.diff(cuts, prepend=0).astype(np.int32))
            else:
                rest += some
        if rest:
            each = self._encode([pieces[k] for k in rest])
            order.append(np.array(rest))
            ids += each
            sizes.append(np.array([len(x) for x in each], np.int32))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(sizes)

    def _pieces(self, col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, start and end of two pieces a word (the second, its tail, mostly empty), and the rows' n+1 offsets into them."""
        data, offsets = as_bytes(col)
        starts, ends, rows = words(data, offsets)
        cut = ends.copy()
        for _ in range(4):
            more = _IS_TAIL[data[cut - 1]] & (cut - 1 > starts)
            if not more.any():
                break
            cut -= more
        # the tail is cut off only after an ASCII letter or digit: a pre-token surely ends there
        cut = np.where(_IS_ALNUM[data[cut - 1]], cut, ends)
        return data, np.stack([starts, cut], 1).ravel(), np.stack([cut, ends], 1).ravel(), 2 * rows

    def _entries(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Memo entries of pieces, and which of them are too long to have one (their entry is that of the empty piece)."""
        text = lambda k: data[lo[k] : hi[k]].tobytes().decode("utf-8")
        long = np.flatnonzero(hi - lo > SHORT)
        end = hi.copy()
        end[long] = lo[long]
        keys = piece_keys(data, lo, end)
        got = self.memo.find(keys)
        new = np.flatnonzero(got < 0)
        if len(new):
            if self.memo.full:
                self.memo.clear()
                got[:] = 0
                new = np.flatnonzero(keys[2])
            order = new[np.lexsort(keys[:, new])]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(0)
            first = order[fresh]
            entry = np.empty(len(first), np.int32)
            for k in range(0, len(first), LEARN):
                some = first[k : k + LEARN]
                by, ids, sizes = self._learn([text(x) for x in some.tolist()])
                entry[k + by] = len(self.memo.start) + np.arange(len(by))
                self.memo.add(keys[:, some[by]], ids, sizes)
            got[order] = entry[np.cumsum(fresh) - 1]
        return got, long

    def _long(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        """Ids of the pieces without an entry, some megabytes of text at a time."""
        out: list[np.ndarray] = []
        size = np.cumsum(hi - lo) // (4 << 20)
        for part in np.split(np.arange(len(lo)), np.flatnonzero(size[1:] != size[:-1]) + 1):
            out += self._encode([data[lo[k] : hi[k]].tobytes().decode("utf-8") for k in part])
        return out

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all rows of an Arrow string column, without added special tokens, and the rows' n+1 offsets."""
        if not self.by_piece:
            ids = self._encode([t or "" for t in col.to_pylist()])
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        data, lo, hi, rows = self._pieces(col)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(lo), PIECES):
            a, b = lo[k : k + PIECES], hi[k : k + PIECES]
            got, long = self._entries(data, a, b)
            own = self._long(data, a[long], b[long])
            n = self.memo.length[got].astype(np.int64)
            n[long] = [len(x) for x in own]
            upto = np.concatenate([[0], np.cumsum(n)])
            known = n > 0
            known[long] = False
            out = np.empty(upto[-1], np.uint32)
            where = np.arange(n[known].sum()) + np.repeat(self.memo.start[got[known]] - np.cumsum(n[known]) + n[known], n[known])
            out[np.repeat(known, n) if own else slice(None)] = self.memo.pool[where]
            for i, x in zip(long.tolist(), own):
                out[upto[i] : upto[i + 1]] = x
            ids.append(out)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[rows]

    def counts(self, col) -> np.ndarray:
        if not self.by_piece:
            return np.array([len(x) for x in self._encode([t or "" for t in col.to_pylist()])], np.int64)
        data, lo, hi, rows = self._pieces(col)
        sizes = [np.zeros(0, np.int64)]
        for k in range(0, len(lo), PIECES):
            a, b = lo[k : k + PIECES], hi[k : k + PIECES]
            got, long = self._entries(data, a, b)
            n = self.memo.length[got].astype(np.int64)
            n[long] = [len(x) for x in self._long(data, a[long], b[long])]
            sizes.append(n)
        return np.diff(np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[rows])


class PieceEncoder:
    """The same for a sentencepiece file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode([t or "" for t in col.to_pylist()], num_threads=1)
        return np.array([i for x in ids for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def counts(self, col) -> np.ndarray:
        return np.diff(self.encode(col)[1])


@lru_cache(4)
def encoder(path: str):
    """One a worker process and file, so that its memo lasts over tasks."""
    return PieceEncoder(path) if path.endswith(".model") else Encoder(path)


def file_digest(path: str) -> str:
    import hashlib

    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()

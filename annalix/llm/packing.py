"""Vector bin packing of documents into training sequences.

Every item has three demands: tokens, segments (one a piece) and loss-bearing tokens. A sequence has a
capacity in each. The dot-product heuristic fills one sequence at a time: of the items that fit, the one
with the largest sum of demand times remaining capacity, both as shares of the capacity, comes next. When
none fits, or only one segment is left, the longest item is cut to what remains, and its rest returns to
the pool; so sequences are full but for the last of a task, which is cut into sequences whose lengths
are powers of two and need no padding. A sequence that its segments or its loss-bearing tokens end early
is cut back to a power of two as well, and what was cut off returns to the pool. Where all tokens bear
loss and the capacities are equal, the loss-bearing tokens end none.

Tasks pack what they read, in windows of ``window`` documents, so there is no shuffle, memory is bounded
and lost tasks are simply run again. Defined cases: a null text is empty and has the end id alone; rows
that repeat an id are packed apart; an empty table gives none; more columns are not read. A null count of
loss-bearing tokens stands for all, as does one beyond the document's tokens; a negative one for none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._bpe import encoder
from ._shared import arrow_batches, tidy


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Packer:
    """Open items as arrays: owner, start, tokens left, loss-bearing tokens left (the first ones of what is left).

    Of an item's tokens the leading ``loss`` ones bear loss, so a cut takes min(cut, loss) of them.
    """

    def __init__(self, cap: Capacity):
        self.cap = cap
        self.owner = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int64)
        self.loss = np.zeros(0, np.int64)
        self.sequence = 0

    def add(self, owner: np.ndarray, tokens: np.ndarray, loss: np.ndarray) -> None:
        self.owner = np.concatenate([self.owner, owner])
        self.start = np.concatenate([self.start, np.zeros(len(owner), np.int64)])
        self.tokens = np.concatenate([self.tokens, tokens])
        self.loss = np.concatenate([self.loss, loss])

    def _take(self, k: int, n: int, out: list, offset: int) -> int:
        """Moves the first n tokens of item k to the open sequence; returns their loss-bearing ones."""
        bear = int(min(n, self.loss[k]))
        out.append((int(self.owner[k]), int(self.start[k]), n, self.sequence, offset))
        self.start[k] += n
        self.tokens[k] -= n
        self.loss[k] -= bear
        return bear

    def _give_back(self, taken: list[tuple[int, int, int]], out: list, n: int) -> None:
        """Returns the last n tokens of the open sequence; taken has (item, tokens, loss-bearing ones) of its pieces."""
        while n:
            k, size, bear = taken.pop()
            owner, start, _, sequence, offset = out.pop()
            back = min(n, size)
            self.start[k] -= back
            self.tokens[k] += back
            self.loss[k] += bear - min(bear, size - back)
            if size > back:
                out.append((owner, start, size - back, sequence, offset))
            n -= back

    def pack(self, leave: int) -> list[tuple[int, int, int, int, int]]:
        """(owner, start, length, sequence, offset) of full sequences, until at most ``leave`` tokens are open."""
        cap, out = self.cap, []
        total = int(self.tokens.sum())
        while total > leave:
            room, segments, loss, offset, taken = min(cap.tokens, total), cap.segments, cap.loss, 0, []
            if total < cap.tokens:
                room = 1 << (total.bit_length() - 1)
            size = room
            while room and segments:
                weight = self.tokens * (room / cap.tokens**2) + self.loss * (loss / cap.loss**2) + segments / cap.segments**2
                fits = (self.tokens > 0) & (self.tokens <= room) & (self.loss <= loss)
                k = int(np.where(fits, weight, -1.0).argmax())
                if segments == 1 or not fits[k]:
                    k = int(np.where((self.tokens > 0) & (np.minimum(self.loss, room) <= loss), self.tokens, 0).argmax())
                    if not self.tokens[k] or min(self.loss[k], room) > loss:
                        if offset:
                            break
                        k = int(self.tokens.argmax())
                    n = int(min(room, self.tokens[k], loss if self.loss[k] > loss else room))
                else:
                    n = int(self.tokens[k])
                bear = self._take(k, n, out, offset)
                taken.append((k, n, bear))
                loss -= bear
                offset += n
                room -= n
                segments -= 1
            if offset & (offset - 1):
                over = offset - (1 << (offset.bit_length() - 1))
                self._give_back(taken, out, over)
                offset -= over
            total -= offset
            self.sequence += 1
            assert offset and offset <= size
            if (self.tokens == 0).mean() > 0.5:
                self._compact()
        self._compact()
        return out

    def _compact(self) -> None:
        left = self.tokens > 0
        self.owner, self.start, self.tokens, self.loss = self.owner[left], self.start[left], self.tokens[left], self.loss[left]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, cap: Capacity = Capacity(), window: int = 512, window_tokens: int = 1 << 20, loss: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    A document's ids are the tokenizer's and end_id. ``loss`` names the column that says how many of them bear
    loss, the leading ones; without it all do. sequence_id is the task's number times 2**33 plus a count.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, base = encoder(tokenizer_path), Packer(cap), TaskContext.get().partitionId() << 33
        open_: dict[int, tuple[object, np.ndarray, int]] = {}
        arrow = None
        n = waiting = 0

        def emit(pieces: list) -> pa.RecordBatch:
            owner, start, length, sequence, offset = (list(x) for x in zip(*pieces)) if pieces else ([],) * 5
            crc = [zlib.crc32(open_[o][1][s : s + k].tobytes()) for o, s, k in zip(owner, start, length)]
            of = [len(open_[o][1]) for o in owner]
            ids = pa.array([open_[o][0] for o in owner], arrow)
            long = lambda x: pa.array(x, pa.int64())
            done = open_.keys() - set(packer.owner.tolist())
            out = pa.RecordBatch.from_arrays([ids, long(start), long(length), long(crc), long(of), long([base + s for s in sequence]), long(offset)], names)
            for o in done:
                del open_[o]
            return out

        def load(fresh: list[tuple[object, np.ndarray, int]]) -> None:
            nonlocal n
            for item in fresh:
                open_[n] = item
                n += 1
            sizes = np.array([len(x) for _, x, _ in fresh], np.int64)
            packer.add(np.arange(n - len(fresh), n), sizes, np.array([bear for _, _, bear in fresh], np.int64))

        fresh: list[tuple[object, np.ndarray, int]] = []
        for b in batches:
            arrow = b.column("doc_id").type
            flat, at = enc.encode(b.column("text"))
            bears = b.column("loss").to_pylist() if loss else [None] * b.num_rows
            for row, (doc, bear) in enumerate(zip(b.column("doc_id").to_pylist(), bears)):
                ids = np.append(flat[at[row] : at[row + 1]], np.uint32(end_id))
                fresh.append((doc, ids, len(ids) if bear is None else min(max(bear, 0), len(ids))))
                waiting += len(ids)
                if len(fresh) >= window or waiting >= window_tokens:
                    load(fresh)
                    fresh, waiting = [], 0
                    yield emit(packer.pack(leave=64 * cap.tokens))
        if arrow is not None:
            load(fresh)
            yield emit(packer.pack(leave=0))

    counts = [F.col(loss).cast("long").alias("loss")] if loss else []
    return docs.select("doc_id", "text", *counts).mapInArrow(tidy(run), schema)

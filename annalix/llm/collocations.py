"""Phrases whose words keep together, mined from vertical positional lists.

Documents are cut into blocks of about a million words. A block holds its words as numbers, and for each phrase the
sorted list of positions where it occurs; a position is skipped at every end of a piece, so phrases don't cross it. The
length of a list is the phrase's frequency in the block, and the sum over blocks its frequency. Blocks send
lengths under 64-bit hashes of the phrases, in one bundle for each range of hashes; ranges add them up and tell each block
which of its phrases are frequent, and one block of each phrase its frequency. There the ends of their occurrences are merged with the
postings of frequent words, which gives the lists of phrases a word longer; an occurrence is extended only if the phrase
without its first word is frequent as well. Phrases are told apart by those 64 bits.

What a task holds is a block, or one document if that is longer, or the bundles of a range, of which there are as many as
partitions of the input. Ranking passes on at most ``top`` rows a task and language.

Defined cases: a null or empty text has no words, a null language counts as ``und``. Repeated rows count as often as they come.
Empty tables give no rows. Only text and lang are read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import arrow_batches, delete, materialise, scratch, tidy
from ._text import mix

#: Least occurrences, most words, rows a language.
LEAST, MOST_WORDS, TOP = 30, 4, 2000
#: Scale of the score; a longer candidate that has this share of the occurrences (per cent) absorbs a shorter one.
SCALE, ABSORBS = 2_000_000, 80
BLOCK_WORDS = 1 << 20
#: Bytes of a text that are split at a time.
SLICE = 1 << 20
_BREAK = b"\xff"  # no byte of UTF-8
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
_FOLD[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 0xFF
_FOLD = bytes(_FOLD)
_GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")


class _Numbers(dict):
    """Words of a language in a block to numbers, as they come; 0 is the end of a piece."""

    def __init__(self, names: list):
        super().__init__()
        self.names = names

    def __missing__(self, word: bytes) -> int:
        self.names.append(word)
        n = self[word] = len(self.names) - 1
        return n


def _tokens(text: bytes, numbers: _Numbers) -> Iterator[np.ndarray]:
    """Numbers of the words of one text, and a 0 after every piece."""
    i = 0
    while i < len(text):
        gap = _GAP.search(text, i + SLICE)
        j = gap.start() if gap else len(text)
        parts = text[i:j].translate(_FOLD).replace(_BREAK, b" \xff ").split(b" ")
        yield np.fromiter((numbers[w] for w in parts if w), np.int32)
        i = j
    yield np.zeros(1, np.int32)


def _blocks(rows: Iterable[tuple[str, bytes]]) -> Iterator[tuple[np.ndarray, list[bytes], list[str]]]:
    """(word numbers, words by number, language by number) of every block."""

    def made():
        return np.concatenate(held), names, owner

    names, owner, held, known, size = [_BREAK], [""], [], {}, 0
    for lang, text in rows:
        numbers = known.get(lang)
        if numbers is None:
            numbers = known[lang] = _Numbers(names)
            numbers[_BREAK] = 0
        for part in _tokens(text, numbers):
            held.append(part)
            size += len(part)
        owner.extend([lang] * (len(names) - len(owner)))
        if size >= BLOCK_WORDS:
            yield made()
            names, owner, held, known, size = [_BREAK], [""], [], {}, 0
    if held:
        yield made()


def _word_hashes(words: list[str], owners: np.ndarray, langs: list[str]) -> np.ndarray:
    salt = [f"{x}\n".encode() for x in langs]
    return np.array([xxhash.xxh3_64_intdigest(salt[o] + w.encode()) for w, o in zip(words, owners.tolist())], np.uint64)


@dataclass
class Block:
    """Occurrences of a block's phrases of ``width`` words, along the block, and the words that may follow.

    Of width 0 are the words themselves before it is known which are frequent: every word may follow. Of width 1 the phrases are the
    words, and their occurrences the postings.
    """

    width: int
    steps: np.ndarray  # differences of the positions
    which: np.ndarray  # number of the phrase at each
    parts: np.ndarray  # (phrases, width): numbers of their words
    hashes: np.ndarray  # of the phrases
    places: np.ndarray  # differences of the positions of words that may follow: the postings
    follow: np.ndarray  # number of the word at each
    words: list[str]
    owners: np.ndarray  # languages of the words
    word_hashes: np.ndarray
    langs: list[str]

    def pack(self) -> bytes:
        """Without what follows from the rest: hashes, at width 1 what is there twice, and words that neither a phrase nor a posting names."""
        used = np.unique(np.concatenate([self.parts.ravel(), self.follow])) if self.width else np.arange(len(self.words))
        number = np.zeros(len(self.words), np.int32)
        number[used] = np.arange(len(used))
        more = (_planes(self.steps), _planes(self.which), [_planes(np.ascontiguousarray(number[p])) for p in self.parts.T]) if self.width > 1 else None
        parts = (self.width, more, _planes(self.places), _planes(number[self.follow]), [self.words[i] for i in used.tolist()], _planes(self.owners[used]), self.langs)
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, 5))

    @staticmethod
    def unpack(packed: bytes) -> Block:
        width, more, places, follow, words, owners, langs = pickle.loads(zstandard.ZstdDecompressor().decompress(packed))
        places, follow, owners = (_of_planes(x, np.int32) for x in (places, follow, owners))
        word_hashes = _word_hashes(words, owners, langs)
        if more is None:
            return Block(width, places, follow, np.arange(len(words), dtype=np.int32)[:, None], word_hashes, places, follow, words, owners, word_hashes, langs)
        parts = np.stack([_of_planes(x, np.int32) for x in more[2]], 1)
        hashes = word_hashes[parts[:, 0]]
        for k in range(1, width):
            hashes = _longer_hash(hashes, word_hashes[parts[:, k]])
        return Block(width, *(_of_planes(x, np.int32) for x in more[:2]), parts, hashes, places, follow, words, owners, word_hashes, langs)

    def named(self, numbers: list[int]) -> tuple[list[str], list[str]]:
        """(languages, phrases) of some numbers."""
        some = self.parts[numbers].tolist()
        return [self.langs[self.owners[p[0]]] for p in some], [" ".join([self.words[i] for i in p]) for p in some]


def _longer_hash(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(head * np.uint64(0x9E3779B97F4A7C15) + word)


@dataclass
class Lists:
    """The lists of phrases a word longer than a block's, numbered by their hashes: places and numbers of occurrences, and what each number stands for."""

    places: np.ndarray
    which: np.ndarray
    heads: np.ndarray
    tails: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray


def _apart(positions: np.ndarray) -> np.ndarray:
    return np.diff(positions, prepend=0).astype(np.int32)


def _at(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)


def _lists(block: Block) -> Lists:
    """Merges the ends of a block's occurrences with the postings."""
    if block.width == 0:
        order = np.argsort(block.word_hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which = rank[block.follow]
        return Lists(_at(block.places), which, order, order, block.word_hashes[order], np.bincount(which, minlength=len(order)))
    positions, places, which, follow = _at(block.steps), _at(block.places), block.which.astype(np.int64), block.follow
    meets = np.zeros(len(positions), bool)
    if len(places):
        at = np.searchsorted(places, positions + block.width)
        at[at == len(places)] = 0
        meets = places[at] == positions + block.width
        if block.width > 1:
            meets[:-1] &= positions[1:] == positions[:-1] + 1  # a frequent phrase starts a word later: the longer one's end
            meets[-1:] = False
    if not meets.any():
        none = np.zeros(0, np.int64)
        return Lists(none, none, none, none, np.zeros(0, np.uint64), none)
    code, number = np.unique(which[meets] * len(block.words) + follow[at[meets]], return_inverse=True)
    heads, tails = code // len(block.words), code % len(block.words)
    hashes = _longer_hash(block.hashes[heads], block.word_hashes[tails])
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number = rank[number]
    return Lists(positions[meets], number, heads[order], tails[order], hashes[order], np.bincount(number, minlength=len(order)))


def _longer(block: Block, lists: Lists, chosen: np.ndarray) -> Block:
    """The block of the chosen lists."""
    number = np.full(len(lists.sizes), -1, np.int64)
    number[chosen] = np.arange(len(chosen))
    which = number[lists.which]
    keep = which >= 0
    positions, which, width = lists.places[keep], which[keep].astype(np.int32), block.width + 1
    heads, tails, hashes = lists.heads[chosen].astype(np.int32), lists.tails[chosen].astype(np.int32), lists.hashes[chosen]
    if width == 1:  # the lists of frequent words are the postings
        steps, words = _apart(positions), [block.words[i] for i in heads.tolist()]
        return Block(1, steps, which, np.arange(len(words), dtype=np.int32)[:, None], hashes, steps, which, words, block.owners[heads], hashes, block.langs)
    places = _at(block.places)
    on = np.isin(places, positions + width, assume_unique=True)
    parts = np.concatenate([block.parts[heads], tails[:, None]], 1)
    return Block(width, _apart(positions), which, parts, hashes, _apart(places[on]), block.follow[on], block.words, block.owners, block.word_hashes, block.langs)


#: Rows of all kinds: a block; a bundle of lengths; a frequent phrase and its frequency; words of a language in a block (without a phrase).
ROWS = "kind string, block string, state binary, range int, first int, hashes binary, sizes binary, lang string, phrase string, n long"
_ROWS = pa.schema([("kind", pa.string()), ("block", pa.string()), ("state", pa.binary()), ("range", pa.int32()), ("first", pa.int32()), ("hashes", pa.binary()), ("sizes", pa.binary()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _batch(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _ROWS], schema=_ROWS)


def _send(name: str, block: Block, ranges: int) -> Iterator[pa.RecordBatch]:
    """The block, and the lengths of its lists in bundles, a range of hashes each."""
    lists = _lists(block)
    if not len(lists.hashes):
        return
    yield _batch(1, kind=["block"], block=[name], state=[block.pack()])
    of = ((lists.hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    packer, n = zstandard.ZstdCompressor(level=3), len(cuts) - 1
    parts = [(lists.hashes[lo:hi], lists.sizes[lo:hi].astype(np.uint32)) for lo, hi in zip(cuts, cuts[1:])]
    yield _batch(
        n, kind=["bundle"] * n, block=[name] * n, range=[int(of[lo]) for lo in cuts[:-1]], first=cuts[:-1],
        hashes=[packer.compress(_planes(np.diff(h, prepend=np.uint64(0)))) for h, _ in parts], sizes=[packer.compress(_planes(c)) for _, c in parts],
    )


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones, then all second ones: high bytes are mostly zero and go away in compression."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _of_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def _whole(packed: bytes, kind: type) -> np.ndarray:
    return _of_planes(zstandard.ZstdDecompressor().decompress(packed), kind)


def _first(batches: Iterable[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Blocks of words."""
    task = TaskContext.get().partitionId()
    none = np.zeros(0, np.int32)

    def rows():
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                yield lang, (text.as_py() or "").encode()

    for k, (tokens, names, owner) in enumerate(_blocks(rows())):
        number = {x: n for n, x in enumerate(dict.fromkeys(owner[1:]))}
        langs, owners = list(number), np.array([number[x] for x in owner[1:]], np.int32)
        where, known = np.flatnonzero(tokens), [w.decode() for w in names[1:]]
        words = tokens[where] - 1
        yield from _send(f"{task}-{k}", Block(0, none, none, none[:, None], none, _apart(where), words, known, owners, _word_hashes(known, owners, langs), langs), ranges)
        many = np.bincount(owners[words], minlength=len(langs)) if len(words) else np.zeros(len(langs), np.int64)
        yield _batch(len(langs), kind=["words"] * len(langs), lang=langs, n=many)


#: What a range tells a block: a bit for each list of the bundle whether it is frequent, and the numbers of those that it is to name, with their frequencies.
TOLD = "block string, first int, n int, good binary, named binary, sums binary"


def _add_up(least: int):
    """The lengths of a range's hashes over all blocks."""

    def run(t: pa.Table) -> pa.Table:
        hashes = [np.cumsum(_whole(x.as_py(), np.uint64)) for x in t["hashes"]]
        every, total = np.concatenate(hashes), np.concatenate([_whole(x.as_py(), np.uint32) for x in t["sizes"]])
        order = np.argsort(every, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0]))
        sums = np.add.reduceat(total[order].astype(np.int64), starts)
        sum_of, good, names = np.zeros(len(every), np.int64), np.zeros(len(every), bool), np.zeros(len(every), bool)
        good[order] = np.repeat(sums >= least, np.diff(np.append(starts, len(every))))
        first_of = order[starts[sums >= least]]
        names[first_of], sum_of[first_of] = True, sums[sums >= least]
        rows, at, packer = [], 0, zstandard.ZstdCompressor(level=3)
        for block, first, h in zip(t["block"].to_pylist(), t["first"].to_pylist(), hashes):
            part = slice(at, at + len(h))
            at += len(h)
            if good[part].any():
                mine = np.flatnonzero(names[part])
                rows.append((block, first, len(h), packer.compress(np.packbits(good[part]).tobytes()), packer.compress(_planes((mine + first).astype(np.int32))), packer.compress(_planes(sum_of[part][mine]))))
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(TOLD.split(", "), cols, kinds)})

    return run


def _heard(told: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a block's frequent lists, ascending, and of those it is to name with their frequencies."""
    opened = zstandard.ZstdDecompressor()
    good = [r["first"] + np.flatnonzero(np.unpackbits(np.frombuffer(opened.decompress(r["good"]), np.uint8), count=r["n"])) for r in told]
    return np.sort(np.concatenate(good)), np.concatenate([_whole(r["named"], np.int32) for r in told]), np.concatenate([_whole(r["sums"], np.int64) for r in told])


def _next(last: bool, ranges: int):
    """Names and frequencies that a block is to tell; and unless they are of the longest phrases, what may extend its frequent lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, packed, told in zip(b.column("block").to_pylist(), b.column("state"), b.column("told")):
                block = Block.unpack(packed.as_py())
                chosen, named, f = _heard(told.as_py())
                block = _longer(block, _lists(block), chosen)
                at = np.searchsorted(chosen, named).tolist()
                for i in range(0, len(at), 1 << 15):
                    some = at[i : i + (1 << 15)]
                    langs, phrases = block.named(some)
                    yield _batch(len(some), kind=["phrase"] * len(some), lang=langs, phrase=phrases, n=f[i : i + (1 << 15)])
                if not last:
                    yield from _send(name, block, ranges)

    return run


def frequencies(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, width, f) of all phrases of up to ``most_words`` words that occur ``least`` times in their language, (lang, n) with all words)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())

    def stored(made: DataFrame, name: str) -> tuple[str, Callable[[str], DataFrame]]:
        """All kinds of rows in the same files: few files, and of a kind only its columns are read."""
        path = scratch(spark, name)
        made.write.parquet(path)
        back = spark.read.schema(ROWS).parquet(path)
        return path, lambda kind: back.filter(F.col("kind") == kind)

    path, kind = stored(rows.mapInArrow(tidy(lambda b: _first(b, ranges)), ROWS), "words")
    totals = materialise(kind("words").groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    found = []
    for width in range(1, most_words + 1):
        told = kind("bundle").select("range", "block", "first", "hashes", "sizes").groupBy("range").applyInArrow(_add_up(least), TOLD)
        own = told.groupBy("block").agg(F.collect_list(F.struct("first", "n", "good", "named", "sums")).alias("told"))  # an entry a range
        asked = kind("block").select("block", "state").join(own, "block")
        before = path
        path, kind = stored(asked.mapInArrow(tidy(_next(width == most_words, ranges)), ROWS), f"phrases-{width}")
        delete(spark, before)
        found.append(materialise(kind("phrase").select("lang", "phrase", F.col("n").alias("f"), F.lit(width).alias("width")), f"frequent-{width}"))
    delete(spark, path)
    return materialise(reduce(DataFrame.unionByName, found), "frequent"), totals


def _words(phrase: str = "phrase"):
    return F.split(phrase, " ")


def _join(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, width, a, l, r, score) of phrases of two words and more, by their lowest-scoring cut. Products are decimals of 38 places.

    The parts of all cuts are looked up in one join, as (part, cut, side) of a phrase.
    """
    words, width = _words(), F.col("width")
    part = lambda k, side, start, n: F.struct(k.alias("k"), F.lit(side).alias("side"), _join(words, start, n).alias("part"))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), width - 1), lambda k: F.array(part(k, "l", F.lit(1), k), part(k, "r", k + 1, width - k))))
    asked = frequent.filter("width > 1").select("lang", "phrase", "width", F.col("f").alias("a"), F.explode(parts).alias("p")).select("lang", "phrase", "width", "a", "p.*")
    told = asked.join(frequent.select("lang", F.col("phrase").alias("part"), F.col("f").alias("n")), ["lang", "part"])
    side = lambda s: F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("k", "n"))))
    both = told.groupBy("lang", "phrase", "width", "a").agg(side("l").alias("ls"), side("r").alias("rs"))
    score = lambda k: F.struct(F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * F.col("a").cast("decimal(19,0)"), (F.col("ls")[k] + F.col("rs")[k]).cast("decimal(20,0)")).alias("score"), k.alias("k"), F.col("ls")[k].alias("l"), F.col("rs")[k].alias("r"))
    least = F.array_min(F.transform(F.sequence(F.lit(1), width - 1), score))
    return both.withColumn("m", least).select("lang", "phrase", "width", "a", "m.l", "m.r", "m.score")


def absorbed(frequent: DataFrame, share: int = ABSORBS) -> DataFrame:
    """(lang, phrase) of phrases within a longer frequent one that has at least ``share`` per cent of their occurrences."""
    words, width = _words(), F.col("width")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), width - 1), lambda n: F.transform(F.sequence(F.lit(1), width - n + 1), lambda i: _join(words, i, n))))
    longest = frequent.filter("width > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return frequent.filter("width > 1").join(longest, ["lang", "phrase"]).filter(F.lit(100) * wide("most") >= F.lit(share) * wide("f")).select("lang", "phrase")


def mine(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    frequent, totals = frequencies(docs, least, most_words)
    left = scored(frequent).join(absorbed(frequent), ["lang", "phrase"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

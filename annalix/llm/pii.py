"""Personal data: base expressions, and further spans chosen by boosted trees from wide candidates.

High-recall generators propose overlapping spans of four kinds (obfuscated addresses, numbers in odd
groupings, addresses with more or fewer parts). A candidate's format and the characters and words around
it are its features. The trees are fitted on a bounded sample of distinct texts: base matches and rewritten
forms of them, with other names and hosts, are positive; broken forms (wrong check digit, parts out of
range, too few digits) and candidates of no known form are negative, but not parts of numbers that run together. Half of the texts, with all that was
made of them, are kept from the trees; there each kind gets its own threshold, the least score that keeps
``precision``. Of overlapping spans the likelier stays; base spans always stay.

Defined cases: null counts as empty, with no spans. Without any base match in the sample nothing is
added. Offsets are code points. Repeated rows get equal spans. An address part of any length is read as
a number, leading zeros included.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import boosting
from ._shared import arrow_batches, share, tidy

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _octet(digits: str) -> bool:
    short = digits.lstrip("0") or "0"
    return len(short) <= 3 and int(short) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the expression finds them: a run of local characters up to each @, not before the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start and then kind as listed."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


#: Signs and words for @, and for a dot of the host; fixed values: a local part has 64 characters at most, a label 63.
_AT = re.compile(r"[\[({<]\s?at\s?[\])}>]|\(@\)|\[@\]| @ ?|(?<=[A-Za-z0-9])[ _-]at[ _-](?=[A-Za-z0-9])", re.I)
_MAYBE_AT = re.compile("at[ _\\-\\])}>]", re.I)
_LOCAL_PART = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?\Z")
_HOST = re.compile(r" ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<]\s?dot\s?[\])}>] ?|[ _-]dot[ _-])[A-Za-z0-9]{1,63}(?:-[A-Za-z0-9]+)*)+", re.I)
_SPELLED = re.compile(r"[^A-Za-z]dot[^A-Za-z]", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[ ().,/:_-]{0,3}[0-9])*(?![0-9A-Za-z])")
_GROUPS = re.compile(r"[0-9]+")
#: Fewest and most digits of a candidate.
_CARD_DIGITS, _PHONE_DIGITS = range(12, 21), range(7, 17)


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of runs of numbers; of a run with
    more digits than any kind has, all windows that fit of whole groups, those after the first of two digits or more."""
    for m in _NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        if n < _CARD_DIGITS.stop:
            yield m.start(), m.end(), n
            continue
        groups = [(g.start(), g.end()) for g in _GROUPS.finditer(text, m.start(), m.end())]
        for i, (start, _) in enumerate(groups):
            n = 0
            for k in range(i, min(i + _CARD_DIGITS.stop, len(groups))):
                a, b = groups[k]
                n += b - a
                if n >= _CARD_DIGITS.stop or k > i and b - a < 2:
                    break
                yield start, b, n


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all that might be personal data; spans overlap, and one span may have several kinds."""
    out = []
    if "@" in text or _MAYBE_AT.search(text):
        for m in _AT.finditer(text):
            left, right = _LOCAL_PART.search(text, max(0, m.start() - 66), m.start()), _HOST.match(text, m.end())
            bare = m[0][0] in " _-" and "@" not in m[0]  # a plain word: the dots must be words as well
            if left and right and (not bare or _SPELLED.search(text, m.end(), right.end())):
                out.append((left.start(), right.end(), 0))
    if _DIGIT.search(text):
        for a, b, n in _numbers(text):
            if n >= 4 and (text.count(".", a, b) >= 3 or text.count(":", a, b) >= 3):
                out.append((a, b, 1))
            if n in _CARD_DIGITS:
                out.append((a, b, 2))
            if n in _PHONE_DIGITS:
                out.append((a, b, 3))
    return out


_HINTS = (re.compile(r"mail|write|contact", re.I), re.compile(r"\bip\b|addr|host|server", re.I), re.compile(r"card|visa|credit|pay", re.I), re.compile(r"tel|phone|call|fax|mobil", re.I))


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    span = text[start:end]
    groups = _GROUPS.findall(span)
    digits = "".join(groups)
    seps = re.sub(r"[0-9A-Za-z]", "", span)
    around = text[max(0, start - 32) : start] + " | " + text[end : end + 32]
    before, after = text[start - 1 : start], text[end : end + 1]
    sizes = [len(g) for g in groups] or [0]
    return [
        *(float(kind == k) for k in range(4)), *(float(bool(h.search(around))) for h in _HINTS),
        len(span), len(digits), len(groups), max(sizes), min(sizes), float(len(set(sizes)) == 1), len(seps), len(set(seps)),
        float(luhn(digits)) if digits else 0.0, max(map(int, groups), default=0) if max(sizes) < 10 else 1e10, seps.count("."), seps.count(":"), seps.count(" "), seps.count("-"), seps.count("("), seps.count("/"), seps.count(","),
        float(span[:1] == "+"), float(digits[:2] == "00"), float(int(digits[0]) if digits else -1), float(bool(_SPELLED.search(span))), float("@" in span), float("at" in span.lower()), float(seps.count("_")),
        float(before.isalnum()), float(after.isalnum()), float(before in ".,:/#=-_$€£"), float(after in ":/#=-_%$€£"), sum(c.isalpha() for c in span),
    ]


#: Syllables and endings of made-up names and hosts.
_SYLLABLES = ("ka", "mer", "lo", "tin", "ba", "sol", "pre", "vi", "dan", "ry", "ne", "cho", "ul", "gra", "win", "ost")
_ENDINGS = ("com", "org", "net", "de", "fr", "es", "io", "edu", "info", "co.uk", "com.br", "ac.jp")


def _word(draw: random.Random) -> str:
    return "".join(draw.choice(_SYLLABLES) for _ in range(draw.randint(1, 4)))


def _address(draw: random.Random) -> tuple[str, str]:
    name = _word(draw) + draw.choice(["", ".", "_", "-", "+"]).join(["", _word(draw)]) * draw.randint(0, 1) + draw.choice(["", "", str(draw.randint(1, 99))])
    host = ".".join([*(_word(draw) + draw.choice(["", "-" + _word(draw), str(draw.randint(1, 9))]) for _ in range(draw.randint(1, 3))), draw.choice(_ENDINGS)])
    return name, host


def _cased(s: str, draw: random.Random) -> str:
    return draw.choice([s, s, s.upper(), s.title()])


def _grouped(digits: str, sizes: list[int], sep: str) -> str:
    at = [sum(sizes[:k]) for k in range(len(sizes))]
    return sep.join(digits[a : a + n] for a, n in zip(at, sizes))


def run_together(text: str) -> list[tuple[int, int]]:
    """Matches with too many digits: several numbers in one, of which any may be personal data, so that none is a negative example."""
    out = [(m.start(), m.end()) for m in _PHONE.finditer(text) if sum(c.isdigit() for c in m[0]) > 15]
    return out + [(m.start(), m.end()) for m in _CARD.finditer(text) if sum(c.isdigit() for c in m[0]) > 19]


def _rewritten(kind: int, span: str, draw: random.Random) -> tuple[str, str]:
    """A form of a base match that the base expressions miss, and a broken form."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        name, _, host = span.partition("@")
        if draw.random() < 0.8:
            name, host = _address(draw)
        a, d = draw.choice([("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), ("[@]", "."), (" at ", " dot "), ("_at_", "_dot_"), (" [at] ", "."), ("{at}", "{dot}"), (" @ ", ".")])
        return _cased(name + a + host.replace(".", d), draw), f"{name} {a} {draw.choice(['the', 'last', 'noon'])}"
    if kind == 1:
        parts = span.split(".") if draw.random() < 0.3 else [str(draw.randint(0, 255)) for _ in range(4)]
        bad = parts[:]
        bad[draw.randrange(4)] = str(draw.randint(256, 999))
        return draw.choice([" . ", ". ", " .", ":"]).join(parts), draw.choice([".".join(bad), ".".join([*parts, "7"])])
    if kind == 2:
        sep = draw.choice([".", "/", " - ", "  ", "_", ","])
        quads = [4] * (len(digits) // 4) + [len(digits) % 4] * (len(digits) % 4 > 0)
        bad = digits[:-1] + str((int(digits[-1]) + draw.randint(1, 9)) % 10)
        return _grouped(digits, quads, sep), draw.choice([bad, _grouped(bad, quads, sep), _grouped(bad, quads, " ")])
    local = "".join(draw.choice("23456789") if k in (0, 3) else draw.choice("0123456789") for k in range(10))
    good = draw.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "00" + digits[:-10] + " {} {} {}", "{} {} {}", "({}) {} {}", "1-{}-{}-{}", "+1_{}_{}_{}"]).format(local[:3], local[3:6], local[6:])
    return good, draw.choice([f"{draw.randint(1900, 2030)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}", f"{draw.randint(1, 999)},{digits[:3]},{digits[3:6]}", digits[:8], f"{local[:2]}:{local[2:4]}:{local[4:6]}"])


#: Candidates judged at a time.
JUDGED = 1 << 14


@dataclass(frozen=True)
class Model:
    trees: boosting.Boosted | None
    cut: tuple[float, float, float, float]

    def added(self, texts: list[str], base: list[list[tuple[int, str, int]]]) -> list[list[tuple[int, str, int]]]:
        """Chosen spans that overlap no base span of their text, the likeliest first. A text's characters are marked once they are taken."""
        out: list[list[tuple[int, str, int]]] = [[] for _ in texts]
        if self.trees is None:
            return out
        where, rows, likely = [], [], []
        taken: list[bytearray | None] = [None] * len(texts)

        def judge() -> None:
            if rows:
                likely.append(self.trees.predict(np.array(rows)))
                rows.clear()

        for i, (text, own) in enumerate(zip(texts, base)):
            for a, b, k in candidates(text):
                if taken[i] is None:
                    taken[i] = bytearray(len(text))
                    for start, _, end in own:
                        taken[i][start:end] = b"\1" * (end - start)
                if taken[i].find(1, a, b) < 0:
                    where.append((i, a, b, k))
                    rows.append(features(text, a, b, k))
                    if len(rows) >= JUDGED:
                        judge()
        judge()
        p = np.concatenate([np.zeros(0), *likely])
        for j in np.argsort(-p, kind="stable").tolist():
            i, a, b, k = where[j]
            if p[j] >= self.cut[k] and taken[i].find(1, a, b) < 0:
                out[i].append((a, KINDS[k], b))
                taken[i][a:b] = b"\1" * (b - a)
        return out


def train(texts: list[str], precision: float = 0.98, rewrites: int = 8, seed: int = 5) -> Model:
    """Equal texts count once. A text's examples are all on one side: the trees', or the thresholds'."""
    draw = random.Random(seed)
    x, y, kinds, fold = [], [], [], []

    def example(text: str, a: int, b: int, k: int, label: int) -> None:
        x.append(features(text, a, b, k))
        y.append(label)
        kinds.append(k)
        fold.append(held)

    for text in sorted(set(texts)):
        held = draw.random() < 0.5
        base = base_spans(text)
        for start, kind, end in base:
            k = KINDS.index(kind)
            if k:
                example(text, start, end, k, 1)
            forms = [f for _ in range(rewrites) for f in zip(_rewritten(k, text[start:end], draw), (1, 0))]
            for form, label in forms:
                other = text[max(0, start - 40) : start] + form + text[end : end + 40]
                lo = min(start, 40)
                for a, b, c in candidates(other):
                    if lo <= a and b <= lo + len(form):  # those that reach further are partly of what stands beside it
                        example(other, a, b, c, label if c == k else 0)
        known = [(start, end) for start, _, end in base] + run_together(text)
        for a, b, k in candidates(text):
            if not any(a < end and start < b for start, end in known):
                example(text, a, b, k, 0)
    x, y, kinds, fold = np.array(x), np.array(y), np.array(kinds), np.array(fold, bool)
    if not len(y) or y.min() == y.max() or fold.all():
        return Model(None, (1.1,) * 4)
    trees = boosting.fit(x[~fold], y[~fold])
    p = trees.predict(x)
    cut = []
    for k in range(4):
        own = fold & (kinds == k)
        cut.append(max(0.5, boosting.threshold(p[own], y[own], precision)) if own.any() else 1.1)
    return Model(trees, tuple(cut))


def fit(docs: DataFrame, most_texts: int = 3000, most_bytes: int = 20_000) -> Model:
    """On at most ``most_texts`` distinct texts with a digit or an @, of at most ``most_bytes``: those with the least hashes, however often each is repeated."""
    some = docs.filter(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= most_bytes)).select("text", F.xxhash64("text").alias("h"))
    least = [r["h"] for r in some.select("h").distinct().orderBy("h").limit(most_texts).collect()]
    if not least:
        return train([])
    rows = some.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(most_texts).collect()
    return train([r["text"] for r in rows])


def as_text(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every text. Counts are of base spans."""
    arrow_batches(docs.sparkSession)
    shared = share(docs.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = shared.value.added(texts, base)
            both = [sorted(o + m, key=lambda s: (s[0], KINDS.index(s[1]))) for o, m in zip(base, more)]
            counts = [pa.array([sum(s[1] == k for s in o) for o in base], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(as_text(o).encode()).hexdigest() for o in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, sha, pa.array(map(as_text, both), pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every span replaced by its kind in brackets; null stays null."""
    arrow_batches(docs.sparkSession)
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            whole = [t or "" for t in texts]
            base = [base_spans(t) for t in whole]
            for i, (own, more) in enumerate(zip(base, shared.value.added(whole, base))):
                done, parts = 0, []
                for a, k, e in sorted(own + more):
                    if a >= done:
                        parts += [whole[i][done:a], f"[{k}]"]
                    done = max(done, e)
                if parts:
                    texts[i] = "".join(parts) + whole[i][done:]
            yield b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, b.schema.field("text").type))

    return docs.mapInArrow(tidy(run), docs.schema)

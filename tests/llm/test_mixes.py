"""Filter audit, phrases and source mixes against brute force, and on tables of awkward kinds."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from annalix.llm import collocations, filter_audit, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LABELS = "doc_id long, quality int, toxic int"


# --- op11


def brute_masks(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        out.append(
            (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
            + 8 * bool(re.search(r"[#$%&*|]", t)) + 16 * (i is not None and i > least[t])
        )
    return out


def brute_audit(rows, labels):
    masks, out = brute_masks(rows), {}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for (i, _, source), m in zip([(r[0], r[1], r[3]) for r in rows], masks):
        parts[source or ""].append((m, i in good, i in toxic))
    for part, docs in parts.items():
        gains = Counter()
        for order in permutations(range(5)):
            name = "".join("ABCDE"[k] for k in order)
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0] >> f & 1]
                left = [d for d in left if not d[0] >> f & 1]
                gains[f] += len(gone)
                out[part, name, step] = [
                    len(left), len(gone), sum(d[0] >> f & 1 for d in docs) - len(gone), sum(d[0] == 1 << f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f,
                ]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = gains[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}


def test_op11_odd_documents(spark):
    labels = [(5, 1, 0), (5, 0, 1), (18, 1, 1), (None, 1, 1), (0, None, 1), (2, 1, None), (99, 1, 1)]
    rows = odd.rows()
    want = brute_audit([tuple(r) for r in rows], labels)
    assert audited(odd.docs(spark), spark.createDataFrame(labels, LABELS)) == want
    assert len(want) == 600 * len({r[3] or "" for r in rows})


def test_op11_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert audited(odd.empty(spark), none) == {}
    assert {k: v[:2] for k, v in audited(spark.createDataFrame([(1, "x", None, None)], "doc_id long, text string, lang string, source string"), none).items() if k[1:] == ("ABCDE", 1)} == {("", "ABCDE", 1): (0, 1)}


def test_op11_copies_over_many_tasks_and_a_small_memory(spark, monkeypatch):
    """A hot text in all tasks, repeated ids, and a memory that holds a few texts: every id but the least is found."""
    monkeypatch.setattr(filter_audit, "REMEMBERED", 2000)
    rows = [(k % 900, "hot text" if k % 3 else f"text {k % 50}") for k in range(1200)] + [(None, "hot text"), (7, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    got = {i for i, _ in filter_audit.copies(docs, 5).collect()}
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    assert got == {i for i, ts in texts.items() if i is not None and any(i > least[t] for t in ts)}


def test_op11_texts_of_one_fingerprint_are_told_apart():
    routed = [(5, (b"one", 4)), (5, (b"two", 2)), (5, (b"one", 3)), (5, (b"two", 9)), (5, (None, 11))]
    assert sorted(filter_audit._not_least(routed)) == [(4, 5), (9, 5), (11, 5)]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_op11_long_texts_in_slices(monkeypatch, size):
    texts = [odd.PROSE, " lead", "x" * 300, "a b  c\n\nd " * 40, "AB cd", "é ü " * 50 + "#", ""]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = filter_audit.masks(np.frombuffer(data, np.uint8), offsets)
    monkeypatch.setattr(filter_audit, "SLICE", size)
    monkeypatch.setattr(filter_audit.pieces, "__defaults__", (size,))
    assert (filter_audit.masks(np.frombuffer(data, np.uint8), offsets) == whole).all()
    assert [int(m) for m in whole] == [m & 15 for m in brute_masks([(None, t) for t in texts])]


# --- op12


def brute_phrases(rows, least, most=4, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, most + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            cuts = [(2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            inside = (q for q in cand if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * cand[q] >= 80 * a for q in inside):
                rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_op12_random_texts(spark, monkeypatch, block):
    """Overlapping repeats, pieces, tabs, folded letters, null languages, over one block and over many."""
    draw = np.random.default_rng(3)
    words = ["a", "B", "b", "ab", "été", "Zz", "tick", "日本"]
    rows = [("".join(draw.choice(words, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]) + draw.choice([" ", "\t", "  ", ". ", "\n", "\x0b"], p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05]) for _ in range(60)), draw.choice(["en", "fr"]) if k % 5 else None) for k in range(60)]
    rows += [("a a a a a a", "en"), (None, "en"), ("", None), ("...", "fr"), ("x" * 3000, "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, phrase int").repartition(3)
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    for least, top in ((5, 2000), (3, 4)):
        assert sorted(map(tuple, collocations.mine(docs, least=least, top=top).collect())) == brute_phrases(rows, least, top=top)


def test_op12_slices_and_blocks_lose_nothing(monkeypatch):
    text = ("one Two, three\tfour. five  " * 50).encode()
    whole = [(t.tolist(), n) for t, n, _ in collocations._blocks([("en", text)])]
    monkeypatch.setattr(collocations, "SLICE", 9)
    assert [(t.tolist(), n) for t, n, _ in collocations._blocks([("en", text)])] == whole
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 3)
    parts = [[n[k].decode("latin1") for k in t] for t, n, _ in collocations._blocks([("en", b"a b. c"), ("fr", b"a b"), ("en", b"c")])]
    assert parts == [["a", "b", "ÿ", "c", "ÿ"], ["a", "b", "ÿ"], ["c", "ÿ"]]


def test_op12_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_001
    f = spark.createDataFrame([("en", "a", 1, big * 3), ("en", "b", 1, big + 2), ("en", "a b", 2, big), ("en", "a b c", 3, big * 4 // 5), ("en", "b c", 2, big * 4 // 5), ("en", "c", 1, big)], "lang string, phrase string, width int, f long")
    got = {r.phrase: r for r in collocations.scored(f).collect()}
    assert got["a b"].score == 2_000_000 * big // (4 * big + 2)
    assert got["a b c"].score == min(2_000_000 * (big * 4 // 5) // (3 * big + big * 4 // 5), 2_000_000 * (big * 4 // 5) // (2 * big))
    assert {r.phrase for r in collocations.absorbed(f).collect()} == ({"a b"} if 100 * (big * 4 // 5) >= 80 * big else set()) | {"b c"}


def test_op12_odd_and_empty(spark):
    rows = [(r[1], r[2]) for r in odd.rows()]
    assert sorted(map(tuple, collocations.mine(odd.docs(spark), least=30).collect())) == brute_phrases(rows, 30)
    assert collocations.mine(odd.empty(spark)).collect() == []


# --- op13


def brute_targets(sizes, weights, most=3.0, total=None):
    """Round by round: what is above its cap is cut, and the excess is shared by weight among the others."""
    total = sum(sizes.values()) if total is None else total
    free, capped = {k for k in sizes if weights[k] > 0}, {}
    while True:
        left, w = total - sum(capped.values()), sum(weights[k] for k in free)
        level = {k: left * weights[k] / w for k in free}
        over = [k for k in free if level[k] >= most * sizes[k]]
        if not over:
            return {**{k: 0.0 for k in sizes}, **capped, **level}
        for k in over:
            capped[k] = most * sizes[k]
            free.discard(k)
        if not free:
            return {**{k: 0.0 for k in sizes}, **capped}


@pytest.mark.parametrize("seed", range(3))
def test_op13_targets_are_those_of_rounds(spark, seed):
    draw = np.random.default_rng(seed)
    sizes = {(None if k == 0 else f"s{k:03}"): int(draw.choice([0, 1, 7, 100, 10_000, 200_000])) for k in range(60)}
    weights = {k: float(draw.choice([0, 0.5, 1, 2, 7.25])) for k in sizes}
    table = spark.createDataFrame([(k, v, 4, weights[k]) for k, v in sizes.items()], "source string, source_size long, source_bytes int, weight double")
    for most in (3.0, 1.5):
        got = {r.source: r for r in mixing.rates(table, most).collect()}
        want = brute_targets(sizes, weights, most)
        for k, r in got.items():
            assert r.target == pytest.approx(want[k], rel=1e-9, abs=1e-9)
            assert r.rate <= most and (r.rate == 0 if not sizes[k] else r.rate == pytest.approx(r.target / sizes[k]))
        assert len(got) == len(sizes)


def test_op13_weights_in_turn_by_code_point(spark):
    names = ["b", "a", None, "Z", "é", "", "\U00010000", "￿"]
    table = spark.createDataFrame([(n, 1, 1) for n in names], "source string, source_size long, source_bytes int")
    got = {r.source: r.weight for r in mixing.cyclic_weights(table, (1, 2, 3)).collect()}
    order = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None]
    assert got == {n: k % 3 + 1 for k, n in enumerate(order)}


@pytest.mark.parametrize("broadcast", [0, mixing.BROADCAST_BYTES])
def test_op13_documents_come_as_often_as_their_rate(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", broadcast)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 9).cast("string"))).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.lit(1).alias("rate"), F.lit("x").alias("_row"))
    rated = mixing.rates(mixing.cyclic_weights(mixing.source_sizes(docs), (1, 2, 3)))
    rows = mixing.taken(docs, rated).collect()
    assert len(rows) == 6000 and all(r.size == r.doc_id % 40 and r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in rows)
    sums = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        s = "n" if r.doc_id % 3 == 0 else "hot" if r.doc_id % 3 == 1 else r.doc_id % 9
        sums[s][0] += r.taken
        sums[s][1] = r.target
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
    for taken, target, _ in sums.values():
        assert abs(taken - target) < 0.1 * target
    assert sorted(map(tuple, mixing.taken(docs.repartition(5), rated).collect())) == sorted(map(tuple, rows))
    out = mixing.mix(docs, rated)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_op13_is_native(spark):
    docs = odd.docs(spark)
    plan = mixing.taken(docs, mixing.rates(mixing.cyclic_weights(mixing.source_sizes(docs), (1, 2, 3))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_op13_odd_and_empty(spark):
    docs = odd.docs(spark)
    rated = mixing.rates(mixing.cyclic_weights(mixing.source_sizes(docs), (1, 2, 3)))
    got = mixing.taken(docs, rated).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in odd.rows())
    assert {r.rate for r in rated.collect()} <= {0.0} | {r.rate for r in rated.collect() if r.source_size}
    none = odd.empty(spark)
    assert mixing.taken(none, mixing.rates(mixing.cyclic_weights(mixing.source_sizes(none), (1, 2, 3)))).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    rated = mixing.rates(mixing.cyclic_weights(mixing.source_sizes(blank), (1, 2, 3)))
    assert [(r.size, r.target, r.taken) for r in mixing.taken(blank, rated).collect()] == [(0, 0.0, 0)] * 2

"""The operators against brute force on the driver's small tables and on hand-made documents."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import MID, SMALL
from oracle import connect, rows
from pyspark.sql import functions as F

from annalix.llm import _shared, components, decontaminate, jaccard_join, language_id, line_dedup, packing, queries, token_counts
from annalix.llm._shared import held_out, scratch, table
from annalix.llm._text import shingle_column

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    return {k: e.ids for k, e in zip(docs, tok.encode_batch([t or "" for t in docs.values()], add_special_tokens=False))}


def run(spark, name, sf_dir=SMALL):
    return queries.queries()[name](spark, sf_dir).toPandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf_dir", [SMALL, MID])
def test_same_as_sql(spark, name, sf_dir):
    assert rows(run(spark, name, sf_dir)) == rows(connect(sf_dir).execute(queries.oracle_sql()[name]).df())


def test_op1_held_out_accuracy(spark):
    got = run(spark, "op1_language_id", MID).set_index("doc_id")
    lang = {r["doc_id"]: r["lang"] for r in table(spark, MID, "documents").select("doc_id", "lang").collect()}
    held = got[got["held_out"]]
    assert 0.2 < len(held) / len(got) < 0.5
    assert all(h == (zlib.crc32(str(k).encode()) % 3 == 1) for k, h in got["held_out"].items())
    assert np.mean([lang[k] == p for k, p in held["lang_pred"].items()]) > 0.98
    assert got["score"].between(0, 1).all()


def ngrams(text):
    """Hashed n-grams of a text, counted in a dictionary."""
    run = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    padded, counts = f" {' '.join(run)} ", Counter()
    for n in (1, 2, 3) if run else ():
        for i in range(len(padded) - n + 1):
            h = 0
            for c in padded[i : i + n]:
                h = ((h + ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            counts[h % language_id.BUCKETS] += 1
    return counts


def test_op1_scores_are_naive_bayes_of_counted_ngrams(spark, docs):
    """The model against counts of the learned rows in dictionaries, and every prediction against the model."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, SMALL, "documents").filter(~held_out()).collect()]
    model = language_id.fit(table(spark, SMALL, "documents"), ~held_out())
    assert model.langs == tuple(sorted({r[2] for r in rows}))
    for k, lang in enumerate(model.langs):
        counts = np.full(language_id.BUCKETS, 0.3)
        for text in {r[1] for r in rows if r[2] == lang}:
            for bucket, n in ngrams(text).items():
                counts[bucket] += n
        assert model.log_prob[:, k] == pytest.approx(np.log(counts / counts.sum()), rel=1e-5)
        assert model.prior[k] == pytest.approx(np.log(sum(r[2] == lang for r in rows) / len(rows)))
    log_prob, prior = model.log_prob.astype(float), model.prior
    for text in [*list(docs.values())[:60], "a", "Ünïcödé ñandú 日本語", "", None, "123 !?", "a1b2 c3", " . a. ", "ends here.\n"]:
        counts, found = ngrams(text), list(language_id.features([text]))
        assert [dict(zip(at.tolist(), n.tolist())) for _, at, n in found] == ([dict(counts)] if counts else [])
        names, scores = model.predict([text])
        if not found:
            assert names == ["und"] and scores[0] == 0
            continue
        joint = [prior[k] + sum(c * log_prob[b, k] for b, c in counts.items()) for k in range(len(model.langs))]
        top = max(joint)
        assert joint[model.langs.index(names[0])] >= top - 1e-6 * abs(top)
        assert scores[0] == pytest.approx(1 / sum(np.exp(max(j - top, -700)) for j in joint), rel=1e-3, abs=1e-6)


def test_op1_pieces_lose_no_ngram(monkeypatch):
    texts = ["one two.  three ΟΔΟΣ ΟΔΟΣ, four" * 3, "...a", "a...", ". . b . .", "abc", "Σ" * 9]
    for size in (1, 2, 3, 5, 8):
        monkeypatch.setattr(language_id, "PIECE", size)
        for text in texts:
            [(_, at, n)] = language_id.features([text])
            assert dict(zip(at.tolist(), n.tolist())) == dict(ngrams(text)), (size, text)


def test_op1_learns_from_different_texts_however_often_they_come(spark):
    """Six languages of one text 30,000 times each, and one language with a hot text and a thousand others."""
    words = {f"l{k}": " ".join(chr(0x4E00 + 50 * k + j) * 2 for j in range(9)) for k in range(6)}
    hot = spark.range(180_000).select("id", F.element_at(F.array(*map(F.lit, sorted(words))), (F.col("id") % 6 + 1).cast("int")).alias("lang"))
    text = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in words.items()])
    model = language_id.fit(hot.withColumn("text", text), F.lit(True))
    assert model.langs == tuple(sorted(words))
    assert model.predict(list(words.values()))[0] == list(words)
    mixed = hot.select(F.lit("aa").alias("lang"), F.when(F.col("id") < 1000, F.concat(F.lit("other "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))).otherwise("hot text").alias("text"))
    once = mixed.dropDuplicates(["text"])
    assert (language_id.fit(mixed, F.lit(True), per_lang=100).log_prob == language_id.fit(once, F.lit(True), per_lang=100).log_prob).all()


def test_op1_learns_every_language_and_breaks_ties_by_name(spark):
    rows = [(k, "".join(chr(0x4E00 + 7 * k + j % 7) for j in range(30)), f"l{k:03}") for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d, F.lit(True))
    assert len(model.langs) == 400
    assert [r["lang_pred"] for r in language_id.identify(d, model).orderBy("doc_id").collect()] == [r[2] for r in rows]
    with pytest.raises(ValueError):
        language_id.fit(d, F.lit(True), model_bytes=100 * 4 * language_id.BUCKETS)
    same = spark.createDataFrame([(1, "abc def", "zz"), (2, "abc def", "aa")], "doc_id long, text string, lang string")
    assert language_id.fit(same, F.lit(True)).predict(["abc def", "qqq"])[0] == ["aa", "aa"]


def test_op2_counts(spark, docs, ids):
    got = run(spark, "op2_token_counts")
    assert len(got) == len(docs)
    for r in got.itertuples():
        n = len(ids[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_op2_encodes_only_misses(spark, tmp_path):
    cache, d = str(tmp_path / "cache"), table(spark, SMALL, "documents")
    path = queries.tokenizer_path()
    first = token_counts.count_tokens(d.filter("doc_id % 2 = 0"), path, cache).count()
    stored = spark.read.parquet(cache).count()
    token_counts.count_tokens(d.filter("doc_id % 2 = 0"), path, cache)
    assert spark.read.parquet(cache).count() == stored <= first
    whole = token_counts.count_tokens(d, path, cache).toPandas()
    assert whole["n_tokens"].notna().all() and spark.read.parquet(cache).count() > stored


def key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def dropped(texts: list[str | None], least: int = 10) -> list[tuple[int, int, str]]:
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def lines_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


TWELVE = [f"own {i}\n  Shared LINE\t\nrest {i}" for i in range(12)] + ["shared line", None, "", "lonely"]


@pytest.mark.parametrize("filter_bytes", [32 << 20, 0])
def test_op3_both_paths(spark, filter_bytes):
    s = line_dedup.Settings(filter_bytes=filter_bytes, shards=3, shard_keys=1, probe_lines=5)
    d = lines_of(spark, TWELVE)
    store = line_dedup.LineStore(spark, scratch(spark, "t"), s).insert(d)
    assert isinstance(store.filters(), line_dedup.Sharded if filter_bytes == 0 else line_dedup.Filters)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in store.report(d).collect()}
    assert [got[i] for i in range(len(TWELVE))] == dropped(TWELVE)
    clean = {r["doc_id"]: r["text"] for r in store.clean(d).collect()}
    assert clean[0] == "own 0\nrest 0" and clean[13] is None and clean[12] == ""


def test_op3_exceptions_are_not_reported():
    draw = np.random.default_rng(4)
    for n in (1, 3, 50):
        keys = np.zeros(60, line_dedup.KEY)
        keys["hi"], keys["lo"] = draw.integers(1, 2**62, (2, 60))
        f = line_dedup.Filters({0: line_dedup.build_filter(keys["hi"].astype(np.uint64), keys["lo"].astype(np.uint64))}, 1, np.sort(keys[:n]))
        assert f.has(keys).tolist() == [False] * n + [True] * (60 - n)
        assert line_dedup.among(keys, keys[:n]).tolist() == [True] * n + [False] * (60 - n) and not line_dedup.among(keys, keys[:0]).any()


def test_op3_probe_of_a_shard_leaves_exceptions_out():
    draw = np.random.default_rng(3)
    hi, lo = draw.integers(1, 2**62, (2, 60)).astype(np.int64)
    f = line_dedup.build_filter(hi[:40].view(np.uint64), lo[:40].view(np.uint64))
    schema = pa.schema([("shard", pa.int64()), ("salt", pa.int64()), ("kind", pa.int32()), ("buckets", pa.int64()), ("data", pa.binary()), ("text_key", pa.binary()), ("hi", pa.int64()), ("lo", pa.int64())])
    rows = [(1, 0, 0, f.buckets, f.table.tobytes(), None, None, None)]
    rows += [(1, 0, 1, None, None, None, hi[k], lo[k]) for k in range(5)]
    rows += [(1, 0, 2, None, None, b"t", hi[k], lo[k]) for k in range(60)]
    rows += [(2, 0, 2, None, None, b"t", hi[k], lo[k]) for k in range(60)]  # a shard without a filter
    batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    for step in (1, 7, 1000):
        parts = [batch.slice(k, step) for k in range(0, len(rows), step)]
        got = [(r["hi"], r["lo"]) for b in line_dedup._probe(iter(parts)) for r in b.to_pylist()]
        assert got == list(zip(hi[5:40].tolist(), lo[5:40].tolist()))


def test_op3_shards_without_a_limit(spark):
    """Filters beyond what is broadcast give what brute force gives, also where a line is in all documents."""
    texts = [f"everywhere\nline {k % 30}\n{'x' * (k % 7)}\nown {k}" for k in range(400)]
    store = line_dedup.LineStore(spark, scratch(spark, "t"), line_dedup.Settings(filter_bytes=0, shards=2, shard_keys=8, probe_lines=50)).insert(lines_of(spark, texts))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in store.report(lines_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == dropped(texts)
    assert store.below_zero().isEmpty() and store.delete(lines_of(spark, ["never there"])).below_zero().count() == 1


def test_op3_is_reversible(spark):
    d = lines_of(spark, TWELVE)
    store = line_dedup.LineStore(spark, scratch(spark, "t")).insert(d)
    filters = store.filters()
    probe = line_dedup.line_keys(b"shared line\nlonely", store.settings)[1]
    assert filters.has(probe).tolist() == [True, False]
    filters = store.advance(filters, d.filter("doc_id < 5"), remove=True)
    assert filters.has(probe).tolist() == [False, False]
    filters = store.advance(filters, d.filter("doc_id < 5"))
    assert filters.has(probe).tolist() == [True, False]
    assert {r["n"] for r in store.delete(d).counts().collect()} == set()


def test_cuckoo_filter():
    draw = np.random.default_rng(1)
    hi, lo = draw.integers(1, 2**63, (2, 5000)).astype(np.uint64)
    f = line_dedup.build_filter(hi, lo)
    assert f.has(hi, lo).all()
    assert f.delete(hi[:2000], lo[:2000]) == 2000
    assert not f.has(hi[:2000], lo[:2000]).any() and f.has(hi[2000:], lo[2000:]).all()
    assert not f.has(lo, hi).any()


def check_packing(got, ids_with_end, cap=packing.Capacity()):
    pieces = defaultdict(list)
    for r in got.itertuples():
        x = ids_with_end[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
    for k, own in pieces.items():
        at = 0
        for start, n in sorted(own):
            assert start == at and n > 0
            at += n
        assert at == len(ids_with_end[k])
    assert set(pieces) == set(ids_with_end)
    padding = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = (g["offset"] + g["length"]).tolist()
        assert g["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= cap.tokens and len(g) <= cap.segments
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else cap.tokens - ends[-1]
    return padding


def test_op4_round_trip(spark, ids):
    assert check_packing(run(spark, "op4_packing"), {k: [*x, 1] for k, x in ids.items()}) == 0


def test_packer_respects_every_limit():
    draw = np.random.default_rng(2)
    cap = packing.Capacity(256, 4, 100)
    tokens = draw.integers(1, 700, 300)
    loss = (tokens * draw.random(300)).astype(np.int64)
    p = packing.Packer(cap)
    p.add(np.arange(300), tokens, loss.copy())
    pieces = p.pack(0)
    used, seen = defaultdict(lambda: np.zeros(3, np.int64)), defaultdict(int)
    for owner, start, n, seq, _ in pieces:
        assert start == seen[owner]
        seen[owner] += n
        used[seq] += (n, 1, max(0, min(n, loss[owner] - start)))
    assert all((u <= (cap.tokens, cap.segments, cap.loss)).all() for u in used.values())
    assert dict(seen) == dict(enumerate(tokens))


def test_op4_tiny_documents_need_no_padding(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    texts = [(None, "", "a", "the", "the end")[n % 5] for n in range(3000)]
    got = packing.pack_documents(lines_of(spark, texts).coalesce(2), queries.tokenizer_path()).toPandas()
    assert check_packing(got, {n: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for n, t in enumerate(texts)}) == 0


def test_op4_loss_bearing_tokens_of_documents(spark, docs, ids):
    cap = packing.Capacity(256, 64, 96)
    bears = {k: (None, 0, -3, 10**9, len(ids[k]) // 2, len(ids[k]) // 7)[n % 6] for n, k in enumerate(sorted(docs))}
    d = spark.createDataFrame([(k, docs[k], b) for k, b in bears.items()], "doc_id long, text string, bearing int").coalesce(2)
    got = packing.pack_documents(d, queries.tokenizer_path(), cap=cap, loss="bearing").toPandas()
    want = {k: [*x, 1] for k, x in ids.items()}
    assert check_packing(got, want, cap) == 0
    most = {k: len(want[k]) if b is None else min(max(b, 0), len(want[k])) for k, b in bears.items()}
    got["loss"] = [max(0, min(r.length, most[r.doc_id] - r.start)) for r in got.itertuples()]
    used = got.groupby("sequence_id")["loss"].sum()
    assert used.max() == cap.loss and got["loss"].sum() == sum(most.values())


def shingle_set(text: str | None) -> set:
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_links(texts: list[str | None], least: float = 0.8) -> tuple[list[int], list[int]]:
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return links, [root(i) for i in range(len(texts))]


def near_copies(n: int = 150) -> list[str]:
    """A chain of small changes, so that far ends differ, exact copies, and texts just above and below the threshold."""
    base = [f"w{k}" for k in range(120)]
    out = []
    for k in range(n):
        own = base[:]
        for c in range(k % 40):
            own[3 * c] = f"x{c}"
        out.append(" ".join(own))
    return out + out[:30] + ["short one", "Short ONE", "", "lonely text with more than five words in it"]


@pytest.mark.parametrize("local", [0, 40, 1 << 18])
def test_components_of_chains_and_stars(spark, local):
    draw = np.random.default_rng(5)
    names = [f"{x:x}".encode() for x in draw.permutation(3000) + 10_000]
    pairs = [(k, k + 1) for k in range(0, 1200) if k % 300 != 299] + [(1300, k) for k in range(1301, 1700)] + [(2000, 2000), (2001, 2002), (2002, 2001)]
    edges = _shared.materialise(spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "a binary, b binary"), "edges")
    got = {bytes(r["node"]): bytes(r["component"]) for r in components.components(edges, local=local).collect()}
    want = {}
    for k in [*range(1200), *range(1300, 1700), 2001, 2002]:
        want.setdefault(("chain", k // 300) if k < 1200 else "star" if k < 1700 else "pair", []).append(names[k])
    assert len(got) == sum(map(len, want.values()))
    assert sorted(sorted(n for n in got if got[n] == c) for c in set(got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("settings", [jaccard_join.Settings(), jaccard_join.Settings(bucket_block=16, block=8, broadcast_bytes=0)])
def test_op6_links_and_classes(spark, settings):
    texts = near_copies()
    links, classes = brute_links(texts)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard_join.link(lines_of(spark, texts), settings).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(links, classes))
    kept = {r["doc_id"] for r in jaccard_join.one_of_each(lines_of(spark, texts), settings).collect()}
    assert kept == {i for i in range(len(texts)) if classes[i] == i}


def test_op6_on_documents(spark, docs):
    got = run(spark, "op6_jaccard_join").sort_values("doc_id")
    keys = sorted(docs)
    links, classes = brute_links([docs[k] for k in keys])
    assert got["n_links"].tolist() == links and got["class_id"].tolist() == [keys[c] for c in classes]


def test_op6_pruning_keeps_what_may_reach_the_threshold():
    tests = jaccard_join.fewest_matches(jaccard_join.Settings())
    assert [n for n, _ in tests] == list(range(16, 97, 16))
    assert all(0 < need < 0.8 * n for n, need in tests) and tests[-1][1] > 40


def test_op8_containment(spark, docs):
    items = {r["item_id"]: r["text"] for r in table(spark, SMALL, "benchmark").collect()}
    want = set()
    for i, t in items.items():
        q = shingle_set(t) if len(WORD.findall(t)) >= 5 else set()
        want |= {(d, i) for d, text in docs.items() if q and len(q & shingle_set(text)) / len(q) >= 0.8}
    got = run(spark, "op8_decontamination")
    assert set(zip(got["doc_id"], got["item_id"])) == want and want


def test_op8_short_items_in_long_documents(spark):
    words = [f"t{n}" for n in range(40_000)]
    items = [(k, " ".join(f"i{k}x{j}" for j in range(n))) for k, n in enumerate((5, 6, 9, 17, 40, 90, 300))]
    text = words[:]
    for k, (_, t) in enumerate(items):
        text[5000 * (k + 1) + k : 5000 * (k + 1) + k] = t.split()
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(words)), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, "too short"), (98, None)], "item_id long, text string")
    for part_bytes in (32 << 20, 2000):
        got = decontaminate.find(docs, bench, decontaminate.Settings(part_bytes=part_bytes)).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, k) for k, _ in items}
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_op8_many_equal_and_many_short_items(spark):
    """Equal items are one text in memory, however many; short ones are split by what they take. Ids of any type."""
    items = [(k, "one two three four five six seven") for k in range(100_000)] + [(100_000 + k, f"item {k} has six words here") for k in range(100_000)]
    docs = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "x item 77 has six words here y"), (3, "nothing of the kind is in this text")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    s = decontaminate.Settings()
    assert [len(x.ids) for x in decontaminate._parts(bench.filter("item_id < 100000"), s)] == [1]
    parts = [len(x.ids) for x in decontaminate._parts(bench, s)]
    assert sum(parts) == 100_001 and len(parts) >= 3 and max(parts) * s.item_bytes <= 1.1 * s.part_bytes
    got = decontaminate.find(docs, bench).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("item_id").alias("last")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 100_000, 99_999), (2, 1, 100_077)]
    named = spark.createDataFrame([("q-1", "one two three four five six seven"), (None, "one two three four five six seven")], "item_id string, text string")
    assert sorted(str(r["item_id"]) for r in decontaminate.find(docs, named).collect()) == ["None", "q-1"]


def test_op8_no_item_of_few_words_is_missed():
    items = [" ".join(f"i{k}x{j}" for j in range(5 + k % 3)) for k in range(3000)]
    texts = pa.array([" ".join([*(f"a{k}x{j}" for j in range(k % 37)), t, *(f"b{k}x{j}" for j in range(40))]) for k, t in enumerate(items)])
    for least in (0.8, 0.5):
        index = decontaminate.Index(list(range(len(items))), items, decontaminate.Settings(least=least))
        got = {(row, item) for row, item, *_ in index.matches(*shingle_column(texts, short=False))}
        assert got == {(k, k) for k in range(len(items))}
    index = decontaminate.Index([7, 8], ["a b c d e f", "a b c d e f"], decontaminate.Settings(least=0.5))
    assert sorted(index.matches(*shingle_column(pa.array(["q q b c d e f q", "a b c d x", None, "a b c d e f"]), short=False))) == [(0, 0, 1, 2), (0, 1, 1, 2), (3, 0, 2, 2), (3, 1, 2, 2)]


def test_op10_counts(spark, docs):
    for r in run(spark, "op10_quality_rules").itertuples():
        t = docs[r.doc_id]
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        repeat = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat), failed)
        assert not (failed and r.kept)

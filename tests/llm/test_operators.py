"""Each operator against plain Python on a small frame: nulls, empty and long texts, repeats, clashing names, no rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.session import make_session
from tidewater.llm import bloom_dedup, bloom_lm, byte_codec, hilbert_shards, hyper_language, image_features, license_scan, queries, source_mix, token_count, weighted_minhash
from tidewater.llm.components import components, few_components
from tidewater.llm.hashed_words import NO_WORD, word_hashes

MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
EN = "the cat and the dog sat on the mat while rain fell over the quiet town and nobody went out that evening "
FR = "le chat et le chien sont assis dans la maison pendant que la pluie tombe sur la ville calme "
ROWS = [
    (1, EN * 3, "en", "a"), (2, EN * 3, "en", "b"), (3, FR * 3, "fr", None), (4, None, "en", "a"), (5, "", None, "a"), (6, "12 34 !!", "fr", "b"),
    (7, EN * 3 + "indeed", "en", "c"), (8, "x" * 5000 + " \t\n  end's", "en", "a"), (9, EN * 60 + FR * 60, None, "a"), (10, "Released under the MIT License. under the mit license", "en", "b"),
    (11, "CC BY-NC, Apache License, Version 2.0 é漢字 <|endoftext|> z", "en", "c"), (12, " 　 a\x1cb", "fr", "c"), (None, EN * 3, "en", "a"), (14, " ", None, None), (3, FR * 3, "fr", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def spark():
    return make_session("4", 4)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def text(row):
    return row[1] or ""


def same(rows, want):
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_codec_chunks_meet_and_decode(docs):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_codec.codec(MULTI, P.PATTERN).rank, special_tokens={})
    want = []
    for r in ROWS:
        ids = enc.encode_ordinary(text(r))
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text(r).encode()).hexdigest()))
    for how in ({}, {"chunk_chars": 64, "overlap_chars": 16}, {"chunk_chars": 7, "overlap_chars": 3}):
        same([tuple(x) for x in byte_codec.digest(docs, MULTI, P.PATTERN, **how).collect()], want)
    clash = byte_codec.encode(docs.withColumn("IDS", F.lit(1)), MULTI, P.PATTERN)
    assert sorted(clash.columns) == sorted([*docs.columns, "ids"]) and clash.count() == len(ROWS)
    assert byte_codec.digest(docs.limit(0), MULTI, P.PATTERN).count() == 0


def test_batched_merges_equal_heap_merges():
    c = byte_codec.codec(MULTI, P.PATTERN)
    g = np.random.default_rng(5)
    pieces = ["".join(g.choice(list("abethnrsoi é")) for _ in range(g.integers(1, 30))) for _ in range(400)]
    got = c.merges.encode([p.encode() for p in pieces])
    assert got == [tuple(c.rank[s] for s in byte_codec.lowest_merges([c.single[b] for b in p.encode()], c.rank)) for p in pieces]


def test_token_counts(docs):
    t = Tokenizer.from_file(JSON)
    want = [(r[0], len(text(r).encode()), n := len(t.encode(text(r), add_special_tokens=False)), n > 20) for r in ROWS]
    got = token_count.count_tokens(docs.withColumn("N_tokens", F.lit("x")), JSON, limit=20).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    same([tuple(x) for x in got.collect()], want)
    assert token_count.count_tokens(docs.limit(0), JSON).count() == 0


def test_license_scan(docs):
    def brute(r):
        w = WORD.findall(text(r).translate(LOWER))
        hits = [(i, label) for p, label in license_scan.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        return r[0], len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    got = license_scan.scan(docs.withColumn("score", F.lit("x"))).collect()
    same([(x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got], [brute(r) for r in ROWS])
    assert all(set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1 for x in got)
    gpl = docs.sparkSession.createDataFrame([(1, "This work is licensed under the GNU General Public License, version 3."), (2, "the GNU public general")], "doc_id long, text string")
    assert {x.doc_id: (x.labels, x.n_base) for x in license_scan.scan(gpl).collect()} == {1: ("gpl-3", 0), 2: ("", 0)}
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_hilbert_curve_and_shards(docs):
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(2**bits)] * dims)], axis=1)
        h = hilbert_shards.hilbert_index(cells, bits)
        assert sorted(h) == list(range(2 ** (bits * dims)))
        walk = cells[np.argsort(h)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve are neighbours in space
    many = docs.crossJoin(docs.sparkSession.range(20).select(F.col("id").alias("slot")))
    got = hilbert_shards.shard(many, 7, ["source", "lang", "doc_id"], ["doc_id", "text"]).collect()
    by = collections.defaultdict(list)
    for x in got:
        by[x.shard].append(x.slot)
    assert len(got) == 20 * len(ROWS) and sorted(by) == list(range(7))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    one = sorted(map(str, hilbert_shards.digest(docs).collect()))
    assert one == sorted(map(str, hilbert_shards.digest(docs.repartition(2)).collect()))
    assert all(x.text_crc32 in {zlib.crc32(text(r).encode()) for r in ROWS} for x in hilbert_shards.digest(docs).collect())
    assert hilbert_shards.digest(docs.limit(0)).count() == 0


def test_language_profiles(spark, docs):
    base = spark.createDataFrame([(EN, "en"), (FR, "fr"), (None, "fr"), ("", "en"), ("99", "de"), ("words", None)], "text string, lang string")
    p = hyper_language.prototypes(base, dims=256)
    got = {(x.doc_id, x.text): x for x in hyper_language.predict(docs.withColumn("Score", F.lit(1)), p, dims=256).collect()}
    assert got[(1, EN * 3)].lang_pred == "en" and got[(3, FR * 3)].lang_pred == "fr"
    assert all(x.lang_pred == "und" and x.score == 0 for (i, t), x in got.items() if i in (4, 5, 6, 14))
    assert all(0 <= x.score <= 1 for x in got.values())
    v = hyper_language.vectors([EN, EN.upper()], 256)
    assert (v[0] == v[1]).all()
    long = hyper_language.vectors([EN * 9000], 256)[0]
    assert np.dot(long, v[0]) / np.linalg.norm(long) / np.linalg.norm(v[0]) > 0.99
    assert hyper_language.predict(docs.limit(0), p, dims=256).count() == 0
    assert {x.lang_pred for x in hyper_language.predict(docs, p.limit(0), dims=256).collect()} == {"und"}


def test_bloom_dedup(docs):
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[text(r)].append(r[0])
    want = []
    for r in ROWS:
        ids = groups[text(r)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(text(r).encode()).hexdigest()))
    for bits in (1 << 26, 8):  # 8 bits: nearly every row is a candidate, the result stays
        got = bloom_dedup.dedup(docs.withColumn("kept", F.lit("x")), bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        same([tuple(x) for x in got.collect()], want)
    assert bloom_dedup.dedup(docs.limit(0)).count() == 0


def test_bloom_lm(docs):
    tok = lambda r: re.findall(r"[^\x20\x09-\x0D]+", text(r).translate(LOWER)) + [None]
    train = [r for r in ROWS if r[0] not in (7, 9)]
    c = collections.Counter(w for r in train for w in tok(r))
    n, v = sum(c.values()), len(c)
    want = {(r[0], text(r)): (len(tok(r)), sum(w in c for w in tok(r)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(r))) for r in ROWS}
    for head in (1_000, 3):  # with 3 frequent words held, the others' counts come by the join
        got = bloom_lm.score(docs.withColumn("key", F.col("text")), docs.where("doc_id is null or doc_id not in (7, 9)"), bits=1 << 16, log_buckets=3, head_words=head).collect()
        assert len(got) == len(ROWS)
        for x in got:
            w = want[(x.doc_id, x.key or "")]
            assert (x.n_tokens, x.n_known, x.train_tokens) == (*w[:2], n) and abs(x.base_score - w[2]) < 1e-6 and x.score < 0
    one = {x.doc_id: x for x in got}
    assert one[1].score > one[1].base_score  # word order is known
    assert bloom_lm.score(docs.limit(0), docs, bits=1 << 12, log_buckets=2).count() == 0
    assert bloom_lm.score(docs, docs.limit(0), bits=1 << 12, log_buckets=2).count() == len(ROWS)


def test_bloom_lm_filter_grows_with_its_ngrams(spark, docs):
    rates = []
    for n in (300, 30_000):
        d = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "text string")
        rows = bloom_lm.train(d, None, 2, 1).withColumn("head", F.lit(b"")).withColumn("head_n", F.lit(b"")).collect()
        m = bloom_lm.Model(rows, sum(len(r["filter"]) for r in rows) * 8, 2, 1, 1)
        h, _ = word_hashes([" ".join(f"w{i}" for i in range(n)), " ".join(f"v{i}" for i in range(20_000))], bloom_lm.BLANKS)
        assert (m.level(h[:n], 1) >= 1).all()
        rates.append((m.level(h[n:], 1) > 0).mean())
    assert max(rates) < 0.02
    order = spark.createDataFrame([(1, "k1 k2 k3 k4"), (2, "k3 k2 k1 k4")], "doc_id long, text string")
    one, two = (x.score for x in bloom_lm.score(order, order.where("doc_id = 1"), log_buckets=2).orderBy("doc_id").collect())
    assert one > two + 1  # pairs seen once count
    how = {"carry": ["doc_id", "source"], "log_buckets": 3, "head_words": 3}
    train = docs.where("doc_id is null or doc_id not in (7, 9)")
    held, joined = (sorted(map(repr, bloom_lm.score(docs, train, **how, **x).collect())) for x in ({}, {"held_bytes": 0}))
    assert held == joined and len(held) == len(ROWS)


def test_filter_gives_levels_back(spark):
    words = " ".join(f"w{i} " * (i % 9 + 1) for i in range(300))
    d = spark.createDataFrame([(words,)], "text string")
    rows = bloom_lm.train(d, 1 << 18, 2, 1).withColumn("head", F.lit(b"")).withColumn("head_n", F.lit(b"")).collect()
    m = bloom_lm.Model(rows, 1 << 18, 2, 1, 1)
    h, _ = word_hashes([" ".join(f"w{i}" for i in range(300))], bloom_lm.BLANKS)
    assert (m.level(h, 1) >= bloom_lm.levels(np.arange(300) % 9 + 1)).all()
    assert (m.level(h, 1) == bloom_lm.levels(np.arange(300) % 9 + 1)).mean() > 0.97


def shingle_set(t):
    w = WORD.findall(t.translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_weighted_minhash_classes(spark):
    g = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    passage = " ".join(vocabulary[:15])
    texts = []
    for k in range(60):
        w = g.choice(vocabulary, 80)  # two words changed beside the passage leave 81 of 101 shingles
        texts.append(" ".join(w) + (" " + passage if k % 2 else ""))
        for _ in range(k % 4):  # near copies with one or two words changed
            c = w.copy()
            c[g.integers(0, 80, 1 + k % 2)] = "edited"
            texts.append(" ".join(c) + (" " + passage if k % 2 else ""))
    seed = g.choice(vocabulary, 100)
    texts += [" ".join(np.where(np.arange(100) == i, f"z{i}", seed)) for i in range(100)]  # one large group
    texts += ["", None, "one two", "One, two!", " ", "", texts[0], texts[0]]
    rows = list(enumerate(texts))
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    got = {x.doc_id: x for x in weighted_minhash.classes(d).collect()}
    sets = [shingle_set(t or "") for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert [got[i].class_id for i, _ in rows] == [find(i) for i, _ in rows]
    size = collections.Counter(find(i) for i, _ in rows)
    assert all(got[i].class_size == size[find(i)] and got[i].kept == (i == max(j for j, _ in rows if find(j) == find(i))) for i, _ in rows)
    assert weighted_minhash.classes(d.limit(0)).count() == 0


def class_ids(texts):
    """Least index of each text's class, by comparing all pairs (plain similarity)."""
    sets, of = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if of[i] != of[j] and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                a, b = of[i], of[j]
                of = [min(a, b) if x == max(a, b) else x for x in of]
    return of


def test_weighted_minhash_large_bucket_of_many_classes(spark):
    g = np.random.default_rng(12)
    seed, texts = np.array([f"w{i}" for i in range(100)], object), []
    for k in range(400):  # 0.85 of each text's shingles are the seed's; those of two texts are 0.74 alike, a pair of one k 0.81
        w = seed.copy()
        w[g.choice(np.arange(5, 95, 10), 1)] = f"a{k}"
        w[100 - 10:] = [f"b{k}x{i}" for i in range(10)]
        c = w.copy()
        c[g.choice(np.arange(8, 80, 20), 2, replace=False)] = [f"c{k}", f"d{k}"]
        texts += [" ".join(w), " ".join(c)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in weighted_minhash.classes(d).collect()}
    want = class_ids(texts)
    assert len(set(want)) > 200
    assert [got[i] for i in range(len(texts))] == want


def test_block_links_are_all_links():
    g = np.random.default_rng(2)
    table = g.integers(0, 45, 1 << weighted_minhash.LOG_COUNTERS).astype(np.int16)
    sets = [np.sort(g.integers(0, 40, g.integers(1, 60)).astype(np.uint32)) for _ in range(120)] + [np.zeros(0, np.uint32)]
    apart = g.random((40, 81)) < 0.9
    got = weighted_minhash.block_links(sets[:40], sets[40:], apart, table, 0.5)
    want = [(i, j, *s) for i, x in enumerate(sets[:40]) for j, y in enumerate(sets[40:]) if apart[i, j] and max(s := weighted_minhash.similarity(x, y, table)) >= 0.5]
    assert want and sorted(got) == sorted(want)


def test_weighted_minhash_pairs_of_a_large_group_stay_few(spark, monkeypatch):
    g, n, made, write = np.random.default_rng(3), 400, [], weighted_minhash.write_stage
    monkeypatch.setattr(weighted_minhash, "write_stage", lambda d, name: made.append(write(d, name)) or made[-1] if name == "pairs" else write(d, name))
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        text = list(words)
        for at in g.choice(200, 3, replace=False):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    got = {x.doc_id: x.class_id for x in weighted_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(n)] == class_ids([text for _, text in rows])
    assert sum(d.count() for d in made) < 30 * n


def test_weighted_minhash_repeated_lines(spark):
    g = np.random.default_rng(21)
    texts = []
    for k in range(12):  # plain similarity above 0.9, weighted below 0.3
        words, line = " ".join(f"w{i}" for i in g.integers(0, 5000, 100)), " ".join(f"l{k}x{i}" for i in range(10))
        texts += [f"{words} {line}", f"{words} {' '.join([line] * 50)}"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in weighted_minhash.classes(d).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


def test_plain_samples_follow_plain_similarity():
    g = np.random.default_rng(9)
    hits = []
    for _ in range(60):
        a = g.integers(0, 1 << 32, 200, dtype=np.uint64).astype(np.uint32)
        b = np.concatenate([a[:160], a[:160], a[:160], g.integers(0, 1 << 32, 40, dtype=np.uint64).astype(np.uint32)])
        hits.append(np.mean(weighted_minhash.plain_samples(np.sort(a)) == weighted_minhash.plain_samples(np.sort(b))))
    assert abs(np.mean(hits) - 160 / 240) < 0.04


def test_few_components(spark):
    links = spark.createDataFrame([(b"c", b"b"), (b"b", b"a"), (b"e", b"d"), (b"d", b"e"), (b"f", b"f")], "a binary, b binary").repartition(3)
    want = {(b"a", b"a"), (b"b", b"a"), (b"c", b"a"), (b"d", b"d"), (b"e", b"d"), (b"f", b"f")}
    for how in (few_components, components):
        assert {(bytes(x.node), bytes(x.label)) for x in how(links).collect()} == want
    assert few_components(links.limit(0)).count() == 0


def test_consistent_samples_follow_similarity():
    table = np.zeros(1 << weighted_minhash.LOG_COUNTERS, np.int16)
    g = np.random.default_rng(8)
    hits = []
    for _ in range(60):
        a = g.integers(0, 1 << 32, 200, dtype=np.uint64).astype(np.uint32)
        b = np.concatenate([a[:160], g.integers(0, 1 << 32, 40, dtype=np.uint64).astype(np.uint32)])
        hits.append(np.mean(weighted_minhash.samples(np.sort(a), table) == weighted_minhash.samples(np.sort(b), table)))
    assert abs(np.mean(hits) - 160 / 240) < 0.04
    assert abs(weighted_minhash.similarity(np.sort(a), np.sort(b), table)[0] - 160 / 240) < 0.01


def test_source_mix(spark, docs):
    g = np.random.default_rng(4)
    rows = [(i, "w " * int(g.integers(0, 300)), f"s{int(g.choice([0, 0, 0, 1, 2, 3, 4]))}") for i in range(400)] + [(None, None, None), (7, "a b", None), (7, "a b", None), (8, "", "s9")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("x"))
    got = source_mix.mix(d, block_words=8).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, full, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(), {}
    while True:  # share out, stop at three times the size, share the rest again
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else rest * weight[s] / share for s in order}
        over = {s for s in order if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for x in got:
        taken[x.source] += x.taken
        assert x.taken <= 3 * x.size and x.source_size == size[x.source] and abs(x.target - target[x.source]) < 1e-6
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 40 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mix(d, block_words=8).collect()))
    assert source_mix.mix(d.limit(0)).count() == 0


def test_image_copies(spark):
    g = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in g.normal(0, 0.15, 64)]) for i in range(60)]
    vectors += [(100, vectors[0][1]), (101, None), (102, []), (None, vectors[1][1])]
    d = spark.createDataFrame(vectors, "id long, v array<double>")
    asked = image_features.pictures(d.where("id % 5 = 0 or id is null"), "id", "v", True)
    base = image_features.pictures(d, "id", "v", False)
    got = collections.defaultdict(set)
    for x in image_features.copies(asked, base).collect():
        got[x.query].add(x.id)
    wanted = {i: {0 if i == 100 else i} for i, _ in vectors if i is not None and i % 5 == 0}
    assert sum(wanted[i] <= got[i] for i in wanted) / len(wanted) >= 0.9
    assert all(v <= wanted[i] for i, v in got.items() if i is not None)
    assert image_features.copies(asked.limit(0), base).count() == 0
    # the tables' pairs hold nearly all pairs that brute force finds within the same distance
    q, b = (image_features.index(x)[1].collect() for x in (asked, base))
    words = lambda r: np.array([[x.w0, x.w1, x.w2, x.w3] for x in r], np.int64).view(np.uint32)
    a, c = words(q), words(b)
    close = np.array([np.bitwise_count(a[i] ^ c).sum(axis=1) <= 10 for i in range(len(a))])
    met = np.array([(a[i] == c).any(axis=1) for i in range(len(a))])
    assert (close & met).sum() / close.sum() >= 0.9


def test_image_tables_hold_pairs_within_24_bits_and_noisy_copies(spark):
    g = np.random.default_rng(11)
    base = g.integers(0, 256, (2400, 32), dtype=np.uint8)
    bits = np.unpackbits(base, axis=1)
    for i in range(2400):  # 1 to 24 bits turned
        bits[i, g.choice(256, i % 24 + 1, replace=False)] ^= 1
    sent = lambda rows: spark.createDataFrame([(i, *map(int, r.copy().view(np.int64))) for i, r in enumerate(rows)], "row long, w0 long, w1 long, w2 long, w3 long")
    met = {x.q_row for x in image_features.near_pairs(sent(np.packbits(bits, axis=1)), sent(base)).where("q_row = b_row").collect()}
    assert all(i in met for i in range(2400) if i % 24 < 19) and len(met) >= 0.98 * 2400
    pictures = [image_features.picture(g.normal(0, 0.15, 64)) for _ in range(20)]
    row = lambda i, p: (i, p.shape[1], p.shape[0], p.tobytes())
    schema = "id long, width int, height int, pixels binary"
    asked = spark.createDataFrame([row(i, image_features.noisy(p[8:88, 4:84], i, 4.0)) for i, p in enumerate(pictures)], schema)
    got = {(x.query, x.id) for x in image_features.copies(asked, spark.createDataFrame([row(i, p) for i, p in enumerate(pictures)], schema)).collect()}
    small = spark.createDataFrame([row(i, np.rint(image_features.resized(p.astype(float), 0.9)).astype(np.uint8)) for i, p in enumerate(pictures)], schema)
    got_small = {(x.query, x.id) for x in image_features.copies(small, spark.createDataFrame([row(i, p) for i, p in enumerate(pictures)], schema)).collect()}
    assert all(sum((i, i) in x for i in range(20)) >= 18 for x in (got, got_small))
    assert all(i == j for i, j in got | got_small)


def test_image_pairs_stay_in_tasks_of_bounded_size(spark, monkeypatch):
    g = np.random.default_rng(23)
    vectors = [(i, [float(x) for x in g.normal(0, 0.15, 64)]) for i in range(40)]
    d = spark.createDataFrame(vectors, "id long, v array<double>")
    asked, base = (image_features.pictures(x, "id", "v", e) for x, e in ((d.where("id % 4 = 0"), True), (d, False)))
    whole = sorted(map(tuple, image_features.copies(asked, base).collect()))
    for name, size in (("BLOCK", 100), ("SLICE", 300), ("PAIRS", 50)):  # many tasks and stretches, one image or row at a time
        monkeypatch.setattr(image_features, name, size)
    found = image_features.copies(asked, base)
    assert sorted(map(tuple, found.collect())) == whole and len(whole) >= 9
    # pairs are not joined by Spark, and neither side of their search is broadcast
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Generate explode" in plan and "_block" in plan and "flip" not in plan
    # the pairs of the tables and of brute force, both within the distance
    q, b = (image_features.index(x)[1] for x in (asked, base))
    got = {(x.q_row, x.b_row) for x in image_features.near_pairs(q, b, 24).collect()}
    x, y = ([(r.row, np.array([r.w0, r.w1, r.w2, r.w3], np.int64).view(np.uint64)) for r in t.collect()] for t in (q, b))

    def share_a_table(u, v):
        bits = np.bitwise_count(image_features.words_of(np.array([u]))[:, 0] ^ image_features.words_of(np.array([v]))[:, 0])
        return bits.min() <= 1

    at = np.stack([v for _, v in y])
    want = set()
    for r, u in x:
        want |= {(r, y[i][0]) for i in np.nonzero(np.bitwise_count(at ^ u).sum(axis=1) <= 24)[0] if share_a_table(u, at[i])}
    assert got == want and len(want) > 100


def test_image_query_says_which_rows_are_equal(spark, tmp_path):
    g = np.random.default_rng(17)
    vectors = [(i, [float(x) for x in g.normal(0, 0.15, 64)]) for i in range(1, 6)]
    vectors += [(50, vectors[0][1]), (51, vectors[0][1]), (52, None), (50, vectors[0][1])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op4_image_features(spark, str(tmp_path)).collect()
    assert [(x.query, x.id) for x in rows if x.query is not None] == [(50, 1)] * 2
    same([(x.id, x.member) for x in rows if x.query is None], [(i, i) for i in range(1, 6)] + [(1, 50), (1, 51), (None, 52), (1, 50)])


def test_words_hash_alike_and_apart():
    h, n = word_hashes(["Ab-c  ab c\n", "", "é É"], NO_WORD)
    assert n.tolist() == [4, 0, 2] and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4

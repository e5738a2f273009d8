"""Edit embedding, whitening and conversation repair against plain Python."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.session import make_session
from tidewater.llm import chebyshev_whitening as cw
from tidewater.llm import edit_embedding as ee
from tidewater.llm import queries, source_mix
from tidewater.llm import turn_repair as tr

WHITE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def spark():
    return make_session("4", 4)


# Conversation repair


def least_edits(rows, kinds):
    """(cost, audit, repaired) of one conversation by trying every edit everywhere."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    named = (("u", "user"), ("a", "assistant"))

    @functools.lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "", ())] if i == len(rows) and q in (0, 3) else []

        def add(cost, edit, then, said):
            if then is not None:
                found.append((cost + then[0], edit + then[1], said + then[2]))

        for x, name in named:
            if (q, x) in step and inserted < 4:
                add(5, "I", best(i, step[q, x], inserted + 1), ((name, ""),))
        if i < len(rows):
            role, text = rows[i]
            add(2, "D", best(i + 1, q, 0), ())
            if kinds[i] not in "bd":
                more = 5 if kinds[i] == "t" else 0
                if (q, role[:1]) in step:
                    add(more, "K", best(i + 1, step[q, role[:1]], 0), ((role, text),))
                for x, name in named:
                    if (q, x) in step:
                        add(more + 1, "R", best(i + 1, step[q, x], 0), ((name, text),))
        return min(found, default=None)

    return best(0, 0, 0)


def repaired(rows):
    """conv -> the digest row, from damaged (conv, turn, role, text)."""
    by, out = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()[:16]))
        seen, kinds = set(), ""
        for _, role, text in found:
            body = text.strip(WHITE)
            kinds += "b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t"
            seen.add((role, text))
        letters = [r[1][:1] for r in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        turns = [r[0] for r in found if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, said = least_edits([r[1:] for r in found], kinds)
        text = "\n".join(f"{r}:{t}" for r, t in said)
        out[conv] = (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def talk(seed, sizes):
    rnd = random.Random(seed)
    return [
        (conv, rnd.choice([None, *range(30)]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), rnd.choice(["", " \t", "a.", "b!", "c", "é?", f"x {i}.", str(i)]))
        for conv, n in sizes.items() for i in range(n)
    ]


SIZES = {None: 30, 1: 1, 2: 2, 3: 9, 4: 150, 2**60: 12}


@pytest.mark.parametrize("how", [{}, {"chunk_rows": 3}, {"chunk_rows": 1, "partitions": 7}, {"chunk_chars": 5, "partitions": 2}])
def test_repair_is_cheapest_whatever_the_chunks(spark, how):
    rows = talk(5, SIZES)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ORD", F.lit(1)).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in tr.digest(tr.repair(df, **how)).collect()}
    assert got == repaired(rows)


def test_repair_rows_are_the_repaired_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "hello."), (1, 2, "tool", "x"), (1, 3, "assistant", "yes.")]
    got = tr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("ord").collect()
    assert [tuple(x) for r in got for x in r["rows"]] == [("system", "s."), ("user", "hello."), ("assistant", "yes.")] and "".join(r["audit"] for r in got) == "KRDK"


def test_repair_of_no_rows(spark):
    assert tr.digest(tr.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_rank_convergence_stops_early_with_equal_vectors():
    rnd = random.Random(3)
    for _ in range(200):
        roles = "".join(rnd.choice("suax") for _ in range(rnd.randint(0, 12)))
        kinds = "".join(rnd.choice("--bdt") for _ in roles).encode()
        end = tuple(rnd.randint(0, 9) for _ in range(4))
        old = tr.backwards(roles, kinds, tr.END)[0]
        assert tr.fixed_up(roles, kinds, tr.END, old, end) == tr.backwards(roles, kinds, end)[0]


def test_repair_query_on_damaged_rows(spark, tmp_path):
    rows = [(c, t, r, x) for c in (*range(200), None) for t, (r, x) in enumerate([("user", f"ask {c}?"), ("assistant", None), (None, "c."), ("assistant", "Good. Bye!")][: 1 + (c or 3) % 4])]
    rows += [(900, None, "user", "n."), (900, None, "user", "n.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    bad = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        shown = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault = zlib.crc32(shown.encode()) % 20
        if fault:
            row = (c, t, "user" if fault == 4 else r, "" if fault == 1 else x.translate({46: None, 33: None, 63: None}) if fault == 2 else x)
            bad += [row] * (2 if fault == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | repaired(bad)
    got = {r[0]: tuple(r)[1:] for r in queries.op13_turn_repair(spark, str(tmp_path)).collect()}
    assert got == want and len({c for c, *_ in rows}) > len({c for c, *_ in bad})


# Whitening


def vectors(n=300, d=24, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ np.diag(np.linspace(2, 0.2, d))).astype("float32")


def fitted(rows):
    x = np.floor(np.array([[float(v) for v in r] for r in rows]) * 64).astype("int64") + 1_000_000
    fit = np.unique(x, axis=0)
    sums = [int(s) for s in fit.sum(axis=0)]
    c = fit - np.array([s / len(fit) for s in sums])
    e, u = np.linalg.eigh(c.T @ c / len(fit))
    return x, len(fit), sums, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("d", [3, 24, 40])
def test_whitening_agrees_with_plain_eigenvectors(spark, d):
    good = vectors(d=d).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(900 + i, good[0]) for i in range(50)]
    odd = [(2000, None), (2001, [None] * d), (2002, [float("nan")] * d), (2003, [1.0] * (d - 1) + [float("-inf")])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("N", F.lit(0)).repartition(5)
    x, n, sums, e, u = fitted([v for _, v in rows])
    got = {(r["vec_id"], r["component"]): r for r in cw.components(df, "vec_id", "embedding").collect()}
    k = min(16, d)
    assert len(got) == len(rows) * k
    for at, (i, _) in enumerate(rows):
        assert got[i, 1]["deviation"] == sum((n * int(v) - s) ** 2 for v, s in zip(x[at], sums)) and got[i, 1]["n"] == n
    for c in range(k):
        want = (x - np.array([s / n for s in sums])) @ u[:, c] / np.sqrt(e[c])
        mine = np.array([got[i, c + 1]["whitened"] for i, _ in rows])
        sign = np.sign(want @ mine)
        assert np.abs(mine - sign * want).max() < 1e-9 and abs(got[0, c + 1]["explained"] - e[c] / e.sum()) < 1e-12
    assert got[0, 1]["identity_error"] < 1e-10


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert cw.components(spark.createDataFrame([], schema), "vec_id", "embedding").count() == 0
    assert cw.components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), "vec_id", "embedding").count() == 0
    ragged = cw.components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, [3e30, 0.0])], schema), "vec_id", "embedding").collect()
    assert {r["vec_id"] for r in ragged} == {1, 2, 3, 4} and {r["n"] for r in ragged} == {4}
    flat = cw.components(spark.createDataFrame([(i, [float(i), 1.0, 1.0]) for i in range(9)], schema), "vec_id", "embedding").collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 9


def test_whitening_ends_after_few_passes_once_strong_components_are_locked(spark):
    g = np.random.default_rng(16)
    x = g.standard_normal((10_000, 64))
    for j in range(2):
        x += g.standard_normal((len(x), 1)) * (2 + j) / 4 * g.standard_normal(64)
    rows = spark.createDataFrame([(x_i.tolist(),) for x_i in x], "embedding array<double>")
    model = cw.fit(rows, "embedding")
    assert model.passes < 100 and model.residual < 1e-12
    _, _, _, e, u = fitted(x.tolist())
    assert np.abs(model.values - e[:16]).max() < 1e-12 * e[0] and np.abs(np.abs(np.diag(model.vectors.T @ u[:, :16])) - 1).max() < 1e-10


# Edit embedding


def walk(text):
    """The characters of the walk, one time after another, by the table of stays alone."""
    out, t, table = [], 0, np.frombuffer(ee.stays(), "uint8")
    for c, row in zip(text, ee.letters()[0][ee.codes_of(text)]):
        n = int(table[row + t % ee.PERIOD])
        out += [c] * n
        t += n
    return out


def printed(text):
    steps = walk(text)
    level = ee.level_of(len(steps))
    symbols = ee.letters()[1][ee.codes_of("".join(steps))] if steps else []
    return level, np.array([symbols[t] if t < len(steps) else 0 for t in ee.times(level)], "uint8")


WORDS = [f"{a}{b}" for a in ("ma", "re", "lo", "ti", "su") for b in ("na", "der", "ping", "ö", "漢字", "ly")]


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_fingerprint_samples_the_walk(spark, monkeypatch):
    texts = ["", "a", "ab", prose(1, 40), prose(2, 700), "🙂" * 300, "x" * 5000, None]
    for few in (1, 64):
        monkeypatch.setattr(ee, "FEW", few)
        for t, p in zip(texts[:-1], ee.prints(texts[:-1])):
            assert p[0] == printed(t)[0] and (p[1] == printed(t)[1]).all() and (ee.read(ee.shown(*p))[1] == p[1]).all()
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["text"] or "": r["__print"] for r in ee.fingerprints(df).collect()} == {t: ee.shown(*printed(t)) for t in texts[:-1]}


def test_samples_nest():
    steps = np.frombuffer("".join(walk(prose(3, 60))).encode("utf-32-le"), "uint32").astype("uint16")
    level, symbols = printed(prose(3, 60))
    for up in (level, level + 1, level + 3):
        want = [ee.letters()[1][steps[t]] if t < len(steps) else 0 for t in ee.times(up)]
        assert (ee.coarser(level, symbols, up) == want).all()


@pytest.mark.parametrize("partitions", [1, 4, None])
def test_edited_copies_and_next_texts(spark, partitions):
    texts = {i * 3: prose(i, 1 + i * 7 % 90) for i in range(50)} | {151: None, 152: "", 153: "z", 154: prose(9, 4000), 155: prose(0, 1)}
    rows = [*texts.items(), (None, prose(5, 20)), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("K", F.lit(2)).repartition(6)
    got = {(r["doc_id"], r["n_chars"]): r for r in ee.edited(df, partitions=partitions).collect()}
    assert len(got) == len(rows)
    keys = sorted(texts)
    for k, after in zip(keys, [*keys[1:], keys[0]]):
        t, n = texts[k] or "", texts[after] or ""
        h = len(t) // 2
        r, copy = got[k, len(t)], t[:len(t) - h] + n[:h]
        assert r["edited"] == copy and r["fingerprint"] == ee.shown(*printed(t)) and r["edited_fingerprint"] == ee.shown(*printed(copy))
        assert r["near_edited"] == ee.likeness(printed(t), printed(copy)) and r["near_next"] == ee.likeness(printed(t), printed(n))
    lost = got[None, len(prose(5, 20))]
    assert lost["near_next"] is None and lost["edited"] == prose(5, 20)[: len(prose(5, 20)) - len(prose(5, 20)) // 2]
    assert ee.edited(df.limit(0), partitions=partitions).count() == 0


def test_near_pairs_against_all_pairs(spark):
    rnd = random.Random(8)
    texts = []
    for i in range(60):
        t = prose(100 + i, rnd.choice([5, 60, 300, 900]))
        texts.append(t)
        for _ in range(3):
            cut = list(t)
            for _ in range(max(1, len(cut) // 150)):
                at = rnd.randrange(len(cut))
                cut[at:at + rnd.choice([0, 1])] = rnd.choice(["", "q", "w"])
            texts.append("".join(cut))
    texts += [texts[0]] * 5 + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(ee.shown(*printed(t or "")), i)
    prints = {i: ee.read(p) for p, i in first.items() if p[2:].strip("0")}
    want = {(a, b): v for a, x in prints.items() for b, y in prints.items() if (v := ee.likeness(x, y)) >= 0.8}
    got = {(r[0], r[1]): r[2] for r in ee.near_pairs(df, df, "doc_id").collect()}
    assert {k: v for k, v in got.items() if k[0] in prints} .items() <= want.items()
    assert len([k for k in want if k in got]) >= 0.98 * len(want) and sum(a != b for a, b in want) > 100


def test_mix_does_not_depend_on_partitions(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(0, 200), f"s{rnd.choice([0, 0, 0, 1, 2])}") for i in range(500)] + [(7, "same text", "s1")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = [sorted(tuple(r) for r in source_mix.mix(d, carry=["doc_id"], block_words=8).collect()) for d in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("doc_id")))]
    assert told[0] == told[1] == told[2] and sum(r[-1] for r in told[0]) > 0

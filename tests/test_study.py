"""Study operators against plain Python: keyed bijection, permutation null, partial correlations, history medians."""

import random
import statistics
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.session import make_session
from tidewater.operators import resample as B
from tidewater.operators import study as U
from tidewater.operators import valuation as V


@pytest.fixture(scope="module")
def spark():
    return make_session("4", 4)


def place(x, n, key):
    """The bijection in plain whole numbers."""
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)

    def dealt(v, r, m):
        return ((v * 48271 + key * 69621 + r * 16807 + 12345) % U.PRIME * 48271 % U.PRIME) // 1024 % m

    while True:
        for r in range(4):
            left, right = divmod(x, b)
            left, right = ((left + dealt(right, r, a)) % a, right) if r % 2 == 0 else (left, (right + dealt(left, r, b)) % b)
            x = left * b + right
        if x < n:
            return x


def test_permuted_is_a_bijection(spark):
    sizes = [1, 2, 3, 7, 10, 64, 130]
    df = spark.createDataFrame([(n, k) for n in sizes for k in (5, 77)], "n long, key long").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    a, b = U.sides(F.col("n"))
    df = df.withColumns({"a": a, "b": b})
    got = {}
    for r in df.select("n", "key", "x", U.permuted(F.col("x"), F.col("n"), F.col("key"), F.col("a"), F.col("b")).alias("y")).collect():
        got.setdefault((r["n"], r["key"]), {})[r["x"]] = r["y"]
    for (n, key), m in got.items():
        assert sorted(m.values()) == list(range(n)) and m == {x: place(x, n, key) for x in range(n)}


def test_permuted_block_is_the_same_bijection():
    for n in (1, 2, 3, 7, 10, 64, 130):
        a = int(np.ceil(np.sqrt(n)))
        got = U.permuted_block(np.arange(n)[:, None], n, np.array([[5, 77, 199 * 1_000_003 + 11_000]]), a, -(-n // a))
        assert got.tolist() == [[place(x, n, k) for k in (5, 77, 199 * 1_000_003 + 11_000)] for x in range(n)]


def test_permutations_are_counted_in_blocks_not_row_by_row(spark):
    """One Python pass over blocks, no chain of interpreted steps for every row and permutation."""
    rows = [("k", date(2020, 1, 1), e, float(e % 5 - 2), 1.0, -1.0) for e in range(9)]
    d = U.convergence(spark.createDataFrame(rows, "c string, date date, entity int, f double, r double, a double"), ["c"], 1.0, 5)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "shiftleft" not in plan.split("MapInPandas")[0]


def test_convergence_against_dealing_anew(spark):
    rnd, n_perm = random.Random(6), 25
    rows = [("k", date(2020, 1, d), e, rnd.choice([None, rnd.gauss(0, 2)]), rnd.gauss(0, 1), rnd.gauss(0, 1)) for d in (1, 2, 3) for e in range(rnd.choice([3, 90, 400]))]
    got = U.convergence(spark.createDataFrame(rows, "c string, date date, entity int, f double, r double, a double"), ["c"], 1.0, n_perm).collect()[0]
    by = {}
    for _, d, e, f, r, a in sorted(rows, key=lambda x: x[:3]):
        if f is not None:
            by.setdefault(d, []).append((f, r, a))
    real = [x for v in by.values() for x in v if abs(x[0]) >= 1]
    assert got["n"] == len(real) and got["hit_a"] == pytest.approx(sum((a > 0) == (f > 0) for f, _, a in real) / len(real))
    means = []
    for p in range(n_perm):
        hits = []
        for d, v in by.items():
            key = p * 1_000_003 + (d - date(1970, 1, 1)).days
            hits += [(v[place(i, len(v), key)][1] > 0) == (f > 0) for i, (f, _, _) in enumerate(v) if abs(f) >= 1]
        means.append(sum(hits) / len(hits))
    means.sort()
    assert got["perm_r_mean"] == pytest.approx(sum(means) / n_perm) and (got["perm_r_lo"], got["perm_r_hi"]) == pytest.approx((means[int(0.025 * n_perm)], means[int(0.975 * n_perm)]))


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_partial_ics_against_regression(spark):
    rng = np.random.default_rng(2)
    rows = []
    for m in range(5):
        for d in (1, 2):
            for e in range(40):
                c = rng.integers(0, 9, 4).astype(float)
                x = c[0] + rng.integers(0, 5)
                rows.append((m, date(2020, 1, d), e, float(x), float(c[1] + x + rng.integers(0, 9)), *[float(c[i]) if i < m else None for i in range(4)], m, 10))
    rows.append((1, date(2020, 1, 1), 99, 1.0, 1.0, None, None, None, None, 1, 10))
    rows += [(0, date(2020, 1, 3), e, 1.0 * e, 2.0, None, None, None, None, 0, 10) for e in range(9)]
    df = spark.createDataFrame(rows, "spec int, date date, entity int, x double, y double, c0 double, c1 double, c2 double, c3 double, n_controls int, least int")
    got = {(r["spec"], r["date"]): (r["n"], r["ic"]) for r in U.partial_ics(df, ["spec"], "least").collect()}
    assert len(got) == 10
    for (m, d), (n, ic) in got.items():
        part = [r for r in rows if r[0] == m and r[1] == d and all(v is not None for v in r[3:5 + m])]
        z = np.column_stack([ranks([r[i] for r in part]) for i in range(3, 5 + m)])
        ctl = np.column_stack([np.ones(len(part)), z[:, 2:]])
        left = [v - ctl @ np.linalg.lstsq(ctl, v, rcond=None)[0] for v in (z[:, 0], z[:, 1])]
        assert n == len(part) == 40 and ic == pytest.approx(np.corrcoef(*left)[0, 1])


@pytest.mark.parametrize("days", [None, 30])
def test_history_medians_against_windows(spark, days):
    rnd = random.Random(1)
    rows = [(e, date(2020, 1, 1) + timedelta(d), rnd.choice([None, rnd.randint(1, 9) / 2])) for e in (1, 2) for d in sorted(rnd.sample(range(200), 60))]
    got = {(r["entity"], r["date"]): (r["m"], r["n_m"]) for r in V.history_medians(spark.createDataFrame(rows, "entity int, date date, v double"), {"v": "m"}, days).collect()}
    for e, d, _ in rows:
        seen = [v for f, g, v in rows if f == e and v is not None and g <= d and (days is None or (d - g).days < days)]
        m, n = got[e, d]
        assert n == len(seen) and (m == statistics.median(seen) if seen else m is None or np.isnan(m))


def weight(ident, r, seed=20260710):
    u = (ident % B.PRIME * 48271 + (r + seed) * 69621 + 1) % B.PRIME
    for odd, one in B.STEPS:
        u = (u * u + u * odd + one) % B.PRIME
    return sum(u >= t for t in B.POISSON)


def test_poisson_weights_are_poisson_and_unrelated():
    w = np.array([[weight(e * 100_003 + 9000 + d, r) for r in range(40)] for e in range(30) for d in range(20)])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06 and abs((w == 0).mean() - np.exp(-1)) < 0.02
    rows, draws = np.corrcoef(w[:200]), np.corrcoef(w.T)
    assert abs(rows[np.triu_indices(200, 1)].mean()) < 0.01 and abs(draws[np.triu_indices(40, 1)]).max() < 0.2


def test_poisson_interval_against_plain_sums(spark):
    rnd, n = random.Random(3), 80
    rows = [(c, rnd.gauss(1, 2), i) for c, k in (("a", 60), ("b", 9), ("c", 300)) for i in range(k)] + [("a", None, 999)]
    got = {r["c"]: (r["ci_lo"], r["ci_hi"]) for r in B.poisson_interval(spark.createDataFrame(rows, "c string, y double, i long"), ["c"], "y", "i", n).collect()}
    assert got["b"] == (None, None)
    for c in "ac":
        part = [(y, i) for k, y, i in rows if k == c and y is not None]
        means = sorted(sum(weight(i, r) * y for y, i in part) / sum(weight(i, r) for _, i in part) for r in range(n))
        assert got[c] == pytest.approx((means[int(n * 0.025)], means[int(n * 0.975) - 1]))


def test_poisson_weights_of_a_block_of_rows():
    ids = np.array([0, 1, 999, 7 * 100_003 + 9000, 60_000 * 100_003 + 9000, B.PRIME, 3 * B.PRIME - 1, -5])
    got = B.poisson_weights(ids, 500, 20260710)
    assert got.tolist() == [[weight(int(i), r) for r in range(500)] for i in ids]


def test_poisson_interval_draws_the_rows_of_one_ident_together(spark, monkeypatch):
    monkeypatch.setattr(B, "HELD", 2)
    rnd, n = random.Random(4), 60
    rows = [(h, c, rnd.gauss(1, 2), i) for i in range(400) for h in (5, 20) for c in (rnd.choice("abc"), None)]
    d = spark.createDataFrame(rows, "h int, c string, y double, i long").withColumn("c", F.coalesce("c", F.lit("all")))
    got = {(r["h"], r["c"]): (r["ci_lo"], r["ci_hi"]) for r in B.poisson_interval(d.repartition(3), ["h", "c"], "y", "i", n).collect()}
    for h, c in got:
        part = [(y, i) for g, k, y, i in rows if (g, k or "all") == (h, c)]
        means = sorted(sum(weight(i, r) * y for y, i in part) / sum(weight(i, r) for _, i in part) for r in range(n))
        assert got[h, c] == pytest.approx((means[int(n * 0.025)], means[int(n * 0.975) - 1]))
    assert len(got) == 8

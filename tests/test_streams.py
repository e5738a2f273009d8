"""Streams in several batches, out of order, replayed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.session import make_session
from tidewater.streaming import forms as T


@pytest.fixture(scope="module")
def spark():
    return make_session("4", 4)


def test_lights_of_a_hot_series_over_several_batches(spark, tmp_path):
    rnd = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice(["hot"] * 9 + ["cold"]), t0 + dt.timedelta(seconds=rnd.randint(0, 5) + 7 * i), i, rnd.choice([None, 58.0, 61.0, 62.0, 64.0, 78.0, 81.0, 84.0, 30.0])) for i in range(400)]
    rows.sort(key=lambda r: (r[1], r[2]))
    work = T.light_batch(f"{tmp_path}/out", f"{tmp_path}/state", 60, 80, 3, slice_rows=7)
    schema = "series_id string, ts timestamp, seq long, score double"
    for b, lo in enumerate(range(0, 400, 100)):
        part = rows[lo:lo + 100]
        batch = spark.createDataFrame(rnd.sample(part, len(part)), schema)
        for _ in range(2 if b == 1 else 1):  # one batch is delivered again
            work(batch, b)
    state, want = {}, {}
    for k, _, seq, s in rows:
        state[k] = want[seq] = T.step(state.get(k), s, 60, 80, 3)
    got = {r["seq"]: r["color"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want and {"red", "green", "yellow", "insufficient"} == set(want.values())


def test_upsert_takes_the_largest_row_whatever_the_order_of_batches(spark, tmp_path):
    schema = "k string, v long, x string, day string"
    first = [("a", 5, "old", "d1"), ("b", 1, "x", "d1"), ("c", 9, "z", "d2")]
    later = [("a", 7, "new", "d1"), ("b", 1, "w", "d1"), ("e", 2, "y", "d3")]
    for order in ((first, later), (later, first), (first, later, first)):
        path = str(tmp_path / f"t{len(order)}{order[0] is first}")
        work = T.upsert_batch(path, "day", ["day", "k"], ["v"])
        for i, rows in enumerate(order):
            work(spark.createDataFrame(rows, schema), i)
        got = {tuple(r) for r in spark.read.parquet(path).select("k", "v", "x", F.col("day").cast("string")).collect()}
        assert got == {("a", 7, "new", "d1"), ("b", 1, "x", "d1"), ("c", 9, "z", "d2"), ("e", 2, "y", "d3")}

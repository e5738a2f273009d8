"""Membership intervals against plain sets."""

import random

import pytest

from tests.session import make_session
from tidewater.operators import history as H


@pytest.fixture(scope="module")
def spark():
    return make_session("4", 4)


def states(seed):
    rnd = random.Random(seed)
    return {step: {(e, rnd.choice("xyz")) for e in range(6) if rnd.random() < 0.6} for step in range(10, 18)}


def intervals_of(snapshots):
    last, out = max(snapshots), set()
    for k in set().union(*snapshots.values()):
        start = None
        for step in range(min(snapshots), last + 2):
            here = k in snapshots.get(step, set())
            if here and start is None:
                start = step
            if not here and start is not None:
                out.add((*k, start, step if step <= last else None))
                start = None
    return out


def test_snapshots_one_by_one_give_the_intervals_of_all(spark):
    snapshots = states(1)
    rows = [(*k, step) for step, s in snapshots.items() for k in s]
    schema = "entity long, grp string, step int"
    whole = H.validity_intervals(spark.createDataFrame(rows, schema), ["entity", "grp"], "step")
    assert {tuple(r) for r in whole.collect()} == intervals_of(snapshots)
    kept = spark.createDataFrame([], "entity long, grp string, valid_from int, valid_to int")
    for step, s in snapshots.items():
        for _ in range(2):  # taken twice
            kept = spark.createDataFrame(H.next_snapshot(kept, spark.createDataFrame(list(s), "entity long, grp string"), ["entity", "grp"], step).collect(), kept.schema)
    assert {tuple(r) for r in kept.collect()} == intervals_of(snapshots)


def test_old_steps_are_read_with_the_old_group(spark):
    snapshots = states(2)
    schema = "entity long, grp string, step int"
    iv = H.validity_intervals(spark.createDataFrame([(*k, step) for step, s in snapshots.items() for k in s], schema), ["entity", "grp"], "step")
    rows = spark.createDataFrame([(e, step, e * 100 + step) for e in range(6) for step in range(9, 18)], "entity long, step int, v long")
    got = {(r["entity"], r["step"], r["grp"]) for r in H.as_of(rows, iv, "entity", "step").collect()}
    assert got == {(e, step, g) for step, s in snapshots.items() for e, g in s}

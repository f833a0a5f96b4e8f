"""Lift rides that are known, and the rules that make or break them."""

import random

from trailmark.operators import lifts

BIN = 500_000_000
SCHEMA = "who int, session int, t long, mean double, std double, steps int"


def bins(*parts):
    """(n, mean over the baseline, deviation, steps) one after another, after twelve calm bins."""
    out = []
    for n, a, std, steps in ((12, 0.0, 0.1, 0), *parts, (4, 0.0, 0.1, 0)):
        out += [((len(out) + i) * BIN, a, std, steps) for i in range(n)]
    return out


RIDES = {
    "plain": bins((3, 0.6, 0.2, 0), (10, 0.0, 0.1, 0), (3, -0.6, 0.2, 0)),
    "down": bins((3, -0.6, 0.2, 0), (10, 0.0, 0.1, 0), (3, 0.6, 0.2, 0)),
    "walk": bins((3, 0.6, 0.2, 0), (10, 0.0, 0.9, 1), (3, -0.6, 0.2, 0)),
    "handled": bins((5, 0.6, 0.2, 0), (3, 0.0, 0.9, 1), (6, 0.0, 0.1, 0), (5, -0.6, 0.2, 0)),
    "weak and handled": bins((3, 0.6, 0.2, 0), (3, 0.0, 0.9, 1), (6, 0.0, 0.1, 0), (3, -0.6, 0.2, 0)),
    "noisy inside": bins((2, 0.6, 0.2, 0), (1, 0.6, 0.95, 2), (2, 0.6, 0.2, 0), (8, 0.0, 0.1, 0), (5, -0.6, 0.2, 0)),
    "two noisy": bins((1, 0.6, 0.2, 0), (1, 0.6, 0.95, 2), (1, 0.6, 0.2, 0), (1, 0.6, 0.95, 2), (1, 0.6, 0.2, 0), (8, 0.0, 0.1, 0), (5, -0.6, 0.2, 0)),
    "loose": bins((1, 0.6, 0.7, 0), (3, 0.6, 0.41, 0), (8, 0.0, 0.1, 0), (4, -0.6, 0.2, 0)),
    "jerk": bins((2, 0.6, 0.2, 0), (1, 0.6, 0.5, 1), (2, 0.6, 0.2, 0), (8, 0.0, 0.1, 0), (5, -0.6, 0.2, 0)),
    "unlike": bins((6, 0.9, 0.2, 0), (8, 0.0, 0.1, 0), (2, -0.6, 0.2, 0)),
    "late": bins((3, 0.6, 0.2, 0), (100, 0.0, 0.1, 0), (3, -0.6, 0.2, 0)),
    "three": bins((3, 0.6, 0.2, 0), (8, 0.0, 0.1, 0), (3, -0.6, 0.2, 0), (8, 0.0, 0.1, 0), (3, 0.6, 0.2, 0)),
    "four": bins((3, 0.6, 0.2, 0), (8, 0.0, 0.1, 0), (3, -0.6, 0.2, 0), (8, 0.0, 0.1, 0), (3, 0.6, 0.2, 0), (8, 0.0, 0.1, 0), (3, -0.6, 0.2, 0)),
}


def test_known_rides(spark):
    rows = [(i, 0, *b) for i, name in enumerate(RIDES) for b in RIDES[name]]
    got = {}
    for r in lifts.lift_rides(spark.createDataFrame(rows, SCHEMA), "who").orderBy("who", "start").collect():
        got.setdefault(list(RIDES)[r.who], []).append((r.start // BIN, r.stop // BIN, r.direction, r.relaxed))
    assert got == {
        # of the push with two noisy bins the part before the second one is enough
        "plain": [(12, 28, 1, False)], "down": [(12, 28, -1, False)], "handled": [(12, 31, 1, False)], "weak and handled": [(12, 27, 1, True)], "noisy inside": [(12, 30, 1, False)], "two noisy": [(12, 30, 1, False)], "loose": [(12, 28, 1, True)], "jerk": [(12, 30, 1, False)],
        "three": [(12, 26, 1, False)], "four": [(12, 26, 1, False), (34, 48, 1, False)]}


def test_rides_don_t_depend_on_company(spark):
    rng = random.Random(9)
    rows = [(k, s, i * BIN, rng.choice([0, 0, 0, 0.5, 0.5, -0.5]) + rng.uniform(-0.1, 0.1), rng.choice([0.1, 0.2, 0.5, 0.9]), rng.choice([0, 0, 0, 1])) for k in range(6) for s in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    every = sorted(map(tuple, lifts.lift_rides(df.repartition(7), "who").collect()))
    alone = sorted(tuple(r) for k in range(6) for r in lifts.lift_rides(df.where(f"who = {k}"), "who").collect())
    assert every == alone != []
    assert all(b - a <= 45 * 2 * BIN + 200 * BIN and d in (1, -1) for *_, a, b, d, _ in every)
    for k in range(6):  # a push belongs to one ride
        for s in range(3):
            own = [r for r in every if r[:2] == (k, s)]
            assert all(a[3] <= b[2] for a, b in zip(own, own[1:], strict=False))
    assert lifts.lift_rides(df.limit(0), "who").count() == 0

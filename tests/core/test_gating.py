"""Walks and handled devices that are known: which steps go through, which are dropped, which come back."""

import math

import pytest

from trailmark.operators import gating

STEPS, POSES = "who int, session int, t long, peak double", "who int, session int, t long, ux double, uy double, uz double"


def every(start, gap, n):
    return [round(start + i * gap, 3) for i in range(n)]


def path(*points):
    """Degrees over seconds, straight between the points given."""

    def at(t):
        for (t0, a0), (t1, a1) in zip(points, points[1:]):
            if t < t1:
                return a0 if t < t0 else a0 + (a1 - a0) * (t - t0) / (t1 - t0)
        return points[-1][1]

    return at


def still(a):
    return lambda t: a


def turned(a, b, start, took):
    return path((start, a), (start + took, b))


def loose(t):
    """Into a pocket, and there to and fro."""
    hand, side, ahead, back = (0.03, 0.33, 0.94), (0.85, 0.45, 0.24), (0.45, 0.83, 0.30), (0.26, 0.95, -0.20)
    k, a, b = (0.0, hand, side) if t < 5.4 else (t - 5.4, hand, side) if t < 6.4 else (t - 6.4, side, ahead) if t < 7.4 else (0.5 - 0.5 * math.cos(2 * math.pi * (t - 7.4) / 1.6), ahead, back)
    return tuple(p + (q - p) * k for p, q in zip(a, b))


SLOW, FIDGET = [2.44, 3.27, 3.78, 4.38, 5.31, 5.57, 5.85, 6.12, 6.72, 7.01, 7.76, 8.28, 8.70], [30.0, 31.21, 31.62, 32.93, 45.0, 45.39, 46.37, 47.11, 47.81, 60.0, 60.79, 62.18, 63.71]
RISE = [75.0, 75.35, 75.78, 76.13, 76.39, 76.65]
LIFTED = [3.15, 3.70, 4.49, 4.87, 5.23, 6.02, 6.93, 7.85, 8.77, 9.50, 10.44, 11.34, 12.19, 13.01]
PUT, AWAY = [5.86, 6.46, 6.93], [7.69, 8.55, 9.17, 9.61, 10.01, 10.96, 11.74, 12.33, 13.21, 14.18, 15.04, 15.84, 16.67, 17.29, 18.36]
BEFORE, QUIET = every(1.0, 0.55, 10), [34.58, 34.97, 35.82, 36.07, 36.98, 37.97, 39.12, 40.27]

# steps in seconds, their peaks (one for all, or each), degrees that the device is upright, steps that go through
CASES = {
    "in a hand": (every(1.0, 0.5, 20), 1.5, still(30), every(1.0, 0.5, 20)),
    "from a pocket": (every(1.0, 0.55, 20), 1.5, lambda t: 85 + 15 * math.sin(2 * math.pi * t / 1.1), every(1.0, 0.55, 20)),
    "put away standing": ([2.0, 2.33, 2.6, 3.0, 3.4, 3.8], 1.5, turned(30, 90, 2, 2), []),
    "taken out slowly": ([2.0, 2.4, 3.1, 3.9, 4.9, 5.8], 1.5, turned(90, 30, 4.5, 1.5), []),
    "weak long before the turn": ([2.0, 2.9, 3.4, 3.9, 4.4, 5.4, 5.9], 0.7, turned(90, 30, 5.5, 1), []),
    "soft in a pocket": (every(1.0, 0.55, 24), 0.8, lambda t: 85 + 10 * math.sin(2 * math.pi * t / 1.1), every(1.0, 0.55, 24)),
    "put away, weak": (every(2.0, 0.45, 22), 0.8, turned(10, 90, 3.5, 2), []),
    "put away, medium": ([2.17, 2.82, 3.89, 4.50, 4.89, 5.37, 5.71, 5.97, 6.51, 6.83, 7.20, 8.08, 8.61], [0.63, 0.87, 1.08, 1.24, 1.30, 1.13, 0.73, 2.54, 1.43, 0.72, 1.13, 1.30, 0.82], turned(30, 130, 5, 1.6), []),
    "turned after three seconds": (SLOW + every(11.75, 1.0, 12), [0.66, 0.91, 0.98, 1.16, 1.04, 0.91, 1.80, 0.80, 0.83, 0.68, 0.66, 3.03, 1.03] + [3.0] * 12, turned(30, 100, 4.9, 1.2), every(11.75, 1.0, 12)),
    "sitting": (BEFORE + FIDGET + RISE + every(78.04, 0.65, 12), [1.5] * 10 + [1.32, 1.20, 1.66, 0.72, 0.73, 1.39, 0.98, 1.62, 1.04, 0.62, 0.76, 0.70, 0.82, 1.24, 0.71, 0.91, 1.54, 1.82, 2.95] + [1.8] * 12, still(45), BEFORE + every(78.04, 0.65, 12)),
    "quiet after a rest": (BEFORE + QUIET, [1.5] * 10 + [1.69, 0.77, 2.19, 1.41, 1.94, 0.96, 1.39, 1.58], still(20), BEFORE + QUIET),
    "weak in a hand": (every(1.0, 0.85, 14), 0.7, still(20), every(1.0, 0.85, 14)),
    "short and weak": (every(1.0, 0.6, 4), 0.7, still(20), every(1.0, 0.6, 4)),
    "weak after handling": (every(2.0, 0.5, 6) + every(5.6, 0.7, 6), 0.7, turned(90, 20, 3.5, 1.2), []),
    "single steps": ([1.0, 1.6, 5.0], 1.5, still(30), []),
    "handled while walking": (every(1.0, 0.5, 24), 1.5, turned(30, 90, 5, 2), every(1.0, 0.5, 24)),
    "put away, then a walk": ([2.0, 2.4, 2.8, 3.2, 3.6] + every(6.0, 0.55, 16), 1.5, turned(30, 90, 2, 2), every(6.0, 0.55, 16)),
    "lifted to the face": (LIFTED, [0.78, 0.81, 0.93, 0.73, 2.49, 1.64, 1.67, 0.92, 1.38, 1.99, 1.65, 1.43, 0.92, 1.14], path((0, 23), (4.9, 25), (6, 82), (6.9, 70), (7.85, 57), (8.8, 46), (9.5, 37), (11.3, 30), (13, 24)), LIFTED),
    "loose in a pocket": (PUT + AWAY, [0.89, 1.29, 1.05, 5.9, 3.49, 2.68, 0.66, 3.23, 13.77, 2.37, 1.63, 3.41, 9.47, 2.0, 0.91, 2.73, 0.95, 3.32], loose, AWAY),
}


def pose(turn, t):
    a = turn(t)
    return a if isinstance(a, tuple) else (0.0, math.sin(math.radians(a)), math.cos(math.radians(a)))


@pytest.fixture(scope="module")
def gated(spark):
    steps, poses = [], []
    for who, (at, peaks, turn, _) in enumerate(CASES.values()):
        steps += [(who, 0, round(t * 1e9), float(p)) for t, p in zip(at, peaks if isinstance(peaks, list) else [peaks] * len(at))]
        poses += [(who, 0, i * 20_000_000, *pose(turn, i * 0.02)) for i in range(int((max(at) + 4) * 50))]
    rows = gating.handling_gate(spark.createDataFrame(steps, STEPS), spark.createDataFrame(poses, POSES), "who").collect()
    assert len(rows) == len(steps)
    return rows


@pytest.mark.parametrize("name", CASES)
def test_known(gated, name):
    who = list(CASES).index(name)
    assert sorted(round(r.t / 1e9, 3) for r in gated if r.who == who and r.fate != "dropped") == CASES[name][3]


def test_told(gated):
    """Nothing is told before it happened; held steps of a hand are told together; what came back did so with the walk."""
    assert all(r.told >= r.t for r in gated)
    first = [r for r in gated if r.who == 0]
    assert {r.told for r in first if r.t <= 2_500_000_000} == {2_500_000_000} and all(r.told == r.t for r in first if r.t > 2_500_000_000)
    lifted = [r for r in gated if r.who == list(CASES).index("lifted to the face")]
    assert {r.fate for r in lifted} == {"walk", "restored"}


def test_odd_rows(spark):
    """Steps without time go, doubled ones are one, a null peak is weak; without poses the device lies in a hand; empty tables give no rows."""
    none = spark.createDataFrame([], POSES)
    steps = spark.createDataFrame([(1, 0, None, 2.0), *[(1, 0, i * 500_000_000, p) for i in range(8) for p in (2.0, None)], (2, 0, 5, None)], STEPS)
    rows = gating.handling_gate(steps, none, "who").collect()
    assert sorted((r.who, r.t, r.fate) for r in rows) == [*[(1, i * 500_000_000, "walk") for i in range(8)], (2, 5, "dropped")]
    poses = spark.createDataFrame([(1, 0, i * 20_000_000, None if i % 7 == 0 else 0.0, 0.0, 1.0) for i in range(250)], POSES)
    assert {r.fate for r in gating.handling_gate(steps, poses, "who").where("who = 1").collect()} == {"walk"}
    assert gating.handling_gate(steps.where("false"), poses, "who").count() == 0

"""Poses that are known: orientation from rates and gravity, moves of the device, reports of gravity."""

import math
from collections import namedtuple

import pytest

from trailmark.operators import exploring
from trailmark.streaming.machines import orientation
from trailmark.streaming.run import run_batch

Reading = namedtuple("Reading", "t kind w x y z")
POSES = "who int, session int, t long, ux double, uy double, uz double, heading double"


def seed(yaw, pitch=0.0):
    """Lying on its back, top edge at azimuth yaw, tilted around its x axis by pitch."""
    y, p = math.radians(-yaw) / 2, math.radians(pitch) / 2
    return Reading(0, "seed", math.cos(y) * math.cos(p), math.cos(y) * math.sin(p), math.sin(y) * math.sin(p), math.sin(y) * math.cos(p))


def through(*readings):
    m = orientation()
    state = m.start()
    return [row for r in readings for row in m.step(state, r)]


def test_seed_keeps_azimuth():
    assert through(seed(30))[-1][5:] == (pytest.approx(30), pytest.approx(0, abs=1e-5))
    assert through(seed(0, 25))[-1][6] == pytest.approx(25)


def test_turn_around_the_vertical():
    rows = through(seed(0), *[Reading(10**9 + i * 20_000_000, "rate", None, 0.0, 0.0, math.radians(90)) for i in range(51)])
    assert rows[-1][5] == pytest.approx(-90, abs=1e-6)


def test_tilt_goes_to_gravity_and_azimuth_stays():
    rows = through(seed(40, 25), *[Reading(i, "pull", None, 0.0, 0.0, 9.81) for i in range(250)])
    assert rows[0][6] == pytest.approx(25) and rows[-1][6] < 1 and rows[-1][5] == pytest.approx(40, abs=2)


def test_strong_pulls_gaps_and_nulls():
    assert through(seed(0), *[Reading(i, "pull", None, 8.0, 0.0, 9.81) for i in range(100)])[-1][6] == pytest.approx(0, abs=1e-5)
    gap = through(seed(0), Reading(1, "rate", None, 0.0, 0.0, 1.0), Reading(10**10, "rate", None, 0.0, 0.0, 1.0))
    assert gap[-1][5] == pytest.approx(-math.degrees(0.1))
    assert through(Reading(1, "rate", None, 0.0, 0.0, 1.0)) == [] and len(through(seed(0), Reading(1, "pull", None, None, 0.0, 9.81))) == 1


def test_orientation_in_batch(spark):
    rows = spark.createDataFrame([(1, *seed(30)), (1, 5, "pull", None, 0.0, 0.0, 9.81), (2, 5, "pull", None, 0.0, 0.0, 9.81)], "who int, t long, kind string, w double, x double, y double, z double")
    assert sorted((r.who, r.t, round(r.azimuth, 6)) for r in run_batch(rows, "who", orientation()).collect()) == [(1, 0, 30.0), (1, 5, 30.0)]


def lying(who, turn, seconds, heading=lambda t: 10.0):
    return [(who, 0, i * 20_000_000, 0.0, math.sin(math.radians(turn(i * 0.02))), math.cos(math.radians(turn(i * 0.02))), heading(i * 0.02)) for i in range(seconds * 50)]


def ramp(t):
    return 10 + 80 * min(max((t - 5) / 2, 0), 1)


def test_moves(spark):
    poses = lying(1, ramp, 20, lambda t: 350.0 if t < 7.6 else 20.0) + lying(2, lambda t: 10.0, 20) + lying(3, lambda t: 10 + 4 * t, 20) + [(1, 0, 3, None, 0.0, 1.0, 1.0)]
    rows = exploring.moves(spark.createDataFrame(poses, POSES), "who").collect()
    assert [(r.who, r.seen / 1e9, r.began / 1e9, r.settled / 1e9, r.slow_settled / 1e9) for r in rows] == [(1, 6.0, 5.5, 7.0, 7.5)]
    assert rows[0].off == pytest.approx(-30)
    assert exploring.moves(spark.createDataFrame([], POSES), "who").count() == 0


def test_gravity_report(spark):
    poses, steps = spark.createDataFrame(lying(1, ramp, 10), POSES), spark.createDataFrame([(1, 0, 6_100_000_000), (1, 0, 6_200_000_000), (1, 0, None)], "who int, session int, t long")
    rows = sorted(exploring.gravity_report(poses, steps, "who").collect(), key=lambda r: r.t)
    assert len(rows) == 20 and rows[0].tilt == pytest.approx(10, abs=1e-4) and rows[-1].tilt == pytest.approx(90, abs=1e-4)
    assert rows[-1].ever == pytest.approx(80, abs=1e-4) and rows[-1].lately == 0 and sum(r.steps for r in rows) == 2
    assert rows[-1].walked == pytest.approx(90 - rows[12].tilt, abs=1e-4) and rows[11].walked == rows[11].ever

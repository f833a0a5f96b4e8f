"""Walkers that are found deep inside: through which door they must have come, or none."""

from trailmark.operators import entering

STEPS, DOORS = "who int, t long, x double, y double, building int, wall double", "door int, building int, x double, y double, inx double, iny double"


def walk(who, x, first, n, start=0, building=7, pace=0.7):
    """Northwards along x; the building is all that lies north of 0."""
    rows = []
    for i in range(n):
        y = round(first + i * pace, 3)
        rows.append((who, start + i, x, y, building if y > 0 else None, y if y > 0 else None))
    return rows


def found(spark, steps, doors, schema=STEPS):
    rows = entering.enters_deep(spark.createDataFrame(steps, schema), spark.createDataFrame(doors, DOORS), "who").collect()
    return sorted((r.who, r.t, r.building, r.door, None if r.metres is None else round(r.metres, 3), r.since) for r in rows)


def test_door_that_was_passed(spark):
    doors = [(1, 7, 3.0, 0.0, 0.0, 1.0), (2, 7, 1.0, 0.0, 1.0, 0.0), (3, 8, 0.0, 0.0, 0.0, 1.0), (4, 7, 40.0, 0.0, 0.0, 1.0)]
    # 15 metres inside are reached with step 32 from -7 on; the third is 34. Door 2 is nearer but leads east, 3 is another building's
    assert found(spark, walk(1, 0.0, -7.0, 40), doors) == [(1, 34, 7, 1, 3.0, 10)]


def test_no_door(spark):
    far, out = [(1, 7, 13.0, 0.0, 0.0, 1.0)], [(1, 7, 0.0, 0.0, 0.0, -1.0)]
    assert found(spark, walk(1, 0.0, -7.0, 40), far) == found(spark, walk(1, 0.0, -7.0, 40), out) == [(1, 34, 7, None, None, None)]
    # the last forty steps begin at 0.2: a door farther back is met from there, or not at all
    slow = walk(1, 0.0, -7.0, 60, pace=0.4)
    assert found(spark, slow, [(1, 7, 0.0, -7.0, 0.0, 1.0)]) == [(1, 57, 7, 1, 7.2, 18)]
    assert found(spark, slow, [(1, 7, 0.0, -13.0, 0.0, 1.0)]) == [(1, 57, 7, None, None, None)]


def test_third_step_in_a_row(spark):
    rows = walk(1, 0.0, -7.0, 34) + [(1, 34, 0.0, 14.0, 7, 14.0), (1, 35, 0.0, 16.0, 7, 16.0), (1, 36, 0.0, 16.0, 9, 16.0), (1, 37, 0.0, 16.0, 9, 16.0), (1, 38, 0.0, 16.0, 9, 16.0), (1, 39, 0.0, 16.0, 9, 16.0)]
    assert found(spark, rows, []) == [(1, 38, 9, None, None, None)]


def test_frozen_needs_the_fix(spark):
    schema = STEPS + ", frozen boolean, fix_building int, fix_wall double"
    for fix, entries in (((True, 7, 16.0), 1), ((True, 7, 11.0), 0), ((True, None, None), 0), ((False, None, None), 1)):
        assert len(found(spark, [(*r, *fix) for r in walk(1, 0.0, -7.0, 40)], [], schema)) == entries


def test_odd_rows(spark):
    rows = walk(1, 0.0, -7.0, 40) + [(1, None, 1.0, 1.0, 7, 20.0), (1, 100, None, 1.0, 7, 20.0), (2, 1, 0.0, 0.0, None, 20.0)]
    assert found(spark, rows, [(1, 7, None, 0.0, 0.0, 1.0)]) == [(1, 34, 7, None, None, None)]
    assert entering.enters_deep(spark.createDataFrame([], STEPS), spark.createDataFrame([], DOORS), "who").count() == 0

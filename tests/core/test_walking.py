"""Walking direction on made-up walks, step by step and by revision; a stream gives what a batch gives."""

import random
from types import SimpleNamespace

from trailmark.operators import graph, motion
from trailmark.sources import tables
from trailmark.streaming.machines import walking_direction
from trailmark.streaming.run import run_batch, run_stream

GAP = 600_000_000


class Walk:
    def __init__(self):
        self.rows, self.t = [], 0

    def go(self, n, way, phone, *, pose=0, phase=True, stairs=False, level=False, gap=GAP):
        for i in range(n):
            self.t += gap
            at = phone(i) if callable(phone) else phone
            self.rows.append((self.t, len(self.rows), float(at) % 360, float(way) % 360 if phase else None, stairs, pose, level))
        return self

    def stand(self, seconds):
        self.t += int(seconds * 1e9)
        return self

    def headings(self):
        """Headings as told first, and as told last."""
        m = walking_direction()
        s, first, last = m.start(), {}, {}
        for r in self.rows:
            for seq, revision, heading in m.step(s, SimpleNamespace(**dict(zip(m.columns, r, strict=True)))):
                assert revision == (first.get(seq) is not None) * (last[seq][0] + 1 if seq in last else 0)
                first.setdefault(seq, heading)
                last[seq] = (revision, heading)
        return [first[i] for i in range(len(self.rows))], [last[i][1] for i in range(len(self.rows))]


def near(got, want, within):
    return all(abs((g - want + 540) % 360 - 180) <= within for g in got)


def test_held_ahead_follows_the_phone():
    first, last = Walk().go(10, 30, 30).headings()
    assert near(first, 30, 1) and first == last


def test_held_at_an_angle_is_learnt():
    first, _ = Walk().go(20, 30, 60).headings()
    assert near(first[:2], 60, 5) and near(first[-5:], 30, 5)


def test_held_far_off_is_learnt_at_once_and_told_again():
    first, last = Walk().go(12, 30, 150).headings()
    assert near(first[4:], 30, 5) and near(last, 30, 5) and not near(first[:3], 30, 90)


def test_sidestep_from_standing_is_told_again():
    w = Walk().go(8, 30, 30).stand(4).go(8, 120, 30)
    first, last = w.headings()
    assert near(last[:8], 30, 10) and near(last[8:], 120, 10) and near(first[12:], 120, 10)


def test_body_turn_is_followed_at_once():
    w = Walk().go(8, 0, 0).go(8, 90, 90)
    first, last = w.headings()
    assert near(first[8:], 90, 15) and near(last[:8], 0, 5)


def test_phone_turned_aside_keeps_the_way_and_tells_the_turn_again():
    w = Walk().go(8, 0, 0).go(10, 0, 90)
    first, last = w.headings()
    assert near(first[8:10], 90, 5) and near(last, 0, 10) and near(first[11:], 0, 10)


def test_glance_aside_keeps_the_way():
    _, last = Walk().go(8, 0, 0).go(2, 0, 60).go(6, 0, 0).headings()
    assert near(last, 0, 10)


def test_put_away_backwards_keeps_the_way():
    first, _ = Walk().go(8, 30, 30).go(3, 30, lambda i: 30 + 60 * i, pose=None).go(8, 30, 210, pose=1).headings()
    assert near(first, 30, 10)


def test_out_of_the_pocket_points_ahead():
    first, _ = Walk().go(8, 75, 30, pose=1).go(3, 30, 0, pose=None).go(8, 30, 30, pose=2, level=True).headings()
    assert near(first[11:], 30, 5)


def test_phase_means_nothing_on_stairs():
    first, last = Walk().go(8, 0, 0).go(8, 120, 0, stairs=True).headings()
    assert near(first, 0, 5) and first == last


def test_weak_phase_and_long_turns_are_body_turns():
    w = Walk().go(6, 0, 0).go(9, 0, lambda i: 25 * (i + 1), phase=False).go(4, 225, 225)
    first, _ = w.headings()
    assert near(first[-4:], 225, 20)


def test_stream_tells_what_the_batch_tells(spark):
    rng, rows = random.Random(2), []
    for k in range(9):
        w = Walk()
        for _ in range(6):
            way = rng.uniform(0, 360)
            w.go(rng.randint(1, 8), way, way + rng.choice([0, 0, 40, 120]), pose=rng.choice([0, 0, 1, None]), phase=rng.random() < 0.8, stairs=rng.random() < 0.1, level=rng.random() < 0.2)
        rows += [(k, *r) for r in w.rows]
    schema = "who int, t long, seq long, phone double, phase double, stairs boolean, pose int, level boolean"
    steps = spark.createDataFrame(rows, schema)
    batch = run_batch(steps, "who", walking_direction())
    files = tables.in_parts(steps, graph.new_path(spark, "walks"), "who", "seq", 3)
    out = graph.new_path(spark, "ways")
    stream = run_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files), "who", walking_direction())
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    want = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want
    assert any(r[2] for r in want) and max(r[2] for r in want) <= 6
    assert motion.latest_revision(batch, ["who", "seq"]).count() == len(rows)

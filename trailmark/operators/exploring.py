"""What recordings tell about a device's pose: how it lay, when it was moved, since when, and when it settled. All by windows over bins of half a second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Degrees within three bins (1.5 s) that are a move, degrees from the oldest of ten bins (5 s) where it began, and degrees within a bin or two below which it has settled; bins it may take to settle (4 s); nanoseconds without a move that part two.
MOVED, BACK, BEGAN, FAR, SETTLED, SLOWEST, APART = 45.0, 3, 15.0, 10, 12.0, 8, 3_000_000_000
#: Nanoseconds of a bin.
BIN = 500_000_000


def _degrees(a: Column, b: Column) -> Column:
    dot = a["ux"] * b["ux"] + a["uy"] * b["uy"] + a["uz"] * b["uz"]
    return F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))), 6)


def pose_bins(poses: DataFrame, key: str) -> DataFrame:
    """key, session, t, u (upwards in the device's axes, of length 1), east and north (where the device points, summed) of bins that have poses.

    poses(key, session, t, ux, uy, uz, heading in degrees). Poses with nulls are left out.
    """
    ok = poses.where("t is not null and ux is not null and uy is not null and uz is not null and heading is not null")
    turn = F.radians(F.col("heading"))
    b = ok.groupBy(key, "session", (F.floor(F.col("t") / BIN) * BIN).alias("t")).agg(*[F.avg(c).alias(c) for c in ("ux", "uy", "uz")], F.round(F.sum(F.sin(turn)), 9).alias("east"), F.round(F.sum(F.cos(turn)), 9).alias("north"))
    norm = F.greatest(F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz")), F.lit(1e-9))
    return b.select(key, "session", "t", F.struct(*[F.round(F.col(c) / norm, 9).alias(c) for c in ("ux", "uy", "uz")]).alias("u"), "east", "north")


def gravity_report(poses: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """key, session, t, tilt, lately, ever, walked, steps: of each bin the screen's tilt, degrees from two seconds ago, from the start and from the last step's bin, and steps in it.

    steps(key, session, t). A step belongs to its bin; one in a bin without poses is told with none.
    """
    keys = [key, "session"]
    order = Window.partitionBy(*keys).orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    n = steps.where("t is not null").groupBy(*keys, (F.floor(F.col("t") / BIN) * BIN).alias("t")).agg(F.count("*").alias("steps"))
    b = pose_bins(poses, key).join(n, [*keys, "t"], "left").fillna(0, ["steps"])
    stepped = F.last(F.when(F.col("steps") > 0, F.col("u")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("_first", F.first("u").over(upto)).withColumn("_step", F.coalesce(stepped, F.col("_first"))).withColumn("_two", F.first("u").over(order.rangeBetween(-2_000_000_000, 0)))
    tilt = F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("u.uz"))))), 6)
    return b.select(*keys, "t", tilt.alias("tilt"), _degrees(F.col("u"), F.col("_two")).alias("lately"), _degrees(F.col("u"), F.col("_first")).alias("ever"), _degrees(F.col("u"), F.col("_step")).alias("walked"), "steps")


def moves(poses: DataFrame, key: str) -> DataFrame:
    """key, session, seen, began, settled, slow_settled, off: times the device was moved to another pose.

    A move is seen in a bin that is more than 45 degrees off one of the three bins before it, where none was seen in the three seconds before.
    It began with the first bin, of the ten up to then, that is more than 15 degrees off the oldest. It has settled with the first later bin
    that is within 12 degrees of the bin before (slow: of both before), after four seconds at the latest. off is the heading there less the mean heading
    from two to four seconds on, in degrees between -180 and 180, null where the recording ends before.
    """
    keys = [key, "session"]
    order = Window.partitionBy(*keys).orderBy("t")
    b = pose_bins(poses, key)
    before = F.collect_list("u").over(order.rangeBetween(-FAR * BIN, 0))
    after = F.collect_list(F.struct("t", "u", "east", "north")).over(order.rangeBetween(-2 * BIN, (2 * SLOWEST + 1) * BIN))
    near = F.collect_list("u").over(order.rangeBetween(-BACK * BIN, -1))
    b = b.withColumn("_off", F.exists(near, lambda v: _degrees(F.col("u"), v) > MOVED)).withColumns({"_times": F.collect_list("t").over(order.rangeBetween(-FAR * BIN, 0)), "_before": before, "_after": after})
    again = F.coalesce(F.max(F.when(F.col("_off"), F.col("t"))).over(order.rangeBetween(-APART, -1)).isNotNull(), F.lit(False))
    b = b.withColumn("_again", again).where("_off and not _again")
    far = F.filter(F.arrays_zip(F.col("_times").alias("t"), F.col("_before").alias("u")), lambda p: _degrees(p["u"], F.col("_before")[0]) > BEGAN)
    later = lambda k: F.filter(
        F.col("_after"), lambda p: (p["t"] > F.col("t")) & (p["t"] <= F.col("t") + SLOWEST * BIN)
        & F.forall(F.filter(F.col("_after"), lambda o: (o["t"] < p["t"]) & (o["t"] >= p["t"] - k * BIN)), lambda o: _degrees(p["u"], o["u"]) < SETTLED))
    b = b.withColumn("settled", F.coalesce(F.get(later(1), F.lit(0))["t"], F.col("t") + SLOWEST * BIN)).withColumn("slow_settled", F.coalesce(F.get(later(2), F.lit(0))["t"], F.col("t") + SLOWEST * BIN))
    final = F.filter("_after", lambda p: p["t"].between(F.col("settled") + 4 * BIN, F.col("settled") + 8 * BIN))
    here = F.filter("_after", lambda p: p["t"] == F.col("settled"))
    total = lambda rows, c: F.aggregate(rows, F.lit(0.0), lambda a, p: a + p[c])
    angle = lambda rows: F.degrees(F.atan2(total(rows, "east"), total(rows, "north")))
    off = F.when((F.size(final) > 0) & (F.size(here) > 0), F.round(F.pmod(angle(here) - angle(final) + 540.0, F.lit(360.0)) - 180.0, 6))
    return b.select(*keys, F.col("t").alias("seen"), F.coalesce(F.get(far, F.lit(0))["t"], F.col("t")).alias("began"), "settled", "slow_settled", off.alias("off"))

"""Lift rides in bins of half a second: a push, and an opposite one of like strength, with no walk between. All by windows over sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written
from .motion import rolling_upper_median

# Bins of the baseline and fewest of them; m/s² over it that push, fewest bins and least m/s of a push, and its mean deviation; deviations of a calm bin, and of one with a "step" that is a jerk of the cabin.
BASE, FEWEST, PUSH, BINS, LEAST, STEADY, CALM, JERK = 40, 10, 0.15, 2, 0.4, 0.45, 0.8, 0.55
# Nanoseconds of a bin and of a ride, ratio of the pushes; steps between them, or while the device is handled, with the nanoseconds those may take and the m/s both pushes need then; and, for a relaxed ride, that need and the deviation of the bin before it.
BIN, LONGEST, RATIO, STEPS, HANDLED, SPAN, NEED, RELAXED_NEED, STILL = 500_000_000, 45_000_000_000, (0.5, 2.0), 2, 6, 3_000_000_000, 1.0, 0.6, 1.0


def pushes(bins: DataFrame, key: str) -> DataFrame:
    """key, session, start, stop, sign, dv, loose, before (the deviation of the bin before) of pushes that may belong to a ride.

    bins(key, session, t, mean, std, steps): consecutive bins of half a second within each session, mean the acceleration upwards. A push is
    a run of bins on one side of the baseline (the upper median of up to forty bins before), calm ones or with a jerk of the cabin for a
    step; one noisy bin between two such belongs to it, a second one ends it. Its calm bins are steady on average, or all but the
    first are and it is loose. Sums are rounded to nine places, so their order doesn't matter.
    """
    keys = [key, "session"]
    order = Window.partitionBy(*keys).orderBy("t")
    rows = rolling_upper_median(bins, keys, ["t"], "mean", BASE, FEWEST)
    rows = rows.withColumn("_a", F.col("mean") - F.col("baseline"))
    rows = rows.withColumn("_s", F.when(F.col("_a") > PUSH, 1).when(F.col("_a") < -PUSH, -1).otherwise(0))
    rows = rows.withColumn("_quiet", ((F.col("std") < CALM) & (F.col("steps") == 0)) | ((F.col("std") < JERK) & (F.col("steps") > 0)))
    near = lambda f: (f("_s").over(order) == F.col("_s")) & f("_quiet").over(order)
    bridge = ~F.col("_quiet") & (F.col("_s") != 0) & F.coalesce(near(F.lag) & near(F.lead), F.lit(False))
    rows = rows.withColumn("_bridge", bridge).withColumn("_in", (F.col("_s") != 0) & (F.col("_quiet") | F.col("_bridge"))).withColumn("before", F.lag("std").over(order))
    new = F.coalesce((F.lag("_s").over(order) != F.col("_s")) | ~F.lag("_in").over(order), F.lit(True))
    rows = rows.where("_s is not null").withColumn("_new", new.cast("int"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("_new").over(upto)).where("_in")
    run = Window.partitionBy(*keys, "_run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_b", F.sum(F.col("_bridge").cast("int")).over(run)).where("not _bridge or _b = 1").withColumn("_part", F.greatest(F.lit(0), F.col("_b") - 1))
    calm = F.when(F.col("_quiet"), F.col("std"))
    got = rows.groupBy(*keys, "_run", "_part").agg(
        F.min("t").alias("start"), (F.max("t") + BIN).alias("stop"), F.first("_s").alias("sign"), F.round(F.sum(F.col("_a") * 0.5), 9).alias("dv"), F.count("*").alias("_n"), F.round(F.avg(calm), 9).alias("_std"), F.sum(calm).alias("_sum"), F.count(calm).alias("_calm"),
        F.min_by(calm, F.when(F.col("_quiet"), F.col("t"))).alias("_first"), F.min_by("before", "t").alias("before"))
    got = got.where((F.col("_n") >= BINS) & (F.abs("dv") >= LEAST)).withColumn("loose", F.col("_std") >= STEADY)
    but_first = (F.col("_calm") >= 3) & (F.col("_first") >= STEADY) & (F.round((F.col("_sum") - F.col("_first")) / (F.col("_calm") - 1), 9) < STEADY)
    return got.where(~F.col("loose") | but_first).select(*keys, "start", "stop", "sign", "dv", "loose", "before")


def lift_rides(bins: DataFrame, key: str) -> DataFrame:
    """key, session, start, stop, direction (1 up, -1 down) and relaxed of lift rides in bins as pushes() takes them.

    Of a session's pushes two neighbours are a ride if they are opposite, of like strength, at most 45 seconds apart and with no walk between: two
    steps, or six within three seconds where both pushes are strong (the device is handled). With a loose push, or where handling goes
    with weaker ones, the ride is relaxed, and the bin before it must be still. A push belongs to one ride, the earlier.
    """
    keys = [key, "session"]
    p = written(pushes(bins, key), "lift-pushes")
    order = Window.partitionBy(*keys).orderBy("start")
    # steps up to each push's ends, in one pass with the bins; of those between, what is a walk and when it was
    walked = F.when((F.col("steps") > 0) & ~((F.col("std") < JERK) & (F.col("steps") > 0)), F.col("steps")).otherwise(0)
    marks = p.select(*keys, F.explode(F.array("start", "stop")).alias("t")).distinct()
    marks = marks.select("*", F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_walk"), F.lit(0).cast("long").alias("_steps"), F.lit(None).cast("long").alias("_at"))
    both = bins.select(*keys, "t", F.lit(1).alias("_k"), walked.cast("long").alias("_walk"), F.col("steps").cast("long").alias("_steps"), F.when(F.col("steps") > 0, F.col("t").cast("long")).alias("_at")).unionByName(marks)
    w = Window.partitionBy(*keys).orderBy("t", "_k")
    upto, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"_walk": F.sum("_walk").over(upto), "_steps": F.sum("_steps").over(upto), "_last": F.last("_at", ignorenulls=True).over(upto), "_next": F.first("_at", ignorenulls=True).over(on)}).where("_k = 0").select(*keys, "t", "_walk", "_steps", "_last", "_next")
    at = lambda c: both.select(*keys, F.col("t").alias(c), F.struct("_walk", "_steps", "_last", "_next").alias(f"_{c}"))
    p = p.join(at("start"), [*keys, "start"]).join(at("stop"), [*keys, "stop"])
    nxt = F.lead(F.struct("start", "stop", "sign", "dv", "loose", "_start")).over(order)
    p = p.withColumn("_q", nxt)
    walk, steps = F.col("_q._start._walk") - F.col("_stop._walk"), F.col("_q._start._steps") - F.col("_stop._steps")
    span = F.when(steps > 0, F.col("_q._start._last") - F.col("_stop._next")).otherwise(0)
    weaker, ratio = F.least(F.abs("dv"), F.abs("_q.dv")), F.abs("_q.dv") / F.abs("dv")
    handled = lambda need: (weaker >= need) & (steps <= HANDLED) & (span <= SPAN)
    fits = (F.col("_q.sign") == -F.col("sign")) & (F.col("_q.start") - F.col("stop") <= LONGEST) & ratio.between(*RATIO)
    strict = fits & ~F.col("loose") & ~F.col("_q.loose") & ((walk <= STEPS) | handled(NEED))
    relaxed = fits & ~strict & ((walk <= STEPS) | handled(RELAXED_NEED)) & (F.coalesce("before", F.lit(0.0)) < STILL)
    p = p.withColumn("_how", F.when(F.coalesce(strict, F.lit(False)), 1).when(F.coalesce(relaxed, F.lit(False)), 2))
    # in a row of neighbours that all fit, every second pair is a ride
    chain = F.sum(F.when(F.lag("_how").over(order).isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("_chain", chain).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_chain").orderBy("start")))
    rides = p.where("_how is not null and _nth % 2 = 1")
    return rides.select(*keys, "start", F.col("_q.stop").alias("stop"), F.col("sign").alias("direction"), (F.col("_how") == 2).alias("relaxed"))

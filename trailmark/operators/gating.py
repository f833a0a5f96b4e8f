"""Which steps are a walk and which are only the device being put away, by windows over bursts of steps and turns of the device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

# Fixed values, times in nanoseconds: a pause ends a burst; fewest steps of a walk and the least time they take, in a hand and in a pocket; how long weak steps wait in a hand, and in a pocket or after the device was handled.
PAUSE, FEWEST, IN_HAND, IN_POCKET, WEAK_IN_HAND, WEAK = 1_500_000_000, 3, 1_500_000_000, 3_000_000_000, 4_000_000_000, 8_000_000_000
# Medians of the peaks that need not wait, in a hand and in a pocket, and one peak that is enough there; how level a device in a hand lies; degrees of a turn that is handling.
HAND_PEAK, POCKET_PEAK, KICK, LEVEL, HANDLED = 1.3, 1.5, 3.0, 0.5, 30.0
# Kicks of an upright device that are a walk whatever it swings, and their least distance.
KICKS, STRIDE = 3, 550_000_000
# A rest after which steps in a hand need a rhythm; a rhythm's steps and their distances; the distance that parts runs; steps at rhythm's least distance that do as well.
REST, RHYTHM, SHORTEST, WIDEST, JOINED, SPREAD = 20_000_000_000, 4, 450_000_000, 900_000_000, 1_200_000_000, 5
#: Nanoseconds of a bin of poses, and degrees between neighbouring bins of a device that is being turned.
BIN, TURNING = 500_000_000, 12.0


def turns(poses: DataFrame, key: str) -> DataFrame:
    """key, session, t, level, now, handling, ended: bins of half a second, how level the device lay when last still and lies now, whether it is handled, and how many handlings have ended.

    poses(key, session, t, ux, uy, uz): upwards, in the device's axes. Neighbouring bins whose means are twelve degrees and more apart are a turn; it is
    handling if it leads more than thirty degrees from the bin before it. So a device that swings in a pocket isn't handled.
    """
    keys = [key, "session"]
    order = Window.partitionBy(*keys).orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    b = poses.where("ux is not null and uy is not null and uz is not null").groupBy(*keys, (F.floor(F.col("t") / BIN) * BIN).alias("t")).agg(*[F.avg(c).alias(c) for c in ("ux", "uy", "uz")])
    norm = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"))
    b = b.withColumn("_u", F.struct(*[F.round(F.col(c) / F.greatest(norm, F.lit(1e-9)), 9).alias(c) for c in ("ux", "uy", "uz")])).select(*keys, "t", "_u")
    b = b.withColumn("_last", F.lag("_u").over(order))
    b = b.withColumn("_turning", F.coalesce(_degrees(F.col("_u"), F.col("_last")) >= TURNING, F.lit(False)))
    still = F.when(~F.col("_turning"), F.col("_u"))
    b = b.withColumn("_still", F.last(still, ignorenulls=True).over(upto)).withColumn("_part", F.sum((~F.col("_turning")).cast("int")).over(upto))
    far = F.col("_turning") & (_degrees(F.col("_u"), F.col("_still")) > HANDLED)
    b = b.withColumn("handling", F.col("_turning") & F.max(far).over(Window.partitionBy(*keys, "_part")))
    over = F.coalesce(F.lag("handling").over(order), F.lit(False)) & ~F.col("handling")
    return b.withColumn("_over", over.cast("long")).select(*keys, "t", F.abs("_still.uz").alias("level"), F.abs("_u.uz").alias("now"), "handling", F.sum("_over").over(upto).alias("ended"))


def _degrees(a: Column, b: Column) -> Column:
    dot = a["ux"] * b["ux"] + a["uy"] * b["uy"] + a["uz"] * b["uz"]
    return F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))), 6)


def handling_gate(steps: DataFrame, poses: DataFrame, key: str) -> DataFrame:
    """key, session, t, peak, fate and told of every step: fate is walk, restored or dropped, told when that is known.

    steps(key, session, t, peak), poses as turns() takes them; steps without t are left out, a peak that is null is weak, steps of one time are one,
    the strongest. A burst is steps without a pause. Each handling that ends within a burst begins a new piece of it. The first piece whose
    steps say walk while the device isn't handled opens the gate: it walks from its beginning, told then, and so does all that
    follows in the burst. Earlier pieces are dropped once handled, but come back where device and walk are both in a hand. A weak burst in a
    hand is let go when it ends. Three kicks of an upright device are a walk from the first on, however it swings. In a hand, after a rest of twenty seconds without a walk, a piece counts from the run that has a rhythm.
    """
    keys = [key, "session"]
    order = Window.partitionBy(*keys).orderBy("t", "_kind")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    s = steps.where("t is not null").groupBy(*keys, F.col("t").cast("long").alias("t")).agg(F.coalesce(F.max("peak"), F.lit(0.0)).alias("peak"))
    pose = F.struct("level", "now", "handling", "ended")
    both = s.select(*keys, "t", F.lit(1).alias("_kind"), "peak", F.lit(None).cast("struct<level:double,now:double,handling:boolean,ended:bigint>").alias("_pose"))
    both = both.unionByName(turns(poses, key).select(*keys, "t", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("peak"), pose.alias("_pose")))
    s = both.withColumn("_pose", F.last("_pose", ignorenulls=True).over(upto)).where("_kind = 1")
    at, run = Window.partitionBy(*keys).orderBy("t"), Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select(*keys, "t", "peak", F.coalesce("_pose.level", F.lit(1.0)).alias("_level"), F.coalesce("_pose.now", F.lit(1.0)).alias("_now"), F.coalesce("_pose.handling", F.lit(False)).alias("_handling"), F.coalesce("_pose.ended", F.lit(0)).alias("_ended"), (F.col("t") - F.lag("t").over(at)).alias("_gap"))
    s = s.withColumn("_burst", F.sum(F.when(F.col("_gap") < PAUSE, 0).otherwise(1)).over(run))
    burst = Window.partitionBy(*keys, "_burst")
    s = s.withColumn("_part", F.col("_ended") - F.min("_ended").over(burst)).withColumn("_stop", F.max("t").over(burst) + PAUSE).withColumn("_parts", F.max("_part").over(burst))
    s = s.withColumn("_hand", F.first("_level").over(Window.partitionBy(*keys, "_burst", "_part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)) >= LEVEL)
    s = written(s, "gate-steps")
    # both readings of each burst: after a walk lately, and after a rest, when steps in a hand count from the run with a rhythm
    piece = Window.partitionBy(*keys, "_burst", "_part").orderBy("t")
    inside = piece.rowsBetween(Window.unboundedPreceding, 0)
    r = s.withColumn("_gap", F.when(F.row_number().over(piece) > 1, F.col("_gap"))).withColumn("_run", F.sum(F.when(F.col("_gap") <= JOINED, 0).otherwise(1)).over(inside))
    in_run = Window.partitionBy(*keys, "_burst", "_part", "_run").orderBy("t")
    even = F.col("_gap").between(SHORTEST, WIDEST)
    steady = (F.row_number().over(in_run) >= RHYTHM) & (F.sum(F.when(even, 1).otherwise(0)).over(in_run.rowsBetween(2 - RHYTHM, 0)) == RHYTHM - 1)
    r = r.withColumn("_nth", F.row_number().over(in_run)).withColumn("_steady", steady)
    r = r.withColumn("_wide", F.sum(F.when((F.col("_nth") == 1) | (F.col("_gap") >= SHORTEST), 1).otherwise(0)).over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_from", F.min(F.when(F.col("_steady") | (F.col("_wide") >= SPREAD), F.struct("t", "_run"))).over(Window.partitionBy(*keys, "_burst", "_part")))
    r = r.withColumn("_rested", F.explode(F.array(F.lit(False), F.lit(True)))).where(~F.col("_rested") | ~F.col("_hand") | (F.col("_run") >= F.col("_from._run")))
    mode = [*keys, "_rested", "_burst"]
    held = Window.partitionBy(*mode, "_part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumns({"_n": F.count("*").over(held), "_first": F.min("t").over(held), "_top": F.max("peak").over(held), "_hard": F.sum((F.col("peak") >= HAND_PEAK).cast("int")).over(held), "_harder": F.sum((F.col("peak") >= POCKET_PEAK).cast("int")).over(held)})
    # kicks of an upright device, far enough from the one before
    along = Window.partitionBy(*mode).orderBy("t")
    r = r.withColumn("_lying", F.sum((F.col("_now") >= LEVEL).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    up = Window.partitionBy(*mode, "_lying").orderBy("t")
    upright = up.rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_hit", F.when((F.col("peak") >= KICK) & (F.col("_now") < LEVEL), F.col("t")))
    r = r.withColumn("_hit", F.when(F.coalesce(F.col("_hit") - F.last("_hit", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)) >= STRIDE, F.lit(True)), F.col("_hit")))
    r = r.withColumns({"_hits": F.count("_hit").over(upright), "_since": F.min("_hit").over(upright)})
    span, half, palm = F.col("t") - F.col("_first"), F.floor(F.col("_n") / 2), F.col("_hand") | (F.col("_level") >= LEVEL)
    # an upper median reaches a value if no more than half of all lie below it
    in_hand = (span >= IN_HAND) & ((F.col("_n") - F.col("_hard") <= half) | (span >= F.when(F.col("_part") > 0, WEAK).otherwise(WEAK_IN_HAND)))
    in_pocket = (span >= IN_POCKET) & ((F.col("_top") >= KICK) | (F.col("_n") - F.col("_harder") <= half) | (span >= WEAK))
    rhythm = ~F.col("_rested") | ~F.col("_hand") | (F.col("t") >= F.col("_from.t"))
    ready = (F.col("_n") >= FEWEST) & rhythm & ~F.col("_handling")
    opens = ready & F.when(palm, in_hand).otherwise(in_pocket)
    waited = ready & F.col("_hand") & (span >= IN_HAND) & (F.col("_part") == F.col("_parts")) & (F.col("t") + PAUSE == F.col("_stop"))
    waited = waited & ((F.col("_part") == 0) | (F.col("_stop") - F.col("_first") >= WEAK))
    kicked = ~opens & (F.col("_hits") >= KICKS) & F.col("_hit").isNotNull()
    told = F.when(opens | kicked, F.col("t")).when(waited, F.when(F.col("_part") == 0, F.least(F.col("_stop"), F.col("_first") + WEAK_IN_HAND)).otherwise(F.col("_first") + WEAK))
    g = r.withColumn("_told", told).where("_told is not null").groupBy(*mode).agg(F.min(F.struct(F.col("_told").alias("at"), F.when(kicked, F.col("_since")).otherwise(F.col("_first")).alias("since"), F.col("_part").alias("part"), (palm & ~kicked).alias("palm"))).alias("_gate"))
    g = g.groupBy(*keys, "_burst").agg(F.max(F.when(~F.col("_rested"), F.col("_gate"))).alias("_lately"), F.max(F.when(F.col("_rested"), F.col("_gate"))).alias("_rest"))
    ends = s.groupBy(*keys, "_burst").agg(F.min("t").alias("_begin"), F.max("t").alias("_end"))
    # a burst that a walk lately would let go walks if one with a rhythm came before it, each no more than a rest after the last
    g = written(g.join(ends, [*keys, "_burst"]), "gate-bursts").where("_lately is not null")
    by = Window.partitionBy(*keys).orderBy("_burst")
    fresh = F.coalesce(F.col("_begin") - F.lag("_end").over(by) >= REST, F.lit(True))
    g = g.withColumn("_sure", F.col("_rest").isNotNull() | F.lag("_burst").over(by).isNull()).withColumn("_chain", F.sum(fresh.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    sure = Window.partitionBy(*keys, "_chain").orderBy("_burst").rowsBetween(Window.unboundedPreceding, -1)
    early = F.coalesce(F.max("_sure").over(sure), F.lit(False)) | F.lag("_burst").over(by).isNull()
    g = g.withColumn("_gate", F.when(early, F.col("_lately")).otherwise(F.col("_rest"))).where("_gate is not null").select(*keys, "_burst", "_gate")
    s = s.withColumn("_origin", F.first("_hand").over(burst.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))).join(g, [*keys, "_burst"], "left")
    walks = F.col("t") >= F.col("_gate.since")
    back = (F.col("_part") < F.col("_gate.part")) & F.col("_origin") & F.col("_gate.palm")
    fate = F.when(walks, "walk").when(back, "restored").otherwise("dropped")
    return s.withColumn("fate", fate).select(*keys, "t", "peak", "fate", F.when(F.col("fate") == "dropped", F.col("_stop")).otherwise(F.greatest(F.col("t"), F.col("_gate.at"))).alias("told"))

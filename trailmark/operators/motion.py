"""Motion readings in batch: sessions, bins, turns, filters and votes, in windows over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import wrapped

# Peaks of a barely detected and of a full step, and the share of a full step's length the former has.
STEP_PEAK, FULL_PEAK, LEAST_SHARE = 0.6, 1.2, 0.2
# Metres of a storey, how far from whole storeys a lift's height may be, within a building and at its last floors.
STOREY, STOREY_SLACK, END_SLACK = 3.75, 0.35, 0.75


def sessions(rows: DataFrame, keys: list[str], t: str, gap: float, reaches: bool = True) -> DataFrame:
    """Adds session, from 1: a gap of at least (reaches) or of more than gap begins a new one."""
    order = Window.partitionBy(*keys).orderBy(t)
    wait = F.col(t) - F.lag(t).over(order)
    new = F.when(wait.isNull() | (wait >= gap if reaches else wait > gap), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def bins(rows: DataFrame, keys: list[str], t: str, value: str, width: int, gap: int) -> DataFrame:
    """keys, session, bin, n, mean and population deviation of bins that begin with each session's first reading."""
    s = sessions(rows, keys, t, gap)
    first = F.min(t).over(Window.partitionBy(*keys, "session"))
    s = s.withColumn("bin", F.floor((F.col(t) - first) / width))
    return s.groupBy(*keys, "session", "bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def rolling_upper_median(rows: DataFrame, keys: list[str], order: list[str], value: str, length: int = 40, least: int = 10) -> DataFrame:
    """Adds baseline: the upper median of up to length values before a row; null where there are fewer than least."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-length, -1)
    held = F.array_sort(F.collect_list(value).over(before))
    return rows.withColumn("_held", held).withColumn("baseline", F.when(F.size("_held") >= least, F.get("_held", (F.size("_held") / 2).cast("int")))).drop("_held")


def upper_median(values: Column) -> Column:
    """Of an array, the value at half its length, counted from 0, once sorted."""
    return F.get(F.array_sort(values), (F.size(values) / 2).cast("int"))


def middle(values: Column) -> Column:
    """Median of an array, the mean of the two middle values where their number is even; null without values."""
    v, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(v, ((n - 1) / 2).cast("int")) + F.get(v, (n / 2).cast("int"))) / 2)


def circular_mean(rows: DataFrame, keys: list[str], angle: str, agree: float = 0.95) -> DataFrame:
    """Mean direction in degrees, the resultant's length, and whether it is at least agree."""
    got = rows.groupBy(*keys).agg(F.sum(F.sin(F.radians(angle))).alias("_s"), F.sum(F.cos(F.radians(angle))).alias("_c"), F.count("*").alias("n"))
    length = F.hypot("_s", "_c") / F.col("n")
    return got.select(*keys, F.degrees(F.atan2("_s", "_c")).alias("direction"), length.alias("resultant"), (length >= agree).alias("consistent"))


def lagged_correlation(rows: DataFrame, keys: list[str], t: str, h: str, v: str, lags: int) -> DataFrame:
    """keys, lag and the sum of h(i) v(i+lag) - h(i+lag) v(i), normalised by the root of both sums of squares."""
    order = Window.partitionBy(*keys).orderBy(t)
    terms = [F.struct(F.lit(k).alias("lag"), (F.col(h) * F.lead(v, k).over(order) - F.lead(h, k).over(order) * F.col(v)).alias("x")) for k in range(1, lags + 1)]
    wide = rows.withColumn("_t", F.array(*terms))
    norm = rows.groupBy(*keys).agg(F.sqrt(F.sum(F.col(h) * F.col(h)) * F.sum(F.col(v) * F.col(v))).alias("_n"))
    sums = wide.select(*keys, F.explode("_t").alias("_t")).groupBy(*keys, F.col("_t.lag").alias("lag")).agg(F.sum("_t.x").alias("_x"))
    return sums.join(norm, keys).select(*keys, "lag", F.when(F.col("_n") > 0, F.col("_x") / F.nullif("_n", F.lit(0.0))).alias("correlation"))


def cadence(rows: DataFrame, keys: list[str], t: str, value: str, lags: int) -> DataFrame:
    """keys, lag and height of the first local peak of the autocorrelation."""
    order = Window.partitionBy(*keys).orderBy(t)
    centred = rows.withColumn("_v", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    wide = centred.withColumn("_t", F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("_v") * F.lead("_v", k).over(order)).alias("x")) for k in range(lags + 2)]))
    sums = wide.select(*keys, F.explode("_t").alias("_t")).groupBy(*keys, F.col("_t.lag").alias("lag")).agg(F.sum("_t.x").alias("x"))
    by_lag = Window.partitionBy(*keys).orderBy("lag")
    peaks = sums.withColumn("_a", F.lag("x").over(by_lag)).withColumn("_b", F.lead("x").over(by_lag)).withColumn("_z", F.first("x").over(by_lag)).where("lag > 0 and x > _a and x >= _b")
    return peaks.groupBy(*keys).agg(F.min(F.struct("lag", (F.col("x") / F.nullif("_z", F.lit(0.0))).alias("height"))).alias("_p")).select(*keys, "_p.*")


def principal_axis(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Direction in degrees, -90 to 90, of the greatest spread, and the share of the variance along it."""
    got = rows.groupBy(*keys).agg(F.var_pop(x).alias("_a"), F.var_pop(y).alias("_b"), F.covar_pop(x, y).alias("_c"))
    root = F.sqrt((F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b")) + 4 * F.col("_c") * F.col("_c"))
    total = F.col("_a") + F.col("_b")
    return got.select(*keys, F.degrees(F.atan2(2 * F.col("_c"), F.col("_a") - F.col("_b")) / 2).alias("axis"), ((total + root) / 2 / F.nullif(total, F.lit(0.0))).alias("share"))


def trail(rows: DataFrame, keys: list[str], order: list[str], heading: str, length: str) -> DataFrame:
    """Adds x, y (running displacement, y down) and turned (sum of wrapped heading changes)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    change = F.coalesce(wrapped(F.col(heading) - F.lag(heading).over(w)), F.lit(0.0))
    moved = rows.withColumn("_c", change)
    return moved.withColumn("x", F.sum(F.col(length) * F.sin(F.radians(heading))).over(upto)).withColumn("y", F.sum(-F.col(length) * F.cos(F.radians(heading))).over(upto)).withColumn("turned", F.sum("_c").over(upto)).drop("_c")


def height_gain(rows: DataFrame, keys: list[str], order: list[str], acceleration: str, dt: float) -> DataFrame:
    """Per key the height that acceleration integrates to twice, speed being 0 at both ends: what is left of it goes linearly."""
    w = Window.partitionBy(*keys).orderBy(*order)
    speed = F.sum(acceleration).over(w.rowsBetween(Window.unboundedPreceding, 0)) * dt
    s = rows.withColumn("_v", speed).withColumn("_k", F.row_number().over(w))
    s = s.withColumn("_before", F.coalesce(F.lag("_v").over(w), F.lit(0.0)))
    whole = Window.partitionBy(*keys)
    s = s.withColumn("_n", F.count("*").over(whole)).withColumn("_drift", F.max_by("_v", "_k").over(whole))
    part = ((F.col("_before") + F.col("_v")) / 2 - F.col("_drift") * (F.col("_k") - 0.5) / F.col("_n")) * dt
    return s.groupBy(*keys).agg(F.sum(part).alias("height"))


def agreed_votes(rows: DataFrame, keys: list[str], order: list[str], vote: str, needed: int = 3) -> DataFrame:
    """The rows at which a vote has been given so many times running and differs from what was agreed before; null votes are passed over."""
    w = Window.partitionBy(*keys).orderBy(*order)
    given = rows.where(F.col(vote).isNotNull()).withColumn("_new", F.when(F.lag(vote).over(w) == F.col(vote), 0).otherwise(1))
    given = given.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agreed = given.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))).where(F.col("_i") == needed)
    return agreed.withColumn("_was", F.lag(vote).over(w)).where(F.col("_was").isNull() | (F.col("_was") != F.col(vote))).select(*rows.columns)


def step_share(peak: Column) -> Column:
    """Share of a full step's length, by the step's peak."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (peak - STEP_PEAK) / (FULL_PEAK - STEP_PEAK)))
    return LEAST_SHARE + (1 - LEAST_SHARE) * x


def storeys(height: Column, floor: Column, lowest: Column, highest: Column) -> Column:
    """Floors a lift has gone, or null where the height leaves it open. At a building's end floors more slack is given."""
    n = F.round(height / STOREY)
    off, end = F.abs(height / STOREY - n), floor + n
    inside = (n != 0) & (end >= lowest) & (end <= highest)
    return F.when(inside & ((off <= STOREY_SLACK) | (((end == lowest) | (end == highest)) & (off <= END_SLACK))), n.cast("int"))


def leg_errors(rows: DataFrame, keys: list[str], heading: str, truth: str) -> DataFrame:
    """Per leg the mean signed and mean absolute heading error."""
    e = wrapped(F.col(heading) - F.col(truth))
    return rows.groupBy(*keys).agg(F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))


def silent_stretches(rows: DataFrame, keys: list[str], t: str, limits: tuple[float, ...]) -> DataFrame:
    """Readings that come after silence: how long it was and how many of the rising limits it passed."""
    wait = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    passed = sum((F.when(F.col("silence") >= x, 1).otherwise(0) for x in limits), F.lit(0))
    return rows.withColumn("silence", wait).withColumn("stage", passed).where("stage > 0")


def learnt(rows: DataFrame, keys: list[str], order: list[str], value: str, last: int, least: int) -> DataFrame:
    """Adds estimate: the median of the last so many values up to a row; null where there are fewer than least."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-last + 1, 0)
    held = rows.withColumn("_v", F.collect_list(value).over(w))
    return held.withColumn("estimate", F.when(F.size("_v") >= least, middle(F.col("_v")))).drop("_v")


def stair_scores(rows: DataFrame, keys: list[str], order: list[str], spread: str, ratio: str, weight: float = 1.0, flat: int = 60, least: int = 10) -> DataFrame:
    """Adds score: how unlike a person's steps on the level a step is, from logarithms of two features over their medians of the flat steps before.

    A feature of zero makes it infinite, as the logarithm of zero is.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-flat, -1)
    held = rows.withColumn("_vs", F.collect_list(spread).over(w)).withColumn("_vr", F.collect_list(ratio).over(w))
    based = held.withColumn("_n", F.size("_vs")).withColumn("_s", middle(F.col("_vs"))).withColumn("_r", middle(F.col("_vr"))).drop("_vs", "_vr")
    good = (F.col("_n") >= least) & (F.col("_s") > 0) & (F.col("_r") > 0) & (F.col(spread) >= 0) & (F.col(ratio) >= 0)
    ln = lambda c, base: F.when(F.col(c) == 0, F.lit(float("-inf"))).otherwise(F.ln(F.col(c) / F.nullif(base, F.lit(0.0))))
    return based.withColumn("score", F.when(good, weight * ln(spread, "_s") - ln(ratio, "_r"))).drop("_n", "_s", "_r")


def latest_revision(rows: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """Of positions that were given again, the last given."""
    others = [c for c in rows.columns if c not in (*keys, revision)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(revision, *others), revision).alias("_x")).select(*keys, "_x.*")


def misses(positions: DataFrame, marks: DataFrame, keys: list[str], t: str) -> DataFrame:
    """For each mark(keys, t, mx, my) the position given last by then and the miss; marks before any position have none."""
    both = positions.select(*keys, t, F.struct("x", "y").alias("_p"), F.lit(None).cast("struct<mx:double,my:double>").alias("_m")).unionByName(
        marks.select(*keys, t, F.lit(None).cast("struct<x:double,y:double>").alias("_p"), F.struct("mx", "my").alias("_m")))
    w = Window.partitionBy(*keys).orderBy(F.col(t), F.col("_m").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where("_m is not null and _p is not null")
    return seen.select(*keys, t, F.hypot(F.col("_p.x") - F.col("_m.mx"), F.col("_p.y") - F.col("_m.my")).alias("miss"))


def loops(rows: DataFrame, keys: list[str], order: list[str], turn: str, steps: int = 40, degrees: float = 330.0) -> DataFrame:
    """Adds turned (over the last so many steps) and loop: whether it is a whole turn, either way."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-steps + 1, 0)
    return rows.withColumn("turned", F.sum(turn).over(w)).withColumn("loop", F.abs("turned") >= degrees)


def heading_check(rows: DataFrame, least: float = 10.0, straight: float = 0.85, ratio: tuple[float, float] = (0.7, 1.4)) -> DataFrame:
    """Adds error (degrees) and reliable to marks with walked (dx, dy, length) and true (tx, ty) ways."""
    true, gone = F.hypot("tx", "ty"), F.hypot("dx", "dy")
    error = wrapped(F.degrees(F.atan2("dx", -F.col("dy"))) - F.degrees(F.atan2("tx", -F.col("ty"))))
    good = (true >= least) & (gone >= straight * F.col("length")) & (F.col("length") / F.nullif(true, F.lit(0.0))).between(*ratio)
    return rows.withColumn("error", error).withColumn("reliable", F.coalesce(good, F.lit(False)))


def course_mismatch(rows: DataFrame, keys: list[str], order: list[str], heading: str, course: str, steps: int = 8, degrees: float = 40.0) -> DataFrame:
    """Adds mismatch (mean over the last so many steps of course less heading) where the steps are there and it is more than degrees, else null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-steps + 1, 0)
    off = wrapped(F.col(course) - F.col(heading))
    full = rows.withColumn("_off", off).withColumn("_n", F.count("_off").over(w)).withColumn("_m", F.avg("_off").over(w))
    return full.withColumn("mismatch", F.when((F.col("_n") == steps) & (F.abs("_m") > degrees), F.col("_m"))).drop("_off", "_n", "_m")

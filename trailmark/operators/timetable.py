"""Teaching days, rooms and crowds. Times of day are minutes from midnight; interval ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the crowd model: seats of a lecture and of an exercise group, the share who come, the most it slows, people at which it saturates.
LECTURE_SEATS, GROUP_SEATS, LECTURE_SHARE, GROUP_SHARE, SLOWEST, SATURATION = 80, 16, 0.4, 0.8, 0.3, 400.0


def day_dimension(dates: DataFrame, semesters: DataFrame, special: DataFrame, date: str = "date") -> DataFrame:
    """date, semester kind and teaching weekday (1 to 7, null: none) per date.

    semesters(kind, start, end) and special(start, end, type, as_day) hold inclusive ranges. A day that makes up for another takes
    its weekday, before any holiday; a special day other than INFO, and Sunday, has no teaching. Both tables are small dimensions:
    they are exploded to days and joined by equality, so dates of any number are never compared with ranges pair by pair.
    """
    terms = semesters.select("kind", F.explode(F.sequence("start", "end")).alias(date))
    days = special.select("type", "as_day", F.explode(F.sequence("start", F.coalesce("end", "start"))).alias(date))
    per_day = days.groupBy(date).agg(F.max(F.when(F.col("type") == "MAKEUP", F.col("as_day"))).alias("_makeup"), F.bool_or(~F.col("type").isin("INFO", "MAKEUP")).alias("_off"))
    terms = terms.groupBy(date).agg(F.min("kind").alias("kind"))
    joined = dates.join(terms, date, "left").join(per_day, date, "left")
    own = F.when(F.col("_off") | (F.weekday(date) == 6), F.lit(None)).otherwise(F.weekday(date) + 1)
    return joined.withColumn("teaching_day", F.when(F.col("kind").isNotNull(), F.coalesce("_makeup", own)).cast("int")).drop("_makeup", "_off")


def classes_on_days(classes: DataFrame, days: DataFrame) -> DataFrame:
    """Classes joined to the dates they take place on: a dated class on its date whatever the calendar, others by semester and teaching day.

    classes has kind, day and date among its columns, days(date, kind, teaching_day). Two equality joins, not one with "or".
    """
    dated = classes.where("date is not null").join(days.select("date"), "date", "left_semi")
    weekly = classes.where("date is null").drop("date").join(days.select("date", "kind", F.col("teaching_day").alias("day")), ["kind", "day"])
    return dated.unionByName(weekly.select(*dated.columns))


def merge_shared(slots: DataFrame, room: str = "room") -> DataFrame:
    """One row per lecture that several timetables share: their number, and biweekly only where all say so."""
    return slots.groupBy(room, "dow", "st", "en", "subject", "kind").agg(F.bool_and("biweekly").alias("biweekly"), F.count_distinct("timetable").alias("n_timetables"))


def busy_islands(slots: DataFrame, keys: list[str], start: str = "st", end: str = "en") -> DataFrame:
    """Stretches in which slots overlap or touch: keys, busy_from, busy_until, n_slots."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = slots.withColumn("_new", F.when(before >= F.col(start), 0).otherwise(1))
    isle = marked.withColumn("_isle", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy(*keys, "_isle").agg(F.min(start).alias("busy_from"), F.max(end).alias("busy_until"), F.count("*").alias("n_slots")).drop("_isle")


def room_status(slots: DataFrame, keys: list[str], at: int | Column, start: str = "st", end: str = "en") -> DataFrame:
    """Per room with slots: busy, and until when it is busy or free (null: free for the rest of the day)."""
    at = F.lit(at) if isinstance(at, int) else at
    isles = busy_islands(slots, keys, start, end)
    now = (F.col("busy_from") <= at) & (F.col("busy_until") > at)
    got = isles.groupBy(*keys).agg(F.max(F.when(now, F.col("busy_until"))).alias("_until"), F.min(F.when(F.col("busy_from") > at, F.col("busy_from"))).alias("_next"))
    return got.select(*keys, F.col("_until").isNotNull().alias("busy"), F.coalesce("_until", "_next").alias("until"))


def free_rooms(slots: DataFrame, keys: list[str], at: int | Column, minutes: int) -> DataFrame:
    """Rooms free at a time for so many minutes; only rooms that have a slot at all."""
    at = F.lit(at) if isinstance(at, int) else at
    return room_status(slots, keys, at).where(~F.col("busy") & (F.col("until").isNull() | (F.col("until") - at >= minutes))).select(*keys, "until")


def canonical_room(room: Column, aliases: dict[str, str]) -> Column:
    """The room an alias stands for, or the room itself."""
    if not aliases:
        return room
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv]), room), room)


def people(kind: Column, timetables: Column, biweekly: Column) -> Column:
    """People a slot is expected to move."""
    lecture = LECTURE_SEATS * F.greatest(F.lit(1), timetables) * LECTURE_SHARE
    return F.when(kind == "LECTURE", lecture).otherwise(GROUP_SEATS * GROUP_SHARE) / F.when(biweekly, 2.0).otherwise(1.0)


def people_moving(slots: DataFrame, place: str, at: Column | int, window: int = 10) -> DataFrame:
    """People who come to or leave a place around a time: each start or end less than a minute over the window counts once."""
    at = F.lit(at) if isinstance(at, int) else at
    near = lambda c: F.when(F.abs(F.col(c) - at) <= window, 1).otherwise(0)
    events = slots.withColumn("_n", near("st") + near("en")).where("_n > 0")
    return events.groupBy(place).agg(F.sum(F.col("_n") * F.col("people")).alias("people"))


def crowd_factor(number: Column) -> Column:
    """How much slower walking is: 1 without people, at most 1.3."""
    return 1 + SLOWEST * (1 - F.exp(-number / SATURATION))


def opening_status(hours: DataFrame, key: str, day: str, at: Column | int) -> DataFrame:
    """hours(key, day 0..6, start, end): per key and asked day, until when it is open, else after how many days and when it opens next, within a week."""
    at = F.lit(at) if isinstance(at, int) else at
    asked = hours.select(key).distinct().crossJoin(F.broadcast(hours.sparkSession.range(7).select(F.col("id").cast("int").alias("asked"))))  # seven days
    pairs = asked.join(hours, key).withColumn("_ahead", F.pmod(F.col(day) - F.col("asked"), F.lit(7)))
    open_now = (F.col("_ahead") == 0) & (F.col("start") <= at) & (F.col("end") > at)
    ahead = F.when((F.col("_ahead") == 0) & (F.col("start") <= at), F.col("_ahead") + 7).otherwise(F.col("_ahead"))
    found = pairs.groupBy(key, "asked").agg(F.max(F.when(open_now, F.col("end"))).alias("open_until"), F.min(F.struct(ahead.alias("in_days"), F.col("start").alias("at"))).alias("_next"))
    shut = F.col("open_until").isNull()
    return found.select(key, "asked", "open_until", F.when(shut, F.col("_next.in_days")).alias("opens_in_days"), F.when(shut, F.col("_next.at")).alias("opens_at"))

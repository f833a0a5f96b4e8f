"""A person's day: recurring events, the agenda, when to leave, and the plan of the way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Minutes before leaving that a notice comes, before the first item of a day, and days looked ahead.
MARGIN, FIRST_NOTICE, HORIZON = 5, 60, 120


def occurrences(events: DataFrame, dates: DataFrame, weekly: str = "weekly", first: str = "date", until: str = "until") -> DataFrame:
    """Events on the dates(day) they take place on: their own, and for weekly ones each same weekday up to until, inclusive.

    Joined on the weekday, so an event meets a seventh of the dates; single events are joined on their date alone.
    """
    once = events.where(~F.col(weekly)).join(dates, F.col(first).cast("date") == F.col("day"))
    again = events.where(F.col(weekly)).withColumn("_w", F.weekday(first)).join(dates.withColumn("_dw", F.weekday("day")), F.col("_w") == F.col("_dw"))
    again = again.where((F.col("day") >= F.col(first).cast("date")) & (F.col(until).isNull() | (F.col("day") <= F.col(until)))).drop("_w", "_dw")
    return once.unionByName(again)


def agenda(classes: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Classes and events of a day as one table with rank, by start; a class stands before an event that starts with it.

    Rows are ranked among those that start together, and what starts earlier is counted by start, so no task gets a whole day.
    """
    both = classes.withColumn("kind_rank", F.lit(0)).unionByName(events.withColumn("kind_rank", F.lit(1)))
    at = [*keys, "st"]
    earlier = Window.partitionBy(*keys).orderBy("st").rowsBetween(Window.unboundedPreceding, -1)
    base = both.groupBy(*at).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in at], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy("kind_rank", "item")))
    met = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in at])
    return ranked.join(base, met).select(*both.columns, (F.col("_base") + F.col("rank")).cast("int").alias("rank"))


def next_item(items: DataFrame, keys: list[str], now: Column | int) -> DataFrame:
    """Per key the first item that hasn't ended."""
    now = F.lit(now) if isinstance(now, int) else now
    return items.where(F.col("en") > now).groupBy(*keys).agg(F.min(F.struct("st", "item")).alias("_x")).select(*keys, F.col("_x.st").alias("st"), F.col("_x.item").alias("item"))


def with_previous(items: DataFrame, keys: list[str]) -> DataFrame:
    """Adds prev_item, prev_place and prev_end: of the day's placed items that end by an item's start, the one that ends last.

    Items may overlap, so the row before isn't enough. Starts and ends are laid on one time line and the last end seen is
    carried on: one sort per day, no join of a day with itself. An item without length is before none.
    """
    own = items.withColumn("_at", F.col("st")).withColumn("_turn", F.lit(1)).withColumn("_end", F.lit(None).cast("struct<en:int,neg:bigint,item:bigint,place:string>"))
    ended = F.struct(F.col("en").cast("int").alias("en"), (-F.col("item")).cast("bigint").alias("neg"), F.col("item").cast("bigint").alias("item"), F.col("place").cast("string").alias("place"))
    ends = items.where(F.col("place").isNotNull() & (F.col("en") > F.col("st"))).withColumn("_at", F.col("en")).withColumn("_turn", F.lit(0)).withColumn("_end", ended)
    line = Window.partitionBy(*keys).orderBy("_at", "_turn", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ends.unionByName(own).withColumn("_last", F.max("_end").over(line)).where("_turn = 1")
    return seen.select(*items.columns, F.col("_last.item").alias("prev_item"), F.col("_last.place").alias("prev_place"), F.col("_last.en").alias("prev_end"))


def departures(items: DataFrame, margin: int = MARGIN, notice: int = FIRST_NOTICE) -> DataFrame:
    """leave_at, notify_at, first_of_day and reminder_at per item that with_previous() has looked at and whose minutes of way are known.

    Nothing for an item at the place where the one before was. A notice waits for the end of the item before; the first placed
    item of a day gets an early one, and a second at the usual time where that is later.
    """
    away = items.where(F.col("place").isNull() | F.col("prev_place").isNull() | (F.col("place") != F.col("prev_place")))
    leave = F.col("st") - F.coalesce("minutes", F.lit(0))
    usual = F.greatest(leave - margin, F.coalesce(F.col("prev_end"), leave - margin))
    first, early = F.col("place").isNotNull() & F.col("prev_item").isNull(), F.col("st") - notice
    return away.select(*items.columns, leave.alias("leave_at"), F.when(first, F.least(usual, early)).otherwise(usual).alias("notify_at"), first.alias("first_of_day"), F.when(first & (usual > early), usual).alias("reminder_at"))


def next_departure(found: DataFrame, keys: list[str], now: int) -> DataFrame:
    """Per key the earliest notice or reminder after now."""
    every = found.select(*keys, "item", F.explode(F.array("notify_at", "reminder_at")).alias("at")).where(F.col("at") > now)
    return every.groupBy(*keys).agg(F.min(F.struct("at", "item")).alias("_x")).select(*keys, F.col("_x.at").alias("notify_at"), F.col("_x.item").alias("item"))


def missed_departure(found: DataFrame, keys: list[str], told: int, now: int) -> DataFrame:
    """Per key, of notices after told and not after now for items still to start: the item that starts first, its latest notice."""
    every = found.where(F.col("st") > now).select(*keys, "st", "item", F.explode(F.array("notify_at", "reminder_at")).alias("at")).where((F.col("at") > told) & (F.col("at") <= now))
    return every.groupBy(*keys).agg(F.min(F.struct("st", (-F.col("at")).alias("neg"), "item")).alias("_x")).select(*keys, F.col("_x.item").alias("item"), F.col("_x.st").alias("st"), (-F.col("_x.neg")).alias("notify_at"))


def day_plan(items: DataFrame, keys: list[str]) -> DataFrame:
    """Each placed item with the one before it: the break in minutes, whether the place is the same, and whether the way is longer than the break."""
    order = Window.partitionBy(*keys).orderBy("st", "item")
    legs = items.where("place is not null").withColumn("from_item", F.lag("item").over(order)).withColumn("_from", F.lag("place").over(order)).withColumn("_end", F.lag("en").over(order))
    same = F.coalesce(F.col("_from") == F.col("place"), F.lit(False))
    legs = legs.withColumn("break_min", F.col("st") - F.col("_end")).withColumn("same_place", same)
    return legs.withColumn("too_tight", F.coalesce(~F.col("same_place") & (F.col("minutes") > F.col("break_min")), F.lit(False))).drop("_from", "_end")


def refresh_instant(now: Column, *instants: Column, midnight: int = 24 * 60) -> Column:
    """The first of the instants, or midnight, that is after now."""
    return F.array_min(F.filter(F.array(*instants, F.lit(midnight)), lambda x: x > now))


def route_minutes(seconds: Column) -> Column:
    """Whole minutes, at least one."""
    return F.greatest(F.lit(1), F.ceil(seconds / 60)).cast("int")

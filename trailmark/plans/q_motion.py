"""Readings: sessions, bins, filters, votes, corrections; machines in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import motion as op
from ..streaming.machines import heading_runs, position_filter, step_detector
from ..streaming.run import run_batch
from .registry import query
from .views import READINGS, readings, table

GAP = 40_000_000_000  # 40,000 s


def _session_sql(sign: str) -> str:
    return f"""with {READINGS}, g as (select *, case when t - lag(t) over (partition by user_id order by t) {sign} {GAP} or lag(t) over (partition by user_id order by t) is null then 1 else 0 end as n from readings)
        select event_id, user_id, sum(n) over (partition by user_id order by t rows unbounded preceding) as session from g"""


@query("q_st6_sessions_reached", _session_sql(">="))
def sessions(spark, d):
    return op.sessions(readings(spark, d), ["user_id"], "t", GAP).select("event_id", "user_id", "session")


@query("q_st6_sessions_passed", _session_sql(">"))
def sessions_passed(spark, d):
    return op.sessions(readings(spark, d), ["user_id"], "t", GAP, reaches=False).select("event_id", "user_id", "session")


BINS = f"""with {READINGS}, g as (select *, case when t - lag(t) over (partition by user_id order by t) >= {GAP} or lag(t) over (partition by user_id order by t) is null then 1 else 0 end as n from readings),
    s as (select *, sum(n) over (partition by user_id order by t rows unbounded preceding) as session from g), f as (select *, min(t) over (partition by user_id, session) as t0 from s),
    b as (select user_id, session, (t - t0) // 20000000000 as bin, count(*) as n, avg(value) as mean, stddev_pop(value) as std from f group by 1, 2, 3)"""


def _bins(spark, d):
    return op.bins(readings(spark, d), ["user_id"], "t", "value", 20_000_000_000, GAP)


@query("q_st7_bins", BINS + " select user_id, session, bin, n, round(mean, 6) as mean, round(std, 6) as std from b")
def bins(spark, d):
    return _bins(spark, d).select("user_id", "session", "bin", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("q_w07_rolling_median", f"""with {READINGS}, w as (select event_id, user_id, list(value) over (partition by user_id order by t rows between 40 preceding and 1 preceding) as h from readings)
    select event_id, user_id, case when len(h) >= 10 then list_sort(h)[len(h) // 2 + 1] end as baseline from w""")
def rolling(spark, d):
    return op.rolling_upper_median(readings(spark, d), ["user_id"], ["t"], "value").select("event_id", "user_id", "baseline")


@query("q_a09_medians", f"with {READINGS} select user_id, event_type, round(median(value), 6) as median, list_sort(list(value))[count(*) // 2 + 1] as upper_median from readings group by 1, 2")
def medians(spark, d):
    return readings(spark, d).groupBy("user_id", "event_type").agg(F.round(F.median("value"), 6).alias("median"), op.upper_median(F.collect_list("value")).alias("upper_median"))


@query("q_a10_spread", f"with {READINGS} select user_id, round(var_pop(value), 6) as variance, round(stddev_pop(value), 6) as deviation from readings group by 1")
def spread(spark, d):
    return readings(spark, d).groupBy("user_id").agg(F.round(F.var_pop("value"), 6).alias("variance"), F.round(F.stddev_pop("value"), 6).alias("deviation"))


@query("q_a11_circular_mean", f"""with {READINGS}, s as (select user_id, sum(sin(radians(value))) as s, sum(cos(radians(value))) as c, count(*) as n from readings group by 1)
    select user_id, round(degrees(atan2(s, c)), 5) as direction, round(sqrt(s * s + c * c) / n, 6) as resultant, sqrt(s * s + c * c) / n >= 0.3 as consistent from s""")
def circular(spark, d):
    return op.circular_mean(readings(spark, d), ["user_id"], "value", 0.3).select("user_id", F.round("direction", 5).alias("direction"), F.round("resultant", 6).alias("resultant"), "consistent")


@query("q_a12_lag_correlation", f"""with {READINGS}, k as (select *, row_number() over (partition by user_id order by t) as n, event_id % 100 as h from readings),
    x as (select a.user_id, b.n - a.n as lag, sum(a.h * b.value - b.h * a.value) as x from k a join k b on a.user_id = b.user_id and b.n - a.n between 1 and 4 group by 1, 2),
    m as (select user_id, sqrt(sum(h * h)::double * sum(value * value)) as m from k group by 1)
    select user_id, cast(lag as int) as lag, round(x / m, 6) as correlation from x join m using (user_id)""")
def correlation(spark, d):
    r = readings(spark, d).withColumn("h", F.col("event_id") % 100)
    return op.lagged_correlation(r, ["user_id"], "t", "h", "value", 4).where("correlation is not null").select("user_id", "lag", F.round("correlation", 6).alias("correlation"))


@query("q_a13_principal_axis", f"""with {READINGS}, s as (select user_id, var_pop(value) as a, var_pop((event_id % 100)::double) as b, covar_pop(value, (event_id % 100)::double) as c from readings group by 1)
    select user_id, round(degrees(atan2(2 * c, a - b) / 2), 4) as axis, round((a + b + sqrt((a - b) * (a - b) + 4 * c * c)) / 2 / (a + b), 6) as share from s""")
def axis(spark, d):
    r = readings(spark, d).withColumn("h", (F.col("event_id") % 100).cast("double"))
    return op.principal_axis(r, ["user_id"], "value", "h").select("user_id", F.round("axis", 4).alias("axis"), F.round("share", 6).alias("share"))


@query("q_a14_cadence", f"""with {READINGS}, k as (select user_id, row_number() over (partition by user_id order by t) as n, value - avg(value) over (partition by user_id) as v from readings),
    c as (select a.user_id, b.n - a.n as lag, sum(a.v * b.v) as x from k a join k b on a.user_id = b.user_id and b.n - a.n between 0 and 9 group by 1, 2),
    p as (select *, lag(x) over w as u, lead(x) over w as o, first(x) over w as z from c window w as (partition by user_id order by lag))
    select user_id, cast(min(lag) as int) as lag, round(arg_min(x / z, lag), 6) as height from p where lag > 0 and x > u and x >= o group by user_id""")
def cadence(spark, d):
    return op.cadence(readings(spark, d), ["user_id"], "t", "value", 8).select("user_id", "lag", F.round("height", 6).alias("height"))


@query("q_a15_leg_errors", f"""with {READINGS}, e as (select user_id, event_type, ((value * 3 - event_id % 360) % 360 + 540) % 360 - 180 as e from readings)
    select user_id, event_type, round(avg(e), 6) as bias, round(avg(abs(e)), 6) as mae, count(*) as n from e group by 1, 2""")
def legs(spark, d):
    r = readings(spark, d).withColumn("h", F.col("value") * 3).withColumn("truth", F.col("event_id") % 360)
    return op.leg_errors(r, ["user_id", "event_type"], "h", "truth").select("user_id", "event_type", F.round("bias", 6).alias("bias"), F.round("mae", 6).alias("mae"), "n")


@query("q_w02_trail", f"""with {READINGS}, c as (select *, coalesce(((value - lag(value) over (partition by user_id order by t)) % 360 + 540) % 360 - 180, 0) as c from readings)
    select event_id, round(sum(0.7 * sin(radians(value))) over w, 6) + 0.0::double as x, round(sum(-0.7 * cos(radians(value))) over w, 6) + 0.0::double as y, round(sum(c) over w, 6) + 0.0::double as turned from c window w as (partition by user_id order by t rows unbounded preceding)""")
def trail(spark, d):
    r = op.trail(readings(spark, d).withColumn("len", F.lit(0.7)), ["user_id"], ["t"], "value", "len")
    return r.select("event_id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"), (F.round("turned", 6) + 0.0).alias("turned"))


@query("q_w01_deltas", f"with {READINGS} select event_id, t - lag(t) over (partition by user_id order by t) as waited, lead(t) over (partition by user_id order by t) - t as next_in from readings")
def deltas(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t")
    return readings(spark, d).select("event_id", (F.col("t") - F.lag("t").over(w)).alias("waited"), (F.lead("t").over(w) - F.col("t")).alias("next_in"))


@query("q_w06_time_buffer", f"with {READINGS} select event_id, count(*) over (partition by user_id order by t range between 86400000000 preceding and current row) as n from readings")
def buffer(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-86_400_000_000, 0)
    return readings(spark, d).select("event_id", F.count("*").over(w).alias("n"))


@query("q_st9_height_gain", f"""with {READINGS}, k as (select user_id, value - 100 as a, row_number() over (partition by user_id order by t) as k, count(*) over (partition by user_id) as n from readings),
    v as (select *, sum(a) over (partition by user_id order by k rows unbounded preceding) * 0.5 as v from k), b as (select *, coalesce(lag(v) over (partition by user_id order by k), 0) as p, last_value(v) over (partition by user_id order by k rows between unbounded preceding and unbounded following) as drift from v)
    select user_id, round(sum(((p + v) / 2 - drift * (k - 0.5::double) / n) * 0.5), 7) as height from b group by user_id""")
def height(spark, d):
    r = readings(spark, d).withColumn("a", F.col("value") - 100)
    return op.height_gain(r, ["user_id"], ["t"], "a", 0.5).select("user_id", F.round("height", 7).alias("height"))


@query("q_st15_agreed_votes", f"""with {READINGS}, v as (select event_id, user_id, t, case when event_type in ('view', 'click') then 'in' when event_type = 'error' then null else 'out' end as vote from readings),
    g as (select *, case when lag(vote) over (partition by user_id order by t) = vote then 0 else 1 end as n from v where vote is not null),
    r as (select *, sum(n) over (partition by user_id order by t rows unbounded preceding) as run from g), i as (select *, row_number() over (partition by user_id, run order by t) as i from r),
    a as (select *, lag(vote) over (partition by user_id order by t) as was from i where i = 3) select event_id, user_id, vote from a where was is null or was <> vote""")
def votes(spark, d):
    e = F.col("event_type")
    r = readings(spark, d).withColumn("vote", F.when(e.isin("view", "click"), "in").when(e != "error", "out"))
    return op.agreed_votes(r.select("event_id", "user_id", "t", "vote"), ["user_id"], ["t"], "vote").select("event_id", "user_id", "vote")


@query("q_st2_step_share", f"with {READINGS} select event_id, round(0.2 + 0.8 * greatest(0, least(1, (value / 100 - 0.6) / 0.6)), 6) as share from readings")
def share(spark, d):
    return readings(spark, d).select("event_id", F.round(op.step_share(F.col("value") / 100), 6).alias("share"))


@query("q_st24_lift_storeys", f"""with {READINGS}, k as (select event_id, value / 10 - 8 as h, event_id % 5 as f from readings), s as (select *, round(h / 3.75) as n, abs(h / 3.75 - round(h / 3.75)) as off from k)
    select event_id, case when n <> 0 and f + n between 0 and 4 and (off <= 0.35 or (f + n in (0, 4) and off <= 0.75)) then cast(n as int) end as storeys from s""")
def storeys(spark, d):
    return readings(spark, d).select("event_id", op.storeys(F.col("value") / 10 - 8, F.col("event_id") % 5, F.lit(0), F.lit(4)).alias("storeys"))


@query("q_st14_silence", f"""with {READINGS}, s as (select event_id, t - lag(t) over (partition by user_id order by t) as silence from readings)
    select event_id, silence, (silence >= 20000000000)::int + (silence >= 40000000000)::int + (silence >= 80000000000)::int as stage from s where silence >= 20000000000""")
def silence(spark, d):
    return op.silent_stretches(readings(spark, d), ["user_id"], "t", (20_000_000_000, 40_000_000_000, 80_000_000_000)).select("event_id", "silence", "stage")


@query("q_st19_learnt_bias", f"with {READINGS} select event_id, case when count(*) over w >= 5 then median(value) over w end as estimate from readings window w as (partition by user_id order by t rows between 8 preceding and current row)")
def bias(spark, d):
    return op.learnt(readings(spark, d), ["user_id"], ["t"], "value", 9, 5).select("event_id", "estimate")


@query("q_st20_step_length", f"""with {READINGS}, l as (select event_id, user_id, t, value, event_id % 10 as s from readings where value > 60 and event_id % 10 >= 5)
    select event_id, case when count(*) over w >= 3 then median(value / (s + 1)) over w end as estimate from l window w as (partition by user_id order by t rows between 4 preceding and current row)""")
def step_length(spark, d):
    r = readings(spark, d).where("value > 60 and event_id % 10 >= 5").withColumn("ratio", F.col("value") / (F.col("event_id") % 10 + 1))
    return op.learnt(r, ["user_id"], ["t"], "ratio", 5, 3).select("event_id", "estimate")


@query("q_st10_stair_scores", f"""with {READINGS}, w as (select *, event_id % 50 + 1 as r from readings), b as (select *, count(*) over v as n, median(value) over v as ms, median(r) over v as mr from w window v as (partition by user_id order by t rows between 60 preceding and 1 preceding))
    select event_id, round(case when n >= 10 then ln(value / ms) - ln(r / mr) end, 6) as score from b""")
def stairs(spark, d):
    r = readings(spark, d).withColumn("r", F.col("event_id") % 50 + 1)
    return op.stair_scores(r, ["user_id"], ["t"], "value", "r").select("event_id", F.round("score", 6).alias("score"))


@query("q_st4_latest_revision", "select o_custkey as session, o_orderkey % 20 as seq, max(o_orderkey) as revision, arg_max(o_totalprice, o_orderkey) as x from orders group by 1, 2")
def revision(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), (F.col("o_orderkey") % 20).alias("seq"), F.col("o_orderkey").alias("revision"), F.col("o_totalprice").alias("x"))
    return op.latest_revision(r, ["session", "seq"])


@query("q_st27_miss_by_mark", f"""with {READINGS}, p as (select user_id, t, value as x, event_id % 100 as y from readings where event_type <> 'view'), m as (select event_id, user_id, t, value + 3 as mx, event_id % 90 as my from readings where event_type = 'view')
    select m.user_id, m.t, round(sqrt(power(p.x - mx, 2) + power(p.y - my, 2)), 6) as miss from m asof join p on m.user_id = p.user_id and m.t >= p.t""")
def misses(spark, d):
    r = readings(spark, d)
    p = r.where("event_type <> 'view'").select("user_id", "t", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    m = r.where("event_type = 'view'").select("user_id", "t", (F.col("value") + 3).alias("mx"), (F.col("event_id") % 90).cast("double").alias("my"))
    return op.misses(p, m, ["user_id"], "t").withColumn("miss", F.round("miss", 6))


@query("q_j13_steps_in_fix_window", f"""with {READINGS}, w as (select user_id, min(t) as lo, max(t) as hi from readings where event_type = 'purchase' group by 1) select event_id from readings join w using (user_id) where t between lo and hi and event_type = 'click'""")
def in_window(spark, d):
    r = readings(spark, d)
    w = r.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return r.where("event_type = 'click'").join(w, "user_id").where(F.col("t").between(F.col("lo"), F.col("hi"))).select("event_id")


def _ns(spark, d):
    return readings(spark, d).withColumn("t", F.col("t") * 1000)


@query("q_st1_steps", f"""with recursive {READINGS}, k as (select user_id, t * 1000 as t, value, row_number() over (partition by user_id order by t) as n from readings),
    f as (select user_id, n, t, 9.81::double + 0.25::double * (value - 9.81::double) as fast, 9.81::double + 0.02::double * (value - 9.81::double) as slow from k where n = 1
        union all select k.user_id, k.n, k.t, fast + 0.25::double * (value - fast), slow + 0.02::double * (value - slow) from f join k on k.user_id = f.user_id and k.n = f.n + 1),
    s as (select user_id, n, t, fast - slow as g, lead(fast - slow) over (partition by user_id order by n) as nx from f),
    a as (select *, last_value(case when g > 0.6 then 1 when g < 0 then 0 end ignore nulls) over (partition by user_id order by n rows between unbounded preceding and 1 preceding) as was from s)
    select user_id, t, round(greatest(g, nx), 6) as peak from a where g > 0.6 and coalesce(was, 0) = 0 and nx is not null""")
def steps(spark, d):
    return run_batch(_ns(spark, d), "user_id", step_detector()).select("user_id", "t", F.round("peak", 6).alias("peak"))


@query("q_w04_heading_runs")
def runs(spark, d):
    return run_batch(_ns(spark, d), "user_id", heading_runs())


@query("q_st16_position_filter")
def fused(spark, d):
    r = _ns(spark, d).withColumns({"kind": F.when(F.col("event_type") == "view", "fix").otherwise("step"), "x": F.when(F.col("event_type") == "view", F.col("value") / 20).otherwise(F.sin("value")), "y": F.when(F.col("event_type") == "view", F.col("event_id") % 7).otherwise(F.cos("value")), "accuracy": F.when(F.col("event_id") % 6 == 0, 45.0).otherwise(4.0)})
    return run_batch(r, "user_id", position_filter())

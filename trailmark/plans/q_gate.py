"""Steps and poses made of events, through the handling gate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gating
from .registry import query
from .views import table

_DOT = "{a}.x * {b}.x + {a}.y * {b}.y + {a}.z * {b}.z"


def _deg(a: str, b: str) -> str:
    return f"round(degrees(acos(greatest(-1.0, least(1.0, {_DOT.format(a=a, b=b)})))), 6)"


@query("q_st5_handling_gate", f"""with n as (select user_id, row_number() over (partition by user_id order by event_id) as n, event_id from events),
    e as (select user_id, n // 500 as session, n * 600000000 + n // 12 * 1700000000 + n // 90 * 30000000000 + event_id % 5 * 80000000 as t, event_id % 37 / 10.0 as peak,
        case when n // 40 % 2 = 0 then 0.3 else 1.4 end + case when n % 24 = 2 then 0.9 else 0 end + event_id % 3 / 12.0 as a from n),
    b0 as (select user_id, session, t // 500000000 * 500000000 as t, avg(sin(a)) as y, avg(cos(a)) as z from e group by 1, 2, 3),
    b1 as (select user_id, session, t, {{'x': 0.0::double, 'y': round(y / greatest(sqrt(y * y + z * z), 1e-9), 9), 'z': round(z / greatest(sqrt(y * y + z * z), 1e-9), 9)}} as u from b0),
    b2 as (select *, lag(u) over (partition by user_id, session order by t) as l from b1),
    b3 as (select *, coalesce({_deg('u', 'l')} >= 12, false) as turning from b2),
    b4 as (select *, last_value(case when not turning then u end ignore nulls) over w as still, sum(case when turning then 0 else 1 end) over w as part from b3 window w as (partition by user_id, session order by t rows unbounded preceding)),
    b5 as (select *, turning and max(case when turning and {_deg('u', 'still')} > 30 then 1 else 0 end) over (partition by user_id, session, part) = 1 as handling from b4),
    b6 as (select *, case when coalesce(lag(handling) over (partition by user_id, session order by t), false) and not handling then 1 else 0 end as over_ from b5),
    b7 as (select user_id, session, t, abs(still.z) as level, abs(u.z) as now, handling, sum(over_) over (partition by user_id, session order by t) as ended from b6),
    s0 as (select user_id, session, t, max(peak) as peak from e group by 1, 2, 3),
    s1 as (select s0.*, coalesce(level, 1) as level, coalesce(now, 1) as now, coalesce(handling, false) as handling, coalesce(ended, 0) as ended from s0 asof left join b7 on s0.user_id = b7.user_id and s0.session = b7.session and s0.t >= b7.t),
    s2 as (select *, t - lag(t) over (partition by user_id, session order by t) as gap from s1),
    s3 as (select *, sum(case when gap < 1500000000 then 0 else 1 end) over (partition by user_id, session order by t) as burst from s2),
    s4 as (select *, ended - min(ended) over w as part, max(t) over w + 1500000000 as stop from s3 window w as (partition by user_id, session, burst)),
    s as (select *, max(part) over (partition by user_id, session, burst) as parts, first_value(level) over (partition by user_id, session, burst, part order by t) >= 0.5 as hand, first_value(level) over (partition by user_id, session, burst order by t) >= 0.5 as origin from s4),
    r0 as (select * replace (case when row_number() over w > 1 then gap end as gap) from s window w as (partition by user_id, session, burst, part order by t)),
    r1 as (select *, sum(case when gap <= 1200000000 then 0 else 1 end) over (partition by user_id, session, burst, part order by t) as run from r0),
    r2 as (select *, row_number() over w as k, sum(case when gap between 450000000 and 900000000 then 1 else 0 end) over (w rows between 2 preceding and current row) as even from r1 window w as (partition by user_id, session, burst, part, run order by t)),
    r3 as (select *, sum(case when k = 1 or gap >= 450000000 then 1 else 0 end) over (partition by user_id, session, burst, part, run order by t) as wide from r2),
    r4 as (select *, min(case when (k >= 4 and even = 3) or wide >= 5 then t end) over w as from_t, min(case when (k >= 4 and even = 3) or wide >= 5 then run end) over w as from_run from r3 window w as (partition by user_id, session, burst, part)),
    r5 as (select * from r4, (values (false), (true)) as m(rested) where not rested or not hand or run >= from_run),
    r6 as (select *, count(*) over w as n, min(t) over w as first_t, max(peak) over w as top, count(case when peak < 1.3 then 1 end) over w as under_hand, count(case when peak < 1.5 then 1 end) over w as under_pocket,
        sum(case when now >= 0.5 then 1 else 0 end) over (partition by user_id, session, rested, burst order by t) as lying from r5 window w as (partition by user_id, session, rested, burst, part order by t)),
    r7 as (select *, case when peak >= 3 and now < 0.5 then t end as kick from r6),
    r8 as (select *, case when coalesce(kick - last_value(kick ignore nulls) over (partition by user_id, session, rested, burst, lying order by t rows between unbounded preceding and 1 preceding) >= 550000000, true) then kick end as hit from r7),
    r9 as (select *, count(hit) over w as hits, min(hit) over w as since_hit, t - first_t as span, hand or level >= 0.5 as palm, n >= 3 and not handling and (not rested or not hand or t >= from_t) as ready
        from r8 window w as (partition by user_id, session, rested, burst, lying order by t)),
    t0 as (select *, ready and case when palm then span >= 1500000000 and (under_hand <= n // 2 or span >= case when part > 0 then 8000000000 else 4000000000 end)
        else span >= 3000000000 and (top >= 3 or under_pocket <= n // 2 or span >= 8000000000) end as opens from r9),
    t1 as (select *, not opens and hits >= 3 and hit is not null as kicked,
        ready and hand and span >= 1500000000 and part = parts and t + 1500000000 = stop and (part = 0 or stop - first_t >= 8000000000) as waited from t0),
    t2 as (select *, case when opens or kicked then t when waited then case when part = 0 then least(stop, first_t + 4000000000) else first_t + 8000000000 end end as told from t1),
    g0 as (select user_id, session, rested, burst, told, case when kicked then since_hit else first_t end as since, part, palm and not kicked as palm, row_number() over (partition by user_id, session, rested, burst order by told, case when kicked then since_hit else first_t end, part, palm and not kicked) as k from t2 where told is not null),
    g1 as (select user_id, session, burst, min(t) as t0, max(t) as t1 from s group by 1, 2, 3),
    g2 as (select g1.*, a.told as told_a, a.since as since_a, a.part as part_a, a.palm as palm_a, b.told as told_b, b.since as since_b, b.part as part_b, b.palm as palm_b
        from g1 join g0 a on a.user_id = g1.user_id and a.session = g1.session and a.burst = g1.burst and not a.rested and a.k = 1 left join g0 b on b.user_id = g1.user_id and b.session = g1.session and b.burst = g1.burst and b.rested and b.k = 1),
    g3 as (select *, lag(burst) over w is null as initial, case when coalesce(t0 - lag(t1) over w >= 20000000000, true) then 1 else 0 end as fresh from g2 window w as (partition by user_id, session order by burst)),
    g4 as (select *, sum(fresh) over (partition by user_id, session order by burst) as chain from g3),
    g5 as (select *, initial or coalesce(max(case when initial or told_b is not null then 1 else 0 end) over (partition by user_id, session, chain order by burst rows between unbounded preceding and 1 preceding), 0) = 1 as early from g4),
    g as (select user_id, session, burst, case when early then told_a else told_b end as told, case when early then since_a else since_b end as since, case when early then part_a else part_b end as at_part, case when early then palm_a else palm_b end as palm from g5),
    f as (select s.*, told, case when s.t >= since then 'walk' when part < at_part and origin and palm then 'restored' else 'dropped' end as fate from s left join g on s.user_id = g.user_id and s.session = g.session and s.burst = g.burst)
    select user_id, session, t, peak, fate, case when fate = 'dropped' then stop else greatest(t, told) end as told from f""")
def handling(spark, d):
    """A user's events as steps, in bursts of twelve and with a long rest after ninety; the device is turned after every forty, and lifted for a moment in every second burst."""
    k, n = F.col("event_id"), F.col("n")
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    t = n * 600_000_000 + F.floor(n / 12) * 1_700_000_000 + F.floor(n / 90) * 30_000_000_000 + k % 5 * 80_000_000
    a = F.when(F.floor(n / 40) % 2 == 0, 0.3).otherwise(1.4) + F.when(n % 24 == 2, 0.9).otherwise(0.0) + k % 3 / 12
    e = e.select("user_id", F.floor(n / 500).alias("session"), t.alias("t"), (k % 37 / 10).alias("peak"), a.alias("a"))
    poses = e.select("user_id", "session", "t", F.lit(0.0).alias("ux"), F.sin("a").alias("uy"), F.cos("a").alias("uz"))
    return gating.handling_gate(e.select("user_id", "session", "t", "peak"), poses, "user_id")

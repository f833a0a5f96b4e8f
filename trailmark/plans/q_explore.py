"""Poses made of events: reports of gravity, moves of the device, orientation from rates and gravity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import exploring
from ..streaming.machines import orientation
from ..streaming.run import run_batch
from .registry import query
from .views import table


def _deg(a: str, b: str) -> str:
    return f"round(degrees(acos(greatest(-1.0, least(1.0, {a}.y * {b}.y + {a}.z * {b}.z)))), 6)"


POSES = """n as (select user_id, row_number() over (partition by user_id order by event_id) as n, event_id from events),
    e as (select user_id, n // 500 as session, n * 200000000 + n // 60 * 20000000000 as t, case when n // 40 % 2 = 0 then 0.3 else 1.4 end + event_id % 3 / 24.0 as a, event_id * 13 % 360 as h, event_id % 3 = 0 as stepped from n),
    b0 as (select user_id, session, t // 500000000 * 500000000 as t, avg(sin(a)) as y, avg(cos(a)) as z, round(sum(sin(radians(h))), 9) as east, round(sum(cos(radians(h))), 9) as north, count(case when stepped then 1 end) as steps from e group by 1, 2, 3),
    b as (select user_id, session, t, {'y': round(y / greatest(sqrt(y * y + z * z), 1e-9), 9), 'z': round(z / greatest(sqrt(y * y + z * z), 1e-9), 9)} as u, east, north, steps from b0)"""


def _poses(spark, d):
    """A user's events as poses and every third as a step; the device is put away and taken out after every forty, and lies unseen after every sixty."""
    k, n = F.col("event_id"), F.col("n")
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    e = e.select("user_id", F.floor(n / 500).alias("session"), (n * 200_000_000 + F.floor(n / 60) * 20_000_000_000).alias("t"), (F.when(F.floor(n / 40) % 2 == 0, 0.3).otherwise(1.4) + k % 3 / 24).alias("a"), (k * 13 % 360).alias("heading"), (k % 3 == 0).alias("stepped"))
    return e.select("user_id", "session", "t", F.lit(0.0).alias("ux"), F.sin("a").alias("uy"), F.cos("a").alias("uz"), "heading", "stepped")


@query("q_st28_gravity_report", f"""with {POSES},
    w as (select *, first_value(u) over s as f, last_value(case when steps > 0 then u end ignore nulls) over (s rows between unbounded preceding and 1 preceding) as p, first_value(u) over (partition by user_id, session order by t range between 2000000000 preceding and current row) as two
        from b window s as (partition by user_id, session order by t))
    select user_id, session, t, round(degrees(acos(greatest(-1.0, least(1.0, u.z)))), 6) as tilt, {_deg('u', 'two')} as lately, {_deg('u', 'f')} as ever, {_deg('u', 'coalesce(p, f)')} as walked, steps from w""")
def gravity(spark, d):
    p = _poses(spark, d)
    return exploring.gravity_report(p, p.where("stepped").select("user_id", "session", "t"), "user_id")


@query("q_st28_moves", f"""with {POSES},
    o as (select distinct b.user_id, b.session, b.t from b join b c on c.user_id = b.user_id and c.session = b.session and c.t between b.t - 1500000000 and b.t - 1 where {_deg('b.u', 'c.u')} > 45),
    m as (select * from o where not exists (select 1 from o q where q.user_id = o.user_id and q.session = o.session and q.t between o.t - 3000000000 and o.t - 1)),
    back as (select m.user_id, m.session, m.t as seen, b.t, b.u, first_value(b.u) over (partition by m.user_id, m.session, m.t order by b.t) as oldest from m join b on b.user_id = m.user_id and b.session = m.session and b.t between m.t - 5000000000 and m.t),
    began as (select user_id, session, seen, min(case when {_deg('u', 'oldest')} > 15 then t end) as began from back group by 1, 2, 3),
    far as (select m.user_id, m.session, m.t as seen, p.t, coalesce(max(case when o.t >= p.t - 500000000 and {_deg('p.u', 'o.u')} >= 12 then 1 else 0 end), 0) as quick, coalesce(max(case when {_deg('p.u', 'o.u')} >= 12 then 1 else 0 end), 0) as slow
        from m join b p on p.user_id = m.user_id and p.session = m.session and p.t > m.t and p.t <= m.t + 4000000000 left join b o on o.user_id = m.user_id and o.session = m.session and o.t < p.t and o.t >= p.t - 1000000000 group by 1, 2, 3, 4),
    s as (select m.user_id, m.session, m.t as seen, coalesce(min(case when quick = 0 then far.t end), m.t + 4000000000) as settled, coalesce(min(case when slow = 0 then far.t end), m.t + 4000000000) as slow_settled
        from m left join far on far.user_id = m.user_id and far.session = m.session and far.seen = m.t group by m.user_id, m.session, m.t),
    h as (select s.user_id, s.session, s.seen, degrees(atan2(sum(case when b.t = settled then east end), sum(case when b.t = settled then north end))) as here, degrees(atan2(sum(case when b.t >= settled + 2000000000 then east end), sum(case when b.t >= settled + 2000000000 then north end))) as final
        from s join b on b.user_id = s.user_id and b.session = s.session and (b.t = settled or b.t between settled + 2000000000 and settled + 4000000000) group by 1, 2, 3)
    select user_id, session, seen, coalesce(began, seen) as began, settled, slow_settled, round(((here - final + 540) % 360 + 360) % 360 - 180, 6) as off from s join began using (user_id, session, seen) left join h using (user_id, session, seen)""")
def moves(spark, d):
    return exploring.moves(_poses(spark, d), "user_id")


@query("q_st13_orientation")
def oriented(spark, d):
    """Each user's first event seeds a lying device; then turn rates and accelerations by turns."""
    k, n = F.col("event_id"), F.col("n")
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    kind = F.when(n == 1, "seed").when(n % 2 == 0, "rate").otherwise("pull")
    small = lambda m: (k * m % 101 - 50) / 50
    r = e.select("user_id", (n * 20_000_000).alias("t"), kind.alias("kind"), F.lit(1.0).alias("w"), F.when(n > 1, small(7)).otherwise(0.0).alias("x"), F.when(n > 1, small(11)).otherwise(0.0).alias("y"), F.when(n == 1, 0.0).when(n % 2 == 0, small(13)).otherwise(9.81).alias("z"))
    return run_batch(r, "user_id", orientation())

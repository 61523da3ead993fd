"""Queries of schedules: events are executions, the segment of a customer decides its schedule."""

from pyspark.sql import functions as F

from schemagate.functions import cron
from schemagate.plans.queries.base import load, query


@query("""select event_id, ts, minute(ts) in (0, 15, 30, 45) and hour(ts) between 8 and 18 and dayofweek(ts) in (1, 2, 3, 4, 5) as fires,
  minute(ts) = 5 and day(ts) in (1, 15) and month(ts) <= 6 as fires_monthly, hour(ts) in (0, 6, 12, 18) and dayofweek(ts) = 1 as fires_monday
  from events""")
def cron_match(spark, sf):
    ts = F.col("ts")
    return load(spark, sf, "events").select(
        "event_id", "ts", cron.cron_match("*/15 8-18 * * 1-5", ts).alias("fires"),
        cron.cron_match("5/15 * 1,15 1-6 *", ts).alias("fires_monthly"),
        cron.cron_match("* */6 * * 0", ts, monday_zero=True).alias("fires_monday"),
    )


# Schedules by segment; the SQL lists the same minutes by hand.
SCHEDULES = {
    "AUTOMOBILE": "0 9 * * *", "BUILDING": "30 14 * * 1", "FURNITURE": "0 */6 * * *", "HOUSEHOLD": "0 0 1 * *", "MACHINERY": "*/20 22-23 28-31 2,12 0,6",
}
CRON = "case c_mktsegment " + " ".join(f"when '{s}' then '{c}'" for s, c in SCHEDULES.items()) + " else 'never' end"
FIRES = """case c_mktsegment when 'AUTOMOBILE' then minute(m) = 0 and hour(m) = 9 when 'BUILDING' then minute(m) = 30 and hour(m) = 14 and dayofweek(m) = 1
  when 'FURNITURE' then minute(m) = 0 and hour(m) in (0, 6, 12, 18) when 'HOUSEHOLD' then minute(m) = 0 and hour(m) = 0 and day(m) = 1
  when 'MACHINERY' then minute(m) in (0, 20, 40) and hour(m) >= 22 and day(m) >= 28 and month(m) in (2, 12) and dayofweek(m) in (0, 6) end"""


@query(f"""
with last as (select c_custkey, c_mktsegment, max(o_orderdate) + to_minutes(c_custkey * 7) as after from customer join orders on o_custkey = c_custkey
  group by c_custkey, c_mktsegment),
calendar as (select unnest(generate_series((select date_trunc('day', min(after)) from last), (select max(after) + interval 367 days from last),
  interval 10 minutes)) as m),
due as (select c_mktsegment as segment, m from calendar, (select distinct c_mktsegment from customer) where {FIRES})
select c_custkey, after, case when m::date <= after::date + 366 then m end as due_at from last asof left join due on segment = c_mktsegment and m > after
""")
def next_due(spark, sf):
    last = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    people = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    scheduled = last.join(people, "c_custkey").selectExpr(
        "c_custkey", f"{CRON} as schedule", "cast(last + make_dt_interval(0, 0, c_custkey * 7, 0) as timestamp_ntz) as after"
    )
    return cron.with_next_due(scheduled, "schedule", "after", horizon_days=366).select("c_custkey", "after", "due_at")

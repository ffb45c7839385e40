"""Event-time windows and as-of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.catalog import query


@query("tumbling_window", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def tumbling_window(t):
    from strataloom.streaming.events import windowed

    return windowed(t("events"), "1 hour").select("start", "event_type", "n", "total")


@query("sliding_window", """select start, event_type, count(*) as n from (select time_bucket(interval 1 hour, ts) - i * interval 1 hour as start, event_type from events, range(0, 3) r(i)) group by 1, 2""")
def sliding_window(t):
    from strataloom.streaming.events import windowed

    return windowed(t("events"), "3 hours", "1 hour").select("start", "event_type", "n")


@query("session_window", """select user_id, min(ts) as start, max(ts) as last_event, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from
 (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour then 0 else 1 end as new from events)) group by user_id, s""")
def session_window(t):
    from strataloom.streaming.events import sessions

    return sessions(t("events"), "6 hours")


@query("asof_join", """select c.event_id, p.event_id as purchase, p.value from (select * from events where event_type = 'click') c asof left join (select * from events where event_type = 'purchase') p on c.user_id = p.user_id and c.ts >= p.ts""")
def asof_join(t):
    """The last purchase of the user at or before each click: one sort by user and time, no join."""
    e = t("events").filter(F.col("event_type").isin("click", "purchase"))
    buys = F.when(F.col("event_type") == "purchase", F.struct("event_id", "value"))
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id")
    seen = e.withColumn("p", F.last(buys, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.filter("event_type = 'click'").select("event_id", F.col("p.event_id").alias("purchase"), F.col("p.value").alias("value"))

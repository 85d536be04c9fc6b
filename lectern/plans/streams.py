"""The streams over the whole tables, and the batch folds that they twin.

A walk that is clamped after every step is folded in chunks: the steps of one chunk are the function
``x -> min(hi, max(lo, x + c))``, such functions compose to another one, and the chunks of a key are
then composed in order.  So no task gets all of a key's events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.base import ORACLE, Dialect, both, with_views
from lectern.plans.scalars import normal_url
from lectern.registry import query
from lectern.streaming import events as streams
from lectern.streaming.cache import cached


def walk(d: Dialect, table: str, keys: str, start: int, up: int, down: int, least: int, most: int) -> str:
    """(keys, value): ``start``, then for each row by (ts, event_id) ``up`` if ok, else ``down``, clamped each time."""
    if not d.spark:
        step = f"cast(least({most}, greatest({least}, a + case when x = 1 then {up} else {down} end)) as bigint)"
        return f"select {keys}, list_reduce(list_prepend(cast({start} as bigint), list(cast(ok as bigint) + 0 order by ts, event_id)), lambda a, x: {step}) as value from {table} group by {keys}"
    clamp = lambda x: f"least({most}, greatest({least}, {x} + if(e.ok, {up}, {down})))"
    chunk = f"""aggregate(array_sort(collect_list(struct(ts, event_id, ok))), named_struct('c', 0, 'lo', {least}, 'hi', {most}),
        (a, e) -> named_struct('c', a.c + if(e.ok, {up}, {down}), 'lo', {clamp('a.lo')}, 'hi', {clamp('a.hi')}))"""
    return f"""select {keys}, cast(aggregate(array_sort(collect_list(struct(hour, f))), {start}, (x, s) -> least(s.f.hi, greatest(s.f.lo, x + s.f.c))) as bigint) as value
        from (select {keys}, date_trunc('hour', ts) as hour, {chunk} as f from {table} group by {keys}, date_trunc('hour', ts)) h group by {keys}"""


def feed_health(d: Dialect) -> str:
    return f"""select w.feed, w.value as health, r.errors, w.value <= 20 and r.errors >= 5 as blocked from ({walk(d, 'feed_runs', 'feed', 100, 5, -10, 0, 100)}) w
        join (select f.feed, cast(count(case when l.event_id is null or f.ts > l.ts or (f.ts = l.ts and f.event_id > l.event_id) then 1 end) as bigint) as errors
              from feed_runs f left join (select feed, max(case when ok then ts end) as ts, max(case when ok and ts = top then event_id end) as event_id
                  from (select g.*, t.top from feed_runs g left join (select feed as of_feed, max(ts) as top from feed_runs where ok group by feed) t on t.of_feed = g.feed) x group by feed) l
              on l.feed = f.feed group by f.feed) r on r.feed = w.feed"""


both("DML11", feed_health)
both("FLT12", lambda d: f"select feed, health, case when health > 30 and not blocked then 'healthy' else 'unhealthy' end as state from ({feed_health(d)}) h where not (health <= 30 and errors = 0 and not blocked)")
both("LRN14", lambda d: f"select user_id, item, value as mastery from ({walk(d, 'review_events', 'user_id, item', 0, 1, -1, 0, 10)}) w")


@query("STM1", with_views("select user_id, item, level, reviews from item_state", ORACLE))
def stm1(spark, sf_dir):
    events = streams.source(spark, sf_dir, "events")
    reviews = events.select("user_id", (F.col("event_id") % 40).alias("item"), "ts", "event_id", (F.col("value") >= 50).alias("ok"))
    return streams.levels(reviews)


@query("STM2", with_views(feed_health(ORACLE), ORACLE))
def stm2(spark, sf_dir):
    events = streams.source(spark, sf_dir, "events")
    runs = events.select((F.col("user_id") % 40).alias("feed"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return streams.run_once(streams.health(runs), ["feed"])


@query(
    "STM3",
    """select user_id, strftime(ts, '%Y-%m') as month, cast(sum(cast(floor(value) as bigint)) as bigint) as tokens,
    sum(cast(floor(value) as bigint)) >= 0.8 * case user_id % 4 when 0 then 300 when 1 then 1500 when 2 then 6000 else 50000 end as alerted
    from events where event_type in ('purchase', 'click') group by 1, 2""",
)
def stm3(spark, sf_dir):
    return streams.run_once(streams.usage(streams.source(spark, sf_dir, "events")), ["user_id", "month"])


@query("STM4", "select date_diff('day', date '2024-01-01', cast(ts + interval '9' hour as date)) as kst_day, count(*) as n from events group by 1")
def stm4(spark, sf_dir):
    return streams.run_once(streams.daily(streams.source(spark, sf_dir, "events")), ["kst_day"])


@query("STM5", f"select distinct sha256({normal_url(ORACLE)}) as url_hash from pages")
def stm5(spark, sf_dir):
    return streams.run_once(streams.new_pages(streams.source(spark, sf_dir, "pages")), ["url_hash"], "append")


QUEUE = "(select event_id, row_number() over (partition by user_id order by case when event_type = 'purchase' then 0 else 1 end, ts, event_id) as place from events where ts + interval '1' hour > timestamp '2024-01-20 00:00:00')"
#: What a cache of one hour has for each event of a user, one after the other.
CACHED = f"""with recursive r as (select user_id, event_id, epoch_ms(ts) as ms, row_number() over (partition by user_id order by epoch_ms(ts), event_id) as k from events),
    f as (select user_id, event_id, k, ms as put, 'miss' as cache from r where k = 1 union all
        select r.user_id, r.event_id, r.k, case when r.ms >= f.put + 3600000 then r.ms else f.put end, case when r.ms >= f.put + 3600000 then 'miss' else 'hit' end from f join r on r.user_id = f.user_id and r.k = f.k + 1)
    select f.event_id, q.place, f.cache from f left join {QUEUE} q on q.event_id = f.event_id"""


@query("DML16", CACHED)
def queue_and_cache(spark, sf_dir):
    """Every event with its place in its user's queue, urgent ones first, if it is not over, and what the user's cache of one hour has for it."""
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    events, before = streams.source(spark, sf_dir, "events"), spark.conf.get(name)
    at = F.expr("timestamp_millis(timestampdiff(millisecond, timestamp_ntz'1970-01-01 00:00:00', ts))")
    spark.conf.set(name, rocks)  # timers need it
    try:
        told = streams.run_once(cached(events.select(F.col("user_id").alias("key"), at.alias("at"), "event_id"), "1 day"), ["event_id"], "append")
    finally:
        spark.conf.set(name, before)
    queue = spark.sql(f"select * from {QUEUE.replace('from events', 'from {events}')}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return told.where("event_id is not null").select("event_id", F.col("what").alias("cache")).join(queue, "event_id", "left")

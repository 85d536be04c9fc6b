"""Levels over micro-batches against a walk over the answers, and without a Python state for every key."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Row

from lectern.plans import streams as plans
from lectern.streaming import events
from lectern.streaming.cache import LIFE_MS, Cache


def test_levels_go_on_from_one_micro_batch_to_the_next(spark, tmp_path):
    rng, schema = random.Random(4), "user_id long, item long, ts timestamp, event_id long, ok boolean"
    rows = [(rng.randrange(6), rng.randrange(3), datetime(2024, 1, 1) + timedelta(minutes=i // 2), i, rng.random() < 0.8) for i in range(600)]
    want = {}
    for user, item, _, _, ok in rows:
        level, n = want.get((user, item), (0, 0))
        want[user, item] = (min(5, level + 1) if ok else 0, n + 1)
    for k in range(3):  # written one after the other, and read in that order
        part = rows[k * 200 : (k + 1) * 200]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {(r.user_id, r.item): (r.level, r.reviews) for r in events.levels(stream).collect()}
    assert got == want and len({level for level, _ in want.values()}) > 3


def test_no_key_is_handed_to_python(spark, monkeypatch):
    monkeypatch.delattr("pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.applyInPandasWithState")
    assert plans.stm1(spark, "/root/testdata/sf0.001").count() > 100


class Calls:
    """A handle, its value state and its timers, which keep what they are asked."""

    def __init__(self, value=None):
        self.made, self.value = [], value

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.made.append("get")
        return self.value

    def __getattr__(self, name):
        return lambda *a: self.made.append(name)


def test_a_key_of_the_cache_asks_for_its_state_once():
    calls = Calls((0,))
    cache = Cache()
    cache.init(calls)
    asked = [Row(key=7, ms=m, event_id=e) for m, e in ((9, 3), (5, 2), (5, 1))]
    assert [tuple(r) for r in cache.handleInputRows((7,), iter(asked), None)] == [(7, 5, 1, "hit"), (7, 5, 2, "hit"), (7, 9, 3, "hit")]
    assert calls.made == ["get"]
    over = type("Timer", (), {"getExpiryTimeInMs": lambda self: LIFE_MS})()
    assert [tuple(r) for r in cache.handleExpiredTimer((7,), None, over)] == [(7, LIFE_MS, None, "evicted")]
    assert calls.made == ["get", "clear"]

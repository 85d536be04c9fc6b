"""The cache across micro-batches: kept before an hour is over, gone at it."""

from datetime import datetime, timedelta

import pytest

from lectern.streaming.cache import LIFE_MS, cached

START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_evicted_at_one_hour_and_kept_before(rocks, tmp_path):
    batches = [[(1, 0, 1), (2, 5, 2)], [(1, 59, 3), (2, 64, 4)], [(1, 60, 5), (2, 66, 6), (3, 70, 7)], [(9, 400, 8)], [(9, 401, 9)]]
    schema, got = "key long, at timestamp, event_id long", []
    stream = cached(rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), "10 minutes")
    keep = lambda batch, n: got.extend((r.key, (r.ms - int(START.timestamp() * 1000)) // 60000, r.event_id, r.what) for r in batch.collect())
    for k, rows in enumerate(batches):  # a run for each: the state lies in the checkpoint between them
        rocks.createDataFrame([(i, START + timedelta(minutes=m), e) for i, m, e in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/log").foreachBatch(keep).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert LIFE_MS == 60 * 60000
    told = lambda key: sorted((m, w) for k, m, _, w in got if k == key)
    assert told(1) == [(0, "miss"), (59, "hit"), (60, "evicted"), (60, "miss"), (120, "evicted")]
    assert told(2) == [(5, "miss"), (64, "hit"), (65, "evicted"), (66, "miss"), (126, "evicted")]
    assert told(3) == [(70, "miss"), (130, "evicted")] and told(9) == [(400, "miss"), (401, "hit")]
    assert sorted(e for *_, e, _ in got if e is not None) == list(range(1, 10))

"""A cache with a life of one hour, as keyed state with timers: what is asked for again within it is a hit, and it goes when it is over."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIFE_MS = 3_600_000
_told = Row("key", "ms", "event_id", "what")


class Cache(StatefulProcessor):
    """A key's state is the time at which its entry was put; a timer at the end of its life takes it away."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", "put_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        asked = sorted(((r.ms, r.event_id) for r in rows), key=lambda r: [(v is None, v or 0) for v in r])
        held = self.entry.get()
        put = timer = held[0] if held else None
        for ms, event in asked:
            if put is not None and ms is not None and ms >= put + LIFE_MS:
                yield _told(key[0], put + LIFE_MS, None, "evicted")
                put = None
            yield _told(key[0], ms, event, "miss" if put is None else "hit")
            put = ms if put is None else put
        if put != timer:
            if timer is not None:
                self.handle.deleteTimer(timer + LIFE_MS)
            self.entry.update((put,))
            self.handle.registerTimer(put + LIFE_MS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        """A key has one timer at most, that of the entry that its state holds."""
        self.entry.clear()
        yield _told(key[0], expiredTimerInfo.getExpiryTimeInMs(), None, "evicted")

    def close(self) -> None:
        pass


def cached(requests: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(key, ms, event_id, what) of (key, at, event_id): a miss, a hit, or (no event) the eviction of the key's entry.

    The entry of a miss lives for an hour; a hit doesn't lengthen it.  A key's rows of one micro-batch are sorted and held at once,
    so bound the batches; rows later than ``late`` are left out.
    """
    rows = requests.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("key").transformWithState(Cache(), "key long, ms long, event_id long, what string", "Append", "EventTime")

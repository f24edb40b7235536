"""Structured Streaming forms: rate windows and limits over events, and sync over landed snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.commits import CommitLog, Snapshot


def rate_windows(events: DataFrame, user: str = "user_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Hits of each user in each minute, batch or stream."""
    e = events.withColumn("at", F.col(ts).cast("timestamp"))
    e = e.withWatermark("at", late) if events.isStreaming else e
    return e.groupBy(F.window("at", "1 minute").alias("w"), F.col(user)).agg(F.count("*").alias("hits")).select(F.col("w.start").alias("minute"), user, "hits")


def _seconds(ts: str) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).cast("long")


def rate_limits(events: DataFrame, limit: int, window: int = 60, key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Events with count (the hit's number in its window, from 1), allowed (up to ``limit``) and reset (seconds until the
    window ends). Windows are fixed stretches of ``window`` seconds. Hits of a window come by time, then ``order``; rows
    with a null key or time have no part.

    A window of a key that is very busy is numbered by seconds first: hits are counted for each second and only those of
    one second are sorted together.
    """
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_s", _seconds(ts)).withColumn("_w", F.floor(F.col("_s") / window))
    each = e.groupBy(key, "_w", "_s").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key, "_w").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), before.alias("_before"))
    met = e.join(each, (e[key] == each["_k"]) & (e["_s"] == each["_t"]))
    count = F.col("_before") + F.row_number().over(Window.partitionBy(key, "_s").orderBy(ts, order))
    return met.withColumn("count", count).withColumns({"allowed": F.col("count") <= limit, "reset": window - F.pmod("_s", F.lit(window))}).select(*events.columns, "count", "allowed", "reset")


class _Limiter(StatefulProcessor):
    """Counts of a key's open windows; a timer at a window's end (by the watermark) lets its count go."""

    def __init__(self, limit: int, window: int, seconds: str, order: str):
        self.limit, self.window, self.seconds, self.order = limit, window, seconds, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "w long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values([self.seconds, self.order], kind="stable")
        slot = own[self.seconds] // 1_000_000 // self.window
        count = own.groupby(slot).cumcount() + 1
        for w in slot.unique().tolist():
            had = self.counts.getValue((w,))[0] if self.counts.containsKey((w,)) else 0
            count[slot == w] += had
            self.counts.updateValue((w,), (had + int((slot == w).sum()),))
            self.handle.registerTimer((w + 1) * self.window * 1000)
        yield pd.DataFrame({"key": key[0], "id": own[self.order], "count": count, "allowed": count <= self.limit, "reset": self.window - own[self.seconds] // 1_000_000 % self.window})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        w = expiredTimerInfo.getExpiryTimeInMs() // 1000 // self.window - 1
        if self.counts.containsKey((w,)):
            self.counts.removeKey((w,))
        return iter([])

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, limit: int, window: int = 60, key: str = "user_id", ts: str = "ts", order: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Rows (key, id, count, allowed, reset) of a stream of events as rate_limits has them for a table, decided as each
    batch comes: the state is a count for each open window of a key (in RocksDB: the session's setting for state stores). Hits of a batch come by time, then ``order``; a hit
    that arrives after others of its window counts after them. Windows are let go at the watermark, ``late`` behind."""
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    e = e.select(F.col(key).alias("key"), F.col(order).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("at")).withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    kind = events.schema[key].dataType.simpleString()
    return e.groupBy("key").transformWithStateInPandas(_Limiter(limit, window, "us", "id"), f"key {kind}, id long, count long, allowed boolean, reset long", "update", "EventTime")


def sync_once(log: CommitLog, name: str, folder: str, schema: str, sync: Callable[[DataFrame, Snapshot], dict], checkpoint: str):
    """Commit what ``sync`` makes of each batch of files that has landed since the last run: (batch, last snapshot) to the
    tables to write. The batch's number is part of the commit, so that one which comes again changes nothing.
    """
    landed = log.spark.readStream.schema(schema).json(folder)

    def each(batch: DataFrame, number: int) -> None:
        log.update(lambda base: sync(batch, base), batch=(name, number))

    return landed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_stream(spark, folder: str, schema: str, sync: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``sync`` once over each batch of snapshot files that has landed since the last run."""
    landed = spark.readStream.schema(schema).json(folder)
    return landed.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

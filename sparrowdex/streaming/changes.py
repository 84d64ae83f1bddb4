"""Streams: upserts of changes, windowed counts, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparrowdex.operators.index import latest_changes


class VersionedTable:
    """A keyed table as numbered folders of one shared directory; a batch of changes makes a new version.

    A version is complete once its folder has the writer's success mark, so a lost executor or driver leaves the last one.
    """

    def __init__(self, spark, path: str, key: str, at: str, op: str) -> None:
        self.spark, self.path, self.key, self.at, self.op = spark, path.rstrip("/"), key, at, op

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """Number of the newest complete version, -1 without any."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return -1
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(path(self.path)) if fs.exists(path(s.getPath(), "_SUCCESS"))]
        return max(done, default=-1)

    def read(self) -> DataFrame | None:
        """The newest version, with deleted keys still in it as marks; None without any."""
        v = self.version()
        return None if v < 0 else self.spark.read.parquet(f"{self.path}/v{v:08d}")

    def live(self) -> DataFrame | None:
        """The newest version without deleted keys."""
        t = self.read()
        return None if t is None else t.where(F.col(self.op) != "remove")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch, the last change of a key winning by time over older ones, late ones too. For foreachBatch.

        Running a batch again changes nothing, as the same changes win again.
        """
        old = self.read()
        both = batch if old is None else old.unionByName(batch)
        latest_changes(both, self.key, self.at).select(*batch.columns).write.mode("overwrite").parquet(f"{self.path}/v{self.version() + 1:08d}")


def upsert_stream(changes: DataFrame, table: VersionedTable, checkpoint: str, interval: str | None = "1 second"):
    """Start the stream of changes into the table; interval None takes what is there and ends."""
    w = changes.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if interval is None else w.trigger(processingTime=interval)).start()


def tumbling_counts(events: DataFrame, at: str, kind: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, kind, n, total) by epoch-aligned windows of a batch or a stream. With `late`, a stream drops events that are
    later than that behind its newest; without, windows never close. Null times are in no window."""
    e = events.withColumn("__at", F.col(at).cast("timestamp"))
    e = e.withWatermark("__at", late) if late else e
    g = e.where("__at IS NOT NULL").groupBy(F.window("__at", width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), kind, "n", "total")


def late_rows(rows: DataFrame, arrival: str, at: str, allowed: int) -> DataFrame:
    """Rows whose time `at` (a whole number) lies more than `allowed` behind the greatest of all rows that arrived before.

    arrival numbers the rows in their order. Maxima are taken inside blocks of 2 ** 12 arrivals, over the blocks of 2 ** 24, and over
    those, of which there are few, so no task sees all rows. Null times are never late.
    """
    e = rows.withColumn("__b", F.shiftright(F.col(arrival).cast("long"), 12)).withColumn("__c", F.shiftright(F.col(arrival).cast("long"), 24))
    blocks = e.groupBy("__c", "__b").agg(F.max(at).alias("__top"))
    wide = blocks.groupBy("__c").agg(F.max("__top").alias("__top"))
    wide = wide.select("__c", F.max("__top").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)).alias("__far"))
    near = blocks.select("__c", "__b", F.max("__top").over(Window.partitionBy("__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__near"))
    inside = F.max(at).over(Window.partitionBy("__b").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    all_ = e.withColumn("__own", inside).join(near, ["__c", "__b"]).join(F.broadcast(wide), "__c")
    newest = F.greatest("__own", "__near", "__far")
    return all_.where(F.col(at) < newest - allowed).select(*rows.columns)


def rate_limited(hits: DataFrame, key: str, at_ms: str, limit: int = 100, window_ms: int = 1000) -> DataFrame:
    """(key, at, refused) of each hit: a key's first hit opens a window of window_ms, a later hit beyond it the next one;
    hits after the `limit`-th of a window are refused. Hits of a key are taken in order of time, a sorted stream of
    batches within a task, so a key of very many hits needs no more memory than one batch; as a window depends on the one
    before, one key's hits are taken by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, opened, count = None, 0, 0
        for b in batches:
            out = []
            for k, t in zip(b["key"], b["at"]):
                if k != who or t > opened + window_ms:
                    who, opened, count = k, t, 0
                count += 1
                out.append(count > limit)
            b["refused"] = out
            yield b

    rows = hits.select(F.col(key).cast("string").alias("key"), F.col(at_ms).cast("long").alias("at")).where("key IS NOT NULL AND at IS NOT NULL")
    return rows.repartition("key").sortWithinPartitions("key", "at").mapInPandas(run, "key string, at long, refused boolean")


def rate_limit_stream(hits: DataFrame, key: str, at_ms: str, limit: int = 100, window_ms: int = 1000) -> DataFrame:
    """The same as a stream with a key's open window as state, which expires after a minute without hits."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, count = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for t in rows["at"]:
            if opened < 0 or t > opened + window_ms:
                opened, count = int(t), 0
            count += 1
            out.append(count > limit)
        state.update((opened, count))
        state.setTimeoutDuration(60_000)
        yield pd.DataFrame({"key": k[0], "at": rows["at"].to_numpy(), "refused": out})

    rows = hits.select(F.col(key).cast("string").alias("key"), F.col(at_ms).cast("long").alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, at long, refused boolean", "opened long, count int", "append", GroupStateTimeout.ProcessingTimeTimeout)

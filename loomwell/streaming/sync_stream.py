"""Incremental synchronising with Structured Streaming: new files of listings or posts, upserted micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwell.operators.sync import latest


def sync_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, by: list[str], order: list[str], most_files: int | None = None) -> None:
    """Take every file not taken yet, then stop. Each micro-batch rewrites the target as one new version.

    Exactly once: versions are named by the batch id, so a batch that is run again after a failure overwrites its own.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files or 1000).parquet(source)

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = latest(batch, by, *order)
        before = current(spark, target, schema, below=batch_id)
        both = before.unionByName(fresh) if before is not None else fresh
        latest(both, by, *order).write.mode("overwrite").parquet(f"{target}/batch-{batch_id:08d}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str, schema: str, below: int | None = None) -> DataFrame | None:
    """The newest finished version of the target."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(target)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    done = sorted(p.getPath().toString() for p in fs.listStatus(at) if p.getPath().getName().startswith("batch-") and fs.exists(jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS")))
    done = [d for d in done if below is None or int(d.rsplit("-", 1)[1]) < below]
    return spark.read.schema(schema).parquet(done[-1]) if done else None


def windowed_counts(events: DataFrame, ts: str, key: str, window: str, late: str) -> DataFrame:
    """Counts a key and event-time window; rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark: what overlapping polls of a feed need."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def retry_timers(failures: DataFrame, key: str, ts: str, days: int = 3, late: str = "0 seconds") -> DataFrame:
    """failures (key, ts, permanent) to (key, failures, retry_at, due): state a key; permanent ones have no retry.

    A row comes when failures arrive, and one with ``due`` when the watermark passes the retry: the timer fires once,
    and a new failure sets it anew.
    """

    def told(k: tuple, n: int, retry: int | None, due: bool) -> pd.DataFrame:
        at = pd.Series([None if retry is None else pd.Timestamp(retry, unit="us")], dtype="datetime64[us]")
        return pd.DataFrame({key: [k[0]], "failures": [n], "retry_at": at, "due": [due]})

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, final = state.get if state.exists else (0, 0, False)
        fired = state.hasTimedOut
        if not fired:
            for b in batches:
                n, last, final = n + len(b), max(last, int(b[ts].max().value // 1000)), final or bool(b["permanent"].any())
        state.update((n, last, final))  # when a timer fired too: that takes the timer away
        retry = None if final else last + days * 86_400_000_000
        due = fired or (retry is not None and retry // 1000 <= state.getCurrentWatermarkMs())
        if retry is not None and not due:
            state.setTimeoutTimestamp(retry // 1000)
        yield told(k, n, retry, due)

    kind = failures.schema[key].dataType.simpleString()
    keyed = failures.withWatermark(ts, late).groupBy(key)
    return keyed.applyInPandasWithState(step, f"`{key}` {kind}, failures long, retry_at timestamp, due boolean", "n long, last long, final boolean", "update", GroupStateTimeout.EventTimeTimeout)

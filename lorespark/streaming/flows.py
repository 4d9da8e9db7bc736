"""Streaming transformations; each also works on a batch DataFrame where Spark allows it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """df with a watermark; zoneless times are read in the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def consume_once(df: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; state is dropped after the watermark."""
    return with_event_time(df, time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, time: str, *by: str, length: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows in tumbling windows, or sliding ones with a slide."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return with_event_time(df, time, delay).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))


def session_counts(df: DataFrame, time: str, *by: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return with_event_time(df, time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))


def breaker_windows(df: DataFrame, time: str, failed: Column, ratio: float = 0.5, least: int = 5, length: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """For each window the calls, the failures, and whether their share opens the breaker."""
    window = F.window(time, length)
    counted = with_event_time(df, time, delay).groupBy(window.alias("w")).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures"))
    return counted.withColumn("open", (F.col("calls") >= least) & (F.col("failures") >= ratio * F.col("calls")))


def breaker_states(
    df: DataFrame, resource: str, time: str, failed: Column, threshold: float = 0.5, by_ratio: bool = True, least: int = 5, interval_ms: int = 1000, open_ms: int = 10_000, delay: str = "1 minute"
) -> DataFrame:
    """(resource, ms, failed, state) of each call, in order of time within a batch: passed, probe (let through to try) or blocked.

    A resource opens once at least ``least`` calls that passed within interval_ms hold failures above the threshold: a share of
    them, or with by_ratio off a number. For open_ms all its calls are blocked; the next one is a probe, whose success closes it
    and whose failure opens it again. State is one small row for each resource.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, calls, bad, until = state.get if state.exists else (0, 0, 0, -1)
        for batch in [pd.concat(list(batches)).sort_values(["_ms", "_failed"])]:
            shown = []
            for ms, wrong in zip(batch["_ms"].tolist(), batch["_failed"].tolist()):
                if 0 <= until and ms < until:
                    shown.append("blocked")
                    continue
                if until >= 0:
                    shown.append("probe")
                    since, calls, bad, until = ms, 0, 0, ms + open_ms if wrong else -1
                    continue
                if ms >= since + interval_ms:
                    since, calls, bad = ms, 0, 0
                calls, bad = calls + 1, bad + wrong
                shown.append("passed")
                if calls >= least and (bad / calls if by_ratio else bad) >= threshold and bad:
                    until = ms + open_ms
            yield pd.DataFrame({resource: key[0], "ms": batch["_ms"], "failed": batch["_failed"], "state": shown})
        state.update((since, calls, bad, until))

    rows = with_event_time(df, time, delay).select(F.col(resource).cast("string").alias(resource), F.unix_millis(time).alias("_ms"), failed.alias("_failed"))
    return rows.groupBy(resource).applyInPandasWithState(
        run, f"{resource} string, ms long, failed boolean, state string", "since long, calls long, bad long, until long", "append", GroupStateTimeout.NoTimeout
    )


def expiring_keys(df: DataFrame, key: str, time: str, ttl: str, delay: str = "1 hour") -> DataFrame:
    """(key, since, expires, n): the spans of time in which a key is held, each use of which renews it for ttl. A key in none of its spans is gone."""
    spans = with_event_time(df, time, delay).groupBy(F.session_window(time, ttl).alias("w"), key).agg(F.count("*").alias("n"))
    return spans.select(key, F.col("w.start").alias("since"), F.col("w.end").alias("expires"), "n")


def live_keys(df: DataFrame, key: str, time: str, ttl_seconds: int, delay: str = "1 minute") -> DataFrame:
    """(key, first_seen, n) emitted once a key has not been seen for ttl_seconds of event time."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "first_seen": [first], "n": [n]})
            return
        first, n = state.get if state.exists else (None, 0)
        last = 0
        for batch in batches:
            seen = batch["_ms"]
            first = int(seen.min()) if first is None else min(first, int(seen.min()))
            last, n = max(last, int(seen.max())), n + len(batch)
        state.update((first, n))
        state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = with_event_time(df, time, delay).select(F.col(key).cast("long").alias(key), time, F.unix_millis(time).alias("_ms"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, first_seen long, n long", "first long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def ingest(source: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """apply(batch, number) for each micro-batch. apply must be an upsert by key, so that a repeated batch changes nothing."""
    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def bounded_files(spark: SparkSession, path: str, schema, max_bytes: int) -> DataFrame:
    """A stream of Parquet files, of which a batch takes no more than max_bytes, or one file that is larger."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(path)


def next_limit(limit: int, took: float, seconds: float, least: int, most: int) -> int:
    """The bytes that the next batches may take: as they are while a batch takes half to twice the wanted seconds, else in proportion, at most four times as many."""
    if seconds / 2 <= took <= seconds * 2:
        return limit
    return int(min(most, max(least, limit * min(4.0, seconds / max(took, 1e-3)))))


def ingest_paced(
    spark: SparkSession, path: str, schema, apply: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 60, first: int = 256 << 20, least: int = 16 << 20, most: int = 16 << 30
) -> list[dict]:
    """ingest what is at path, in batches whose bytes follow the time that the last one took. Gives (limit, batch, rows, seconds) of each batch.

    A stream whose limit no longer fits is stopped and goes on from its checkpoint with another one; a batch that was cut short is done
    again, as after any failure. What is made doesn't depend on the limits, given an apply as ``ingest`` asks for.
    """
    limit, done = max(least, min(first, most)), {}
    while True:
        query, fits = ingest(bounded_files(spark, path, schema, limit), apply, checkpoint), True
        while fits and not query.awaitTermination(1):
            fits = note(query, limit, done) is None or next_limit(limit, note(query, limit, done), seconds, least, most) == limit
        if not fits:
            query.stop()
        last = note(query, limit, done)
        if fits:
            query.awaitTermination()  # raises what ended it, if it failed
            return [done[b] for b in sorted(done)]
        limit = next_limit(limit, last, seconds, least, most)


def note(query: StreamingQuery, limit: int, done: dict[int, dict]) -> float | None:
    """Take note of a query's batches; the seconds of its last one with rows."""
    took = None
    for p in query.recentProgress:
        if p["numInputRows"]:
            took = p["durationMs"].get("triggerExecution", 0) / 1000
            done.setdefault(p["batchId"], {"limit": limit, "batch": p["batchId"], "rows": p["numInputRows"], "seconds": took})
    return took


def run_to_end(spark: SparkSession, out: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream over present input gives: a read of Parquet files beside the checkpoint, in a shared folder.

    The checkpoint must be a new one. Each batch of complete mode replaces the result, so it is written to a table of its own and the last one is read.
    """
    path, last = f"{checkpoint.rstrip('/')}-{name}", []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last[:] = [number]

    writer = out.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(keep).start() if mode == "complete" else writer.format("parquet").start(path)
    query.awaitTermination()
    if mode == "complete":
        path = f"{path}/{last[0]}" if last else None
    elif not query.recentProgress:
        path = None
    return spark.read.schema(out.schema).parquet(path) if path else spark.createDataFrame([], out.schema)


def progress(query: StreamingQuery) -> dict:
    """How far a query is: its batches and input rows."""
    last = query.lastProgress
    return {"active": query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0}

"""Queries that run streams over the events table to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorespark.sources.work import work_folder
from lorespark.streaming import flows, sessions

from . import standins as S

QUERIES, ORACLES = {}, {}


def _events(spark, sf_dir):
    batch = S.read(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _end(spark, out, mode="append"):
    return flows.run_to_end(spark, out, f"out_{uuid.uuid4().hex}", f"{work_folder(spark, 'stream')}/checkpoint", mode)


def stream_dedup(spark, sf_dir):
    """Each user's token is consumed once; the stand-in token is the user and kind of event."""
    rows = _events(spark, sf_dir).withColumn("token", F.concat_ws("-", "user_id", "event_type"))
    return _end(spark, flows.consume_once(rows, "token", "ts", "400 days").select("token"))


def stream_windows(spark, sf_dir):
    out = flows.windowed_counts(_events(spark, sf_dir), "ts", "event_type", length="1 day")
    return _end(spark, out, "complete").select(F.unix_seconds("w.start").alias("start"), "event_type", "n")


def stream_sessions(spark, sf_dir):
    out = flows.session_counts(_events(spark, sf_dir), "ts", "user_id", gap="12 hours")
    return _end(spark, out, "complete").select(F.unix_seconds("w.start").alias("start"), "user_id", "n")


def stream_breaker(spark, sf_dir):
    out = flows.breaker_windows(_events(spark, sf_dir), "ts", F.col("event_type") == "error", ratio=0.3, least=3, length="1 hour")
    return _end(spark, out, "complete").select(F.unix_seconds("w.start").alias("start"), "calls", "failures", "open")


def stream_ttl(spark, sf_dir):
    """Refresh tokens of users, held for six hours after each use."""
    out = flows.expiring_keys(_events(spark, sf_dir), "user_id", "ts", "6 hours")
    return _end(spark, out, "complete").select("user_id", F.unix_seconds("since").alias("since"), F.unix_seconds("expires").alias("expires"), "n")


def stream_breaker_states(spark, sf_dir):
    """Calls of five services; one of them opens at three failures of 30 minutes, for two hours."""
    rows = _events(spark, sf_dir).withColumn("service", F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")))
    out = flows.breaker_states(rows, "service", "ts", F.col("event_type") == "error", threshold=3, by_ratio=False, least=1, interval_ms=1_800_000, open_ms=7_200_000)
    return _end(spark, out).groupBy("service", "state").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"))


def stream_session_keys(spark, sf_dir):
    """Refresh tokens of users, three each, kept for two days: saved, consumed once, looked up, and revoked all together."""
    op = F.when(F.col("event_type").isin("view", "signup"), sessions.SAVE).when(F.col("event_type") == "click", sessions.CONSUME).when(F.col("event_type") == "error", sessions.REVOKE).otherwise(sessions.HAS)
    token = F.when(F.col("event_type") == "error", "refresh:").otherwise(F.concat(F.lit("refresh:"), (F.col("event_id") % 3).cast("string")))
    rows = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), op.alias("op"), token.alias("token"), F.lit(2 * 86_400_000).alias("ttl"), "ts")
    with sessions.rocks_store(spark):
        return _end(spark, sessions.session_keys(rows, "ts")).select("user_id", "seq", "op", "found", "n")


QUERIES |= {f.__name__: f for f in (stream_session_keys, stream_dedup, stream_windows, stream_sessions, stream_breaker, stream_ttl, stream_breaker_states)}
ORACLES |= {
    "stream_session_keys": """WITH ops AS (
        SELECT user_id, event_id AS seq, epoch_ms(ts) AS ms, event_id % 3 AS t,
               CASE event_type WHEN 'click' THEN 'consume' WHEN 'error' THEN 'revoke' WHEN 'purchase' THEN 'has' ELSE 'save' END AS op FROM events),
        each AS (SELECT user_id, seq, ms, op, k FROM ops, range(3) r(k) WHERE op = 'revoke' OR t = k),
        seen AS (SELECT *, max(CASE WHEN op <> 'has' THEN n END) OVER (PARTITION BY user_id, k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
                 FROM (SELECT *, row_number() OVER (ORDER BY ms, seq) AS n FROM each)),
        live AS (SELECT s.user_id, s.seq, s.op, coalesce(p.op = 'save' AND p.ms + 172800000 > s.ms, false) AS was
                 FROM seen s LEFT JOIN seen p ON p.n = s.last AND p.user_id = s.user_id AND p.k = s.k)
        SELECT user_id, seq, op, op = 'save' OR bool_or(was) AS found, (CASE WHEN op = 'save' THEN 1 ELSE count(*) FILTER (was) END)::BIGINT AS n FROM live GROUP BY user_id, seq, op""",
    "stream_dedup": "SELECT DISTINCT user_id || '-' || event_type AS token FROM events",
    "stream_windows": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOURS THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT floor(epoch(min(ts)))::BIGINT AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_ttl": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, floor(epoch(min(ts)))::BIGINT AS since, floor(epoch(max(ts) + INTERVAL 6 HOURS))::BIGINT AS expires, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_breaker": """SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures,
        count(*) >= 3 AND count(*) FILTER (event_type = 'error') >= 0.3 * count(*) AS open FROM events GROUP BY ALL""",
}

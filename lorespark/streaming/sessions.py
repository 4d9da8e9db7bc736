"""Session keys as streaming state: tokens that expire, are consumed once, revoked by prefix, and looked up."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .flows import with_event_time

#: What a row asks for: put a token in, take it out once, take out all tokens that begin like this, see whether one is there.
SAVE, CONSUME, REVOKE, HAS = "save", "consume", "revoke", "has"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "user_id long, seq long, op string, token string, found boolean, n long"


class SessionKeys(StatefulProcessor):
    """The tokens of each user with the time they expire at, in a map; a timer takes out what has expired.

    A token is there from its save until it is consumed, revoked or expired, told by the times of the rows themselves.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getMapState("tokens", "token string", "expires long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # A user's tokens are read once; what changed is put back.
        before = {k[0]: v[0] for k, v in self.tokens.iterator()}
        held, out = dict(before), []
        asked = pd.concat(list(rows)).sort_values(["ms", "seq"], kind="stable")
        for seq, op, token, ms, ttl in asked[["seq", "op", "token", "ms", "ttl"]].itertuples(index=False):
            live = lambda t, ms=ms: held.get(t, ms) > ms
            n = 0
            if op == SAVE and ttl > 0:
                held[token], n = ms + int(ttl), 1
            elif op == CONSUME:
                n = int(live(token))
                held.pop(token, None)
            elif op == REVOKE:
                gone = [t for t in held if t.startswith(token)]
                n = sum(map(live, gone))
                for t in gone:
                    del held[t]
            elif op == HAS:
                n = int(live(token))
            out.append((key[0], seq, op, token, n > 0, n))
        for token in before.keys() - held.keys():
            self.tokens.removeKey((token,))
        for token, expires in held.items():
            if before.get(token) != expires:
                self.tokens.updateValue((token,), (expires,))
                self.handle.registerTimer(expires)
        yield pd.DataFrame(out, columns=["user_id", "seq", "op", "token", "found", "n"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for token in [k[0] for k, v in self.tokens.iterator() if v[0] <= now]:
            self.tokens.removeKey((token,))
        return iter(())

    def close(self) -> None:
        pass


def session_keys(ops: DataFrame, time: str, delay: str = "1 minute") -> DataFrame:
    """(user_id, seq, op, token, found, n) for each row of a stream (user_id, seq, op, token, ttl in ms, time): whether its token was there, and how many it put in or took out.

    A user's rows are applied by time and seq within a micro-batch, and batches one after the other; rows later than delay are dropped.
    A null token is an empty one. Start it within ``rocks_store``.
    """
    rows = with_event_time(ops, time, delay).where("user_id IS NOT NULL").select(
        F.col("user_id").cast("long").alias("user_id"), F.col("seq").cast("long").alias("seq"), "op", F.coalesce("token", F.lit("")).alias("token"),
        F.coalesce("ttl", F.lit(0)).cast("long").alias("ttl"), F.unix_millis(time).alias("ms"), time,
    )
    return rows.groupBy("user_id").transformWithStateInPandas(SessionKeys(), RESULT, "append", "eventTime")


@contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, which map state and timers need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def held_tokens(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(user_id, token, expires) as a query's last batch left them, read from its state: look-ups go by filters on it."""
    with rocks_store(spark):
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "tokens").load()
        return state.select(F.col("key.user_id").alias("user_id"), F.col("user_map_key.token").alias("token"), F.col("user_map_value.expires").alias("expires"))


def has_token(spark: SparkSession, checkpoint: str, user_id: int, token: str, now_ms: int) -> bool:
    """Whether a token is held and hasn't expired: a point look-up in the state."""
    found = held_tokens(spark, checkpoint).where((F.col("user_id") == user_id) & (F.col("token") == token) & (F.col("expires") > now_ms))
    return not found.isEmpty()

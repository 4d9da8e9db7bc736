"""Session keys over several micro-batches, and look-ups in their state."""

from pyspark.sql import functions as F

from lorespark.streaming import sessions

DAY = 86_400_000
#: Seconds at which the first row comes.
BEGIN = 1_000_000


def test_session_keys_over_batches(spark, tmp_path):
    src, checkpoint, out = str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out")
    schema = "user_id long, seq long, op string, token string, ttl long, ts timestamp"
    batches = [
        [(1, 1, "save", "r:a", DAY, 0), (1, 2, "save", "r:b", 10 * DAY, 1), (1, 3, "save", "x:c", 10 * DAY, 2), (2, 4, "save", "r:a", DAY, 3), (2, 5, "save", "r:z", 0, 4), (None, 6, "save", "r:a", DAY, 5)],
        [(1, 8, "consume", "r:b", None, 3600), (1, 7, "has", "r:b", None, 3600), (1, 9, "consume", "r:b", None, 3601), (2, 10, "has", "r:z", None, 3602)],
        [(1, 11, "has", "r:a", None, 90_000), (1, 12, "save", "r:d", DAY, 90_001), (1, 13, "revoke", "r:", None, 90_002), (1, 14, "has", "x:c", None, 90_003), (2, 15, "consume", "r:a", None, 90_004)],
        [(3, 16, "save", None, DAY, 400_000)],
    ]
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(*r[:5], float(BEGIN + r[5])) for r in rows], "user_id long, seq long, op string, token string, ttl long, ts double").withColumn("ts", F.timestamp_seconds("ts"))
        made.coalesce(1).write.mode("append").parquet(src)
        with sessions.rocks_store(spark):
            stream = sessions.session_keys(spark.readStream.schema(schema).parquet(src), "ts")
            stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        if i == 1:
            assert sessions.has_token(spark, checkpoint, 1, "r:a", BEGIN * 1000 + 4_000_000) and not sessions.has_token(spark, checkpoint, 1, "r:b", BEGIN * 1000 + 4_000_000)
            assert not sessions.has_token(spark, checkpoint, 1, "r:a", BEGIN * 1000 + DAY + 1) and not sessions.has_token(spark, checkpoint, 7, "r:a", 0)
    got = {r.seq: (r.found, r.n) for r in spark.read.parquet(out).collect()}
    assert got == {
        1: (True, 1), 2: (True, 1), 3: (True, 1), 4: (True, 1), 5: (False, 0), 7: (True, 1), 8: (True, 1), 9: (False, 0), 10: (False, 0),
        11: (False, 0), 12: (True, 1), 13: (True, 1), 14: (True, 1), 15: (False, 0), 16: (True, 1),
    }
    # Timers took out what had expired: the token of user 2, and of user 1 only the late one is left.
    left = sorted(tuple(r) for r in sessions.held_tokens(spark, checkpoint).select("user_id", "token").collect())
    assert left == [(1, "x:c"), (3, "")]

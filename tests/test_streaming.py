"""Streams over files that arrive in turns."""

from pyspark.sql import functions as F

from lorespark.sources.keyed import VersionedTable, upsert
from lorespark.streaming import flows


def test_ingest_is_idempotent(spark, tmp_path):
    src, table = tmp_path / "in", VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.createDataFrame([], "id long, v string"))

    def apply(batch, number):
        table.write(upsert(table.read(), batch, "id"))

    for values in ([(1, "a"), (2, "b")], [(2, "c")]):
        spark.createDataFrame(values, "id long, v string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("id long, v string").parquet(str(src))
        query = flows.ingest(stream, apply, str(tmp_path / "c"))
        query.awaitTermination()
        assert flows.progress(query)["active"] is False
        apply(spark.createDataFrame(values, "id long, v string"), 0)
    assert sorted(tuple(r) for r in table.read().select("id", "v").collect()) == [(1, "a"), (2, "c")]


def test_results_of_streams_are_files(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(3):
        df = spark.createDataFrame([(i, "a"), (i + 1, "b")], "s long, k string").select("k", "s", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("k string, s long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    counts = flows.run_to_end(spark, flows.windowed_counts(stream, "ts", "k", length="1 day"), "counts", str(tmp_path / "c1"), "complete")
    once = flows.run_to_end(spark, flows.consume_once(stream, "s", "ts").select("s"), "once", str(tmp_path / "c2"))
    assert sorted((r.k, r.n) for r in counts.collect()) == [("a", 3), ("b", 3)]
    assert sorted(r.s for r in once.collect()) == [0, 1, 2, 3]
    assert counts.inputFiles() and once.inputFiles()


def test_streams_without_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k string, s long, ts timestamp").parquet(str(tmp_path / "in"))
    counts = flows.windowed_counts(stream, "ts", "k", length="1 day")
    assert flows.run_to_end(spark, counts, "no_counts", str(tmp_path / "c1"), "complete").count() == 0
    assert flows.run_to_end(spark, flows.consume_once(stream, "k", "ts"), "no_keys", str(tmp_path / "c2")).count() == 0


def test_breaker_opens_probes_and_closes(spark, tmp_path):
    calls = [(0, 1), (1, 1), (2, 0), (3, 1), (4, 1), (5, 0), (10_003, 0), (10_004, 1), (10_005, 0), (20_100, 1), (25_000, 0), (30_200, 0), (30_300, 1)]
    src = tmp_path / "in"
    for part in (calls[:6], calls[6:]):
        df = spark.createDataFrame([("a", ms, bool(f)) for ms, f in part], "r string, ms long, bad boolean").select("r", "bad", F.timestamp_millis(F.col("ms") + 1_700_000_000_000).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("r string, bad boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = flows.run_to_end(spark, flows.breaker_states(stream, "r", "ts", F.col("bad")), "breaker", str(tmp_path / "c"))
    got = [r.state for r in out.orderBy("ms").collect()]
    # Opened by the fifth call, blocked for ten seconds, closed by a good probe; then too few calls to open.
    assert got == ["passed"] * 5 + ["blocked"] * 2 + ["probe"] + ["blocked"] * 1 + ["probe"] + ["blocked"] + ["probe", "passed"]


def test_live_keys_expire(spark, tmp_path):
    src = tmp_path / "in"
    for i, rows in enumerate([[(1, 0), (1, 5), (2, 8)], [(3, 1000)], [(3, 5000)]]):
        df = spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("k long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = flows.run_to_end(spark, flows.live_keys(stream, "k", "ts", 60), "live", str(tmp_path / "c"))
    got = {(r.k, r.n) for r in out.collect()}
    assert {(1, 2), (2, 1)} <= got


def test_paced_ingest(spark, tmp_path):
    """Batches keep to the limit, which grows while they are quick; what is made is the same."""
    src, rows = str(tmp_path / "in"), 40_000
    spark.range(rows).selectExpr("id", "uuid() AS v").repartition(12).write.parquet(src)
    largest = max(f.stat().st_size for f in (tmp_path / "in").glob("*.parquet"))
    for i, (first, seconds) in enumerate(((2 * largest, 600.0), (largest // 2, 0.0))):
        sizes, seen = {}, {}

        def apply(batch, number):
            sizes[number], got = batch.count(), [r.id for r in batch.select("id").collect()]
            seen[number] = got

        least = largest // 2 if seconds == 0.0 else 1
        done = flows.ingest_paced(spark, src, "id long, v string", apply, str(tmp_path / f"c{i}"), seconds=seconds, first=first, least=least, most=2 * largest)
        assert sorted(x for own in seen.values() for x in own) == list(range(rows))
        assert done and all(d["limit"] <= 2 * largest for d in done) and len(sizes) >= (6 if i == 0 else 12)
        assert all(n <= (2 if i == 0 else 1) * rows / 12 * 1.2 for n in sizes.values())


def test_next_limit():
    assert flows.next_limit(100, 60, 60, 10, 1000) == 100 and flows.next_limit(100, 119, 60, 10, 1000) == 100
    assert flows.next_limit(100, 600, 60, 20, 1000) == 20 and flows.next_limit(100, 240, 60, 10, 1000) == 25
    assert flows.next_limit(100, 1, 60, 10, 1000) == 400 and flows.next_limit(400, 0, 60, 10, 1000) == 1000

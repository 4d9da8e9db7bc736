"""Tables with a commit log: conflicts, deletes in place, gapless ids, compaction."""

import threading
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorespark.operators import lifecycle
from lorespark.sources import log
from lorespark.sources.log import Conflict, LogTable


@pytest.fixture
def table(spark, tmp_path):
    made = LogTable(spark, str(tmp_path / "t"))
    made.create("id long, status int, owner string")
    return made


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def files(path):
    return {f: f.stat().st_mtime_ns for f in Path(path).rglob("d-*/*.parquet")}


def pending(spark, n, parts=3):
    return spark.range(n).select("id", F.lit(0).alias("status"), F.lit(None).cast("string").alias("owner")).repartition(parts)


def test_append_and_versions(spark, table):
    assert table.read().count() == 0 and rows(table.append(pending(spark, 4)), "id") == [(i,) for i in range(4)]
    table.append(pending(spark, 2).withColumn("extra", F.lit(1)))
    assert table.read().count() == 6 and table.read(1).count() == 4 and table.read(0).count() == 0
    table.create("id long")  # changes nothing
    assert table.read().columns == ["id", "status", "owner"]
    with pytest.raises(LookupError):
        table.read(9)
    table.drop()
    assert not table.exists()
    with pytest.raises(LookupError):
        table.read()


def test_delete_leaves_files(spark, table):
    table.append(pending(spark, 1000, 4))
    before = files(table.path)
    assert table.delete(F.col("id") % 3 == 0) == 334
    assert table.delete(keys=spark.range(0, 100).toDF("id")) == 66
    assert table.delete(F.col("id") < 500, but=spark.range(0, 400).toDF("id")) == 67
    assert table.delete(F.col("id") == 3) == 0 and table.delete(F.col("owner") == "x") == 0
    want = [(i,) for i in range(1000) if i % 3 and i >= 100 and not 400 <= i < 500]
    assert rows(table.read(), "id") == want
    assert files(table.path) == before and table.read(2).count() == 666
    assert rows(LogTable(spark, table.path).read(), "id") == want


def test_delete_beyond_the_broadcast(spark, table, monkeypatch):
    monkeypatch.setattr(log, "BROADCAST_GONE", 0)
    table.append(pending(spark, 300))
    table.delete(F.col("id") % 2 == 0)
    assert rows(table.read(), "id") == [(i,) for i in range(1, 300, 2)]


def test_compaction_keeps_rows(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), ids=True)
    table.create("id long, name string")
    table.append(spark.range(100).select(F.concat(F.lit("n"), "id").alias("name")).coalesce(1))
    table.append(spark.range(50).select(F.lit("m").alias("name")).coalesce(1))
    table.delete(F.col("id") <= 60)
    want, before = rows(table.read()), table.state()
    worn = table.compact()
    assert len(worn) == 1 and worn[0] in before.files and worn[0] not in table.state().files
    assert rows(table.read()) == want and table.compact() == [] and table.state().next_id == 151
    assert rows(table.read(before.version)) == want


def test_one_of_two_claims_wins(spark, table):
    """Both see the task pending; the one that commits later finds it taken."""
    table.append(pending(spark, 40))
    inner = []

    def slow(df):
        picked = df.where("id % 3 = 0 AND status = 0")
        if not inner:
            inner.append(rows(lifecycle.claim_in(table, spark.range(0, 40, 2).toDF("id"), owner="fast"), "id"))
        return picked

    won = table.replace(slow, lambda df: df.withColumns({"status": F.lit(1), "owner": F.lit("slow")}))
    assert rows(won, "id") == [(i,) for i in range(0, 40, 3) if i % 2]
    assert inner[0] == [(i,) for i in range(0, 40, 2)]
    got = {r.id: r.owner for r in table.read().collect()}
    assert got == {i: "fast" if i % 2 == 0 else "slow" if i % 3 == 0 else None for i in range(40)}


def test_claims_in_threads(spark, table):
    table.append(pending(spark, 30))
    won, errors = {}, []

    def run(name):
        try:
            own = LogTable(spark, table.path)
            won[name] = [i for i, in rows(lifecycle.claim_in(own, spark.range(30).toDF("id"), owner=name), "id")]
        except Exception as e:  # shown below
            errors.append(e)

    threads = [threading.Thread(target=run, args=(f"w{i}",)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(sum(won.values(), [])) == list(range(30))
    assert Counter(r.owner for r in table.read().collect()) == Counter({k: len(v) for k, v in won.items() if v})


def test_a_conflict_that_never_ends(spark, table):
    table.append(pending(spark, 10, 1))

    def work(now):
        other = LogTable(spark, table.path)
        other.delete(F.col("id") == other.read().agg(F.min("id")).first()[0])
        return table.gone(table.places(now).where("id = 9").select("_file", "_pos"), now)

    with pytest.raises(Conflict):
        table.transact(work, "late", attempts=2)
    assert table.read().count() == 7


def test_appends_are_in_nobodys_way(spark, table):
    table.append(pending(spark, 5))
    tried = []

    def work(now):
        tried.append(now.version)
        LogTable(spark, table.path).append(pending(spark, 1))
        return table.gone(table.places(now).where("id = 4").select("_file", "_pos"), now)

    table.transact(work, "delete")
    assert len(tried) == 1 and rows(table.read(), "id") == [(0,), (0,), (1,), (2,), (3,)]


def test_versions_are_unique(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "v"))
    table.create("kb_id long, file_name string, version int")
    table.append(spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "a", 9)], table.schema()))
    new = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a")], "kb_id long, file_name string")
    once, tries = [], []

    def make(old):
        tries.append(1)
        made = lifecycle.numbered_versions(old, new)
        if not once:
            once.append(rows(lifecycle.insert_versions(table, new.where("kb_id = 1"))))
        return made

    got = table.insert_keyed(make, ["kb_id", "file_name"], new)
    assert once[0] == [(1, "a", 4), (1, "c", 1)] and rows(got) == [(1, "a", 5), (1, "c", 2), (2, "a", 10)] and len(tries) == 2
    assert table.read().groupBy("kb_id", "file_name", "version").count().where("count > 1").count() == 0


@pytest.mark.parametrize("keys", [1, 1000])
def test_other_keys_don_t_conflict(spark, tmp_path, monkeypatch, keys):
    monkeypatch.setattr(log, "KEYS", keys)
    table = LogTable(spark, str(tmp_path / "v"))
    table.create("kb_id long, file_name string, version int")
    new = spark.createDataFrame([(1, "a"), (1, "b")], "kb_id long, file_name string")
    tries = []

    def make(old):
        tries.append(1)
        if len(tries) == 1:
            lifecycle.insert_versions(table, spark.createDataFrame([(5, "z"), (5, "y")], new.schema))
        return lifecycle.numbered_versions(old, new)

    table.insert_keyed(make, ["kb_id", "file_name"], new)
    assert len(tries) == (2 if keys == 1 else 1) and table.read().count() == 4


def test_ids_have_no_gaps(spark, tmp_path):
    """Two inserts at once, each in several files, and rows that get their ids back."""
    table = LogTable(spark, str(tmp_path / "t"), ids=True)
    table.create("id long, name string")
    got, errors = {}, []

    def run(name, n):
        try:
            own = LogTable(spark, table.path, ids=True)
            got[name] = rows(own.append(spark.range(n).select(F.lit(name).alias("name")).repartition(4)), "id", "name")
        except Exception as e:  # shown below
            errors.append(e)

    threads = [threading.Thread(target=run, args=a) for a in (("a", 50), ("b", 70))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and [len(got[k]) for k in "ab"] == [50, 70] and {n for _, n in got["a"]} == {"a"}
    assert rows(table.read()) == sorted(got["a"] + got["b"]) and rows(table.read(), "id") == [(i,) for i in range(1, 121)]
    table.append(spark.range(0).select(F.lit("none").alias("name")))
    assert rows(table.append(spark.createDataFrame([("c",)], "name string"))) == [(121, "c")]


def test_state_is_written_now_and_then(spark, table, monkeypatch):
    monkeypatch.setattr(log, "STATE_EVERY", 2)
    for _ in range(5):
        table.append(pending(spark, 1, 1))
    table.delete(F.col("id") == 0)
    (Path(table.path) / "_commits" / "1.json").rename(Path(table.path) / "_commits" / "away")
    assert LogTable(spark, table.path).read().count() == 0

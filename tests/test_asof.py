"""As-of joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators.asof import asof_join


def brute(left, right, keep):
    out = []
    for g, at, x in left:
        best = max(((b, v, w) for h, b, v, w in right if g is not None and at is not None and h == g and b is not None and b <= at), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]), default=None)
        if best or keep:
            out.append((g, at, x, *(best[1:] if best else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 40])
def test_asof_brute(spark, parts):
    """A hot group over many ranges, ties, nulls on both sides and in values, groups that one side lacks."""
    rng = random.Random(4)
    group = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = [(group(), rng.choice([None, *range(400)]), i) for i in range(600)]
    right = [(rng.choice([group(), "only"]), rng.choice([None, *range(0, 400, 3)]), rng.choice([None, 1, 2]), f"v{i}") for i in range(200)]
    a = spark.createDataFrame(left, "g string, at long, x int")
    b = spark.createDataFrame(right, "g string, at long, v int, w string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keep in (True, False):
            got = sorted((tuple(r) for r in asof_join(a, b, ["g"], "at", keep).collect()), key=repr)
            assert got == brute(left, right, keep)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_empty(spark):
    a, b = spark.createDataFrame([("g", 1)], "g string, at int"), spark.createDataFrame([], "g string, at int, v int")
    assert [tuple(r) for r in asof_join(a, b, ["g"], "at").collect()] == [("g", 1, None)]
    assert asof_join(a, b, ["g"], "at", keep=False).count() == 0 and asof_join(a.limit(0), b, ["g"], "at").count() == 0
    two = spark.createDataFrame([(1, 5, "x")], "g int, at int, v string")
    assert [tuple(r) for r in asof_join(two.select("g", F.lit(9).alias("at")), two, ["g"], "at").collect()] == [(1, 9, "x")]

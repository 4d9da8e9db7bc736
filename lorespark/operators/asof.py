"""As-of join of tables: each row of one side with the last row of the other at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.sources.work import written


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, keep: bool = True) -> DataFrame:
    """left with the columns of right's last row of the same ``by`` whose ``at`` isn't larger; of equal ones the row with the largest other columns.

    Rows without such a one have nulls, or go if keep is false. Null keys meet nothing. The other columns of both sides must differ in name.

    Both sides are dealt together by ranges of (by, at), so a group of any size, hot documents too, is split over as many
    tasks as its rows are worth. Within a range a row takes the last one before it; what a range hands on to those behind
    it is one row for each group that it ends in.
    """
    own = [c for c in left.columns if c not in (*by, at)]
    values = [c for c in right.columns if c not in (*by, at)]
    some = lambda df: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, at)))
    kind = some(right).select(F.struct(*values).alias("v")).schema["v"].dataType
    mine = left.select(*by, at, F.lit(1).alias("_side"), F.struct(*own).alias("_own"), F.lit(None).cast(kind).alias("_value")) if own else None
    if mine is None:
        mine = left.select(*by, at, F.lit(1).alias("_side"), F.struct(F.lit(0).alias("_none")).alias("_own"), F.lit(None).cast(kind).alias("_value"))
    theirs = some(right).select(*by, at, F.lit(0).alias("_side"), F.lit(None).cast(mine.schema["_own"].dataType).alias("_own"), F.struct(*values).alias("_value"))
    dealt = some(mine).unionByName(theirs).repartitionByRange(*by, at, "_side", "_value").withColumn("_range", F.spark_partition_id())
    rows = written(dealt, "ranges")
    before = Window.partitionBy("_range", *by).orderBy(at, "_side", "_value")
    found = rows.withColumn("_last", F.last("_value", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    # What a group's range hands on: one row for each range of the group.
    ends = rows.where("_side = 0").groupBy(*by, "_range").agg(F.max_by("_value", F.struct(at, "_value")).alias("_end"))
    spans = rows.select(*by, "_range").distinct().join(ends, [*by, "_range"], "left")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).where("_carried IS NOT NULL").drop("_end")
    found = found.where("_side = 1").join(carried, [*by, "_range"], "left")
    out = found.select(*by, at, *(F.col(f"_own.{c}").alias(c) for c in own), F.coalesce("_last", "_carried").alias("_value"))
    if keep:
        lost = left.where(" OR ".join(f"`{c}` IS NULL" for c in (*by, at))).select(*by, at, *own, F.lit(None).cast(kind).alias("_value"))
        out = out.unionByName(lost)
    else:
        out = out.where("_value IS NOT NULL")
    return out.select(*left.columns, *(F.col(f"_value.{c}").alias(c) for c in values))

"""As-of joins that split hot keys by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_before(rows: DataFrame, key: list[str], order: list[str], value: Column, block: Column) -> DataFrame:
    """``rows`` with ``last``, the latest non-null ``value`` among the rows of the
    same key that come before in ``order``.

    ``block`` cuts a key's rows into stretches along ``order`` (equal, or
    growing with it). The last value of each stretch is carried over the
    stretches, one row each, and a window within (key, block) does the rest,
    so a key with very many rows is sorted in as many tasks as it has blocks.
    """
    rows = rows.withColumns({"_block": block, "_value": value})
    rank = F.struct(*order)
    ends = rows.where("_value is not null").groupBy(*key, "_block").agg(F.max_by("_value", rank).alias("_end"))
    every = rows.select(*key, "_block").distinct().join(ends, [*key, "_block"], "left")
    carried = every.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    within = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.last("_value", ignorenulls=True).over(within))
    joined = inside.join(carried, [*key, "_block"])
    return joined.withColumn("last", F.coalesce("_inside", "_carried")).drop("_block", "_value", "_inside", "_carried")

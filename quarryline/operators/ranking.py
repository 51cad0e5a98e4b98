"""Positions and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.shared import written


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same keys up to and with this one in the given order.

    The order must be total. A group may hold any share of the rows: rows are split by ranges of (keys, order), each part
    is summed on its own, and the sums of a group's earlier parts, of which there is one for each part, are added.
    Null keys form a group. An empty table stays empty. `value` must not be null.
    """
    part, before = "__part", "__before"
    ranged = written(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(part, F.spark_partition_id()), "ranged")
    local = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, part).agg(F.sum(value).alias(before)).withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    names = [f"__k{i}" for i in range(len(keys))]
    sums = sums.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(part).alias("__p"), before)
    same = (F.col(part) == F.col("__p")) & F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return ranged.withColumn(out, F.sum(value).over(local)).join(sums, same).withColumn(out, F.col(out) + F.col(before)).select(*df.columns, out)


def positions(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """df with `out`: the row's position, from 1, within its keys. As running_sum."""
    one = "__one"
    return running_sum(df.withColumn(one, F.lit(1).cast("long")), keys, order, one, out).drop(one)

"""Global row numbers and running sums without a window over all rows.

A window without partitions moves every row into one task. Here the rows are partitioned by ranges of the order,
each partition numbers its own, and only one number a partition, its total, is gathered: a prefix sum of those is
added to the local results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.plans.scratch import base_folder


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of spark.checkpoint.dir: what was drawn to lay the rows out isn't drawn again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base_folder(df.sparkSession))
    return df.checkpoint()


def ranged(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """df in ranges of the order, with __part, a number that grows with it. Rows that are equal in the order stay together."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))


def running(df: DataFrame, order: list[str], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """df with running sums, the row itself included, in the order given, which must be a total one."""
    parts = ranged(df, order, partitions)
    totals = parts.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = totals.select("__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    out = local.join(F.broadcast(bases), "__part")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, order: list[str], name: str = "position", partitions: int | None = None) -> DataFrame:
    """df with the number of each row in the order, from 0."""
    out = running(df, order, {name: F.lit(1).cast("long")}, partitions)
    return out.withColumn(name, F.col(name) - 1)


def with_previous(df: DataFrame, value: str, position: str = "position", name: str = "previous", rows: int = 1 << 20) -> DataFrame:
    """df with the value one position before; the first has null. Blocks of positions are windows of their own, each with
    a copy of the last row of the block before it."""
    block = F.floor(F.col(position) / rows)
    after = F.floor((F.col(position) + 1) / rows)
    copies = df.withColumn("__block", F.explode(F.when(after > block, F.array(block, after)).otherwise(F.array(block))))
    lagged = copies.withColumn(name, F.lag(value).over(Window.partitionBy("__block").orderBy(position)))
    return lagged.filter(F.col("__block") == block).drop("__block")

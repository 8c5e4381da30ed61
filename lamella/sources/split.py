"""Splitting a table into files of about one size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.handlers import bytes_of
from lamella.operators.stats import plain_size
from lamella.plans.numbering import numbered, running
from lamella.sources.sinks import SinkOptions

FILE_SIZE, ROW_GROUP_SIZE = "100MB", "128MB"


def row_bytes(df: DataFrame) -> Column:
    """An estimate of a row's size before encoding."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        total = total + plain_size(f.name, f.dataType)
    return total


def in_files(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """df in its order, which must be a total one, in partitions of so many rows, of which the last may have fewer: written,
    each is a file, and the files' names are in the order too. A task holds one such part."""
    placed = numbered(df, order, "__at")
    files = max(1, -(-df.count() // rows))
    return placed.repartitionById(files, F.floor(F.col("__at") / rows).cast("int")).sortWithinPartitions("__at").drop("__at")


def split_parts(df: DataFrame, order: list[str], target: int, size: Column | None = None) -> DataFrame:
    """df with part, from 1: a part is full with the row that brings the size before it to a multiple of target."""
    own = size if size is not None else row_bytes(df)
    placed = running(df.withColumn("__own", own), order, {"__upto": F.col("__own")})
    return placed.withColumn("part", (F.floor((F.col("__upto") - F.col("__own")) / target) + 1).cast("long")).drop("__own", "__upto")


def split(df: DataFrame, folder: str, order: list[str], file_size: str = FILE_SIZE, row_group_size: str = ROW_GROUP_SIZE, codec: str = "SNAPPY") -> None:
    """Writes each part below folder/part=N. Rows of a part come together, so a part is one file; it is bounded by file_size."""
    options = SinkOptions(codec=codec, row_group_bytes=bytes_of(row_group_size))
    parts = split_parts(df, order, bytes_of(file_size))
    parts.repartition("part").sortWithinPartitions(*order).write.partitionBy("part").options(**options.spark_options()).parquet(folder)

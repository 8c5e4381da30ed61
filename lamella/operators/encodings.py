"""What encodings make of a column in an order, as tables: deltas, lengths, shared prefixes and runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators.dictionary import bit_width
from lamella.plans.numbering import numbered, running, with_previous

BLOCK, MINIBLOCK = 128, 32


def placed(df: DataFrame, value: Column, order: list[str]) -> DataFrame:
    """position and value."""
    return numbered(df.select(*order, value.alias("value")), order).select("position", "value")


def delta_encode(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """position, value, delta (to the value before), block and miniblock of the delta. Values are widened to 64 bits; the
    first one has no delta and belongs to no block."""
    rows = with_previous(placed(df, F.col(value).cast("long"), order), "value")
    k = F.col("position") - 1
    inside = F.col("position") > 0
    return rows.select("position", "value", (F.col("value") - F.col("previous")).alias("delta"), F.when(inside, F.floor(k / BLOCK)).cast("long").alias("block"), F.when(inside, F.floor(k / MINIBLOCK)).cast("long").alias("miniblock"))


def delta_widths(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """block, miniblock, min_delta (of the block) and bits that each delta of the miniblock needs above it."""
    deltas = delta_encode(df, value, order).filter("block IS NOT NULL")
    small = deltas.groupBy("block", "miniblock").agg(F.min("delta").alias("lo"), F.max("delta").alias("hi"))
    low = small.groupBy("block").agg(F.min("lo").alias("min_delta"))
    return small.join(low, "block").select("block", "miniblock", "min_delta", bit_width(F.col("hi") - F.col("min_delta")).alias("bits"))


def delta_decode(deltas: DataFrame) -> DataFrame:
    """position and value from position, delta and, in the row of position 0, the first value."""
    step = F.when(F.col("position") == 0, F.col("value")).otherwise(F.col("delta"))
    return running(deltas.select("position", step.alias("step")), ["position"], {"decoded": F.col("step")}).select("position", F.col("decoded").alias("value"))


def delta_lengths(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """position, length (bytes) and delta of the lengths."""
    rows = placed(df, F.octet_length(F.col(value)).cast("long"), order)
    return with_previous(rows, "value").select("position", F.col("value").alias("length"), (F.col("value") - F.col("previous")).alias("delta"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many bytes two values begin with alike."""
    x, y = a.cast("binary"), b.cast("binary")
    n = F.least(F.octet_length(x), F.octet_length(y))
    alike = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0),
        lambda upto, i: F.when((upto == i - 1) & (F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))), i).otherwise(upto),
    )
    return F.coalesce(alike, F.lit(0))


def front_encode(df: DataFrame, value: str, order: list[str], page_rows: int = 0) -> DataFrame:
    """position, prefix (bytes shared with the value before) and suffix. With page_rows the first of each page shares nothing."""
    rows = with_previous(placed(df, F.col(value).cast("binary"), order), "value")
    first = F.col("previous").isNull() | (F.col("position") % page_rows == 0 if page_rows else F.lit(False))
    prefix = F.when(first, 0).otherwise(common_prefix(F.col("previous"), F.col("value")))
    return rows.withColumn("prefix", prefix).select("position", "prefix", F.expr("substring(value, prefix + 1)").alias("suffix"))


def front_decode(encoded: DataFrame, page_rows: int) -> DataFrame:
    """position and value (binary); pages, which begin with prefix 0, are decoded each by itself."""
    schema = pa.schema([("position", pa.int64()), ("value", pa.binary())])

    def run(page: pa.Table) -> pa.Table:
        page = page.sort_by("position")
        out, last = [], b""
        for prefix, suffix in zip(page["prefix"].to_pylist(), page["suffix"].to_pylist()):
            last = last[:prefix] + (suffix or b"")
            out.append(last)
        return pa.table({"position": page["position"], "value": out}, schema=schema)

    return encoded.withColumn("page", F.floor(F.col("position") / page_rows)).groupBy("page").applyInArrow(run, "position long, value binary")


def runs(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """run (from 0), value, start and length of the runs of equal values; nulls are equal to each other."""
    rows = with_previous(placed(df, F.col(value), order), "value")
    new = F.when((F.col("position") == 0) | ~F.col("value").eqNullSafe(F.col("previous")), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    numbers = running(rows.select("position", "value", new.alias("new")), ["position"], {"upto": F.col("new")})
    # a partition's share of a long run is combined before it moves
    return numbers.groupBy((F.col("upto") - 1).alias("run")).agg(F.first("value").alias("value"), F.min("position").alias("start"), F.count("*").alias("length"))


def hybrid_size(n: Column, bits: Column) -> Column:
    """Bytes of n values in bit-packed runs of a width, without headers: groups of eight take a byte for each bit."""
    return (F.ceil(n / 8) * bits).cast("long")

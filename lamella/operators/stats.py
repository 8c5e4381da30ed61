"""Statistics of columns: of a whole table, by page and by row group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.plans.numbering import numbered, running

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_WIDTH = {T.BooleanType: 0, T.ByteType: 4, T.ShortType: 4, T.IntegerType: 4, T.DateType: 4, T.FloatType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16}


def plain_size(name: str, kind: T.DataType) -> Column:
    """The bytes of a value without an encoding; a null has none."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c).cast("long"), F.lit(0).cast("long"))
    return F.when(c.isNotNull(), F.lit(_WIDTH.get(type(kind), 8)).cast("long")).otherwise(F.lit(0).cast("long"))


def comparable(name: str, kind: T.DataType) -> tuple[Column | None, Column | None]:
    """What minima and maxima are taken of: as a number, or as text (bytes as hex, which is in their order). NaN counts as absent; booleans, lists and maps have none."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c).cast("double"), None
    if isinstance(kind, NUMERIC):
        return c.cast("double"), None
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double"), None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double"), None
    if isinstance(kind, T.BinaryType):
        return None, F.hex(c)
    return None, c if isinstance(kind, T.StringType) else None


def whole(name: str, kind: T.DataType) -> Column | None:
    """What exact minima and maxima are taken of: integers, days and microseconds, which double rounds beyond 2^53."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return F.unix_micros(c.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else None


def _either(c: Column | None, kind: str) -> Column:
    return c if c is not None else F.lit(None).cast(kind)


def column_stats(df: DataFrame, columns: list[str] | None = None, distinct: str = "exact", longs: bool = False) -> DataFrame:
    """One row per column: column, num_values (nulls included), null_count, distinct_count, min_num, max_num, min_text,
    max_text, total_bytes. distinct: "exact", "approx" (a sketch of fixed size, for very large tables) or "none". longs: also min_long and max_long, exact
    where min_num and max_num, being doubles, round 64-bit integers and times.

    Exact counts are a scan and an aggregation for each column, that read this column alone and move its distinct values;
    counted all at once, every row would be sent once for each column with all the others in it."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    count = F.approx_count_distinct if distinct == "approx" else lambda c: F.lit(None).cast("long")
    aggs = []
    for k, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        number, text = comparable(f.name, f.dataType)
        aggs += [
            F.count("*").alias(f"values_{k}"), F.count(c).alias(f"present_{k}"), count(c).alias(f"distinct_{k}"), F.sum(plain_size(f.name, f.dataType)).alias(f"bytes_{k}"),
            F.min(_either(number, "double")).alias(f"lo_{k}"), F.max(_either(number, "double")).alias(f"hi_{k}"), F.min(_either(text, "string")).alias(f"first_{k}"), F.max(_either(text, "string")).alias(f"last_{k}"),
        ]
        if longs:
            aggs += [g(_either(whole(f.name, f.dataType), "long")).alias(f"{n}_{k}") for g, n in ((F.min, "least"), (F.max, "most"))]
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(f.name).alias("column"), F.col(f"values_{k}").alias("num_values"), (F.col(f"values_{k}") - F.col(f"present_{k}")).alias("null_count"), F.col(f"distinct_{k}").alias("distinct_count"), F.col(f"lo_{k}").alias("min_num"),
            F.col(f"hi_{k}").alias("max_num"), F.col(f"first_{k}").alias("min_text"), F.col(f"last_{k}").alias("max_text"), F.coalesce(F.col(f"bytes_{k}"), F.lit(0).cast("long")).alias("total_bytes"),
            *([F.col(f"least_{k}").alias("min_long"), F.col(f"most_{k}").alias("max_long")] if longs else []),
        )
        for k, f in enumerate(fields)
    ]
    out = one.select(F.inline(F.array(*rows)))
    if distinct != "exact":
        return out
    exact = reduce(DataFrame.unionByName, [df.agg(F.countDistinct(F.col(f"`{f.name}`")).alias("n")).select(F.lit(f.name).alias("name"), "n") for f in fields])
    joined = out.join(F.broadcast(exact), F.col("column") == F.col("name"))  # a row for each column
    return joined.select(*[F.col("n").alias(c) if c == "distinct_count" else F.col(c) for c in out.columns])


def page_stats(df: DataFrame, value: str, order: list[str], page_bytes: int = 1 << 20) -> DataFrame:
    """page, num_values, null_count, first and bytes for pages of a column in an order. A page is full when it reaches
    page_bytes: the value with which the running size passes a multiple is the last of its page."""
    size = plain_size(value, df.schema[value].dataType)
    placed = running(df.select(*order, F.col(value).alias("value"), size.alias("bytes")), order, {"upto": F.col("bytes")})
    page = F.floor((F.col("upto") - F.col("bytes")) / page_bytes).cast("long").alias("page")
    return placed.groupBy(page).agg(F.count("*").alias("num_values"), (F.count("*") - F.count("value")).alias("null_count"), F.sum("bytes").alias("bytes"))


def row_group_assign(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """df with row_group, in an order, of equally many rows each."""
    return numbered(df, order).withColumn("row_group", F.floor(F.col("position") / rows).cast("long")).drop("position")


def row_group_stats(df: DataFrame, columns: list[str], order: list[str], rows: int, longs: bool = False) -> DataFrame:
    """row_group, column, num_values, null_count, min_num and max_num for groups of rows in an order; min_text and max_text
    if one of the columns has text or bytes, and min_long and max_long if asked for, as column_stats has them."""
    grouped = row_group_assign(df.select(*dict.fromkeys([*order, *columns])), order, rows)
    kinds = [df.schema[c].dataType for c in columns]
    taken = {"num": ("double", lambda c, kind: comparable(c, kind)[0])}
    if any(isinstance(kind, (T.StringType, T.BinaryType)) for kind in kinds):
        taken["text"] = ("string", lambda c, kind: comparable(c, kind)[1])
    if longs:
        taken["long"] = ("long", whole)
    aggs, structs = [], []
    for k, (c, kind) in enumerate(zip(columns, kinds)):
        aggs += [F.count("*").alias(f"v{k}"), F.count(F.col(f"`{c}`")).alias(f"p{k}")]
        aggs += [g(_either(of(c, kind), out)).alias(f"{m}_{n}{k}") for n, (out, of) in taken.items() for m, g in (("min", F.min), ("max", F.max))]
        extremes = [F.col(f"{m}_{n}{k}").alias(f"{m}_{n}") for n in taken for m in ("min", "max")]
        structs.append(F.struct(F.lit(c).alias("column"), F.col(f"v{k}").alias("num_values"), (F.col(f"v{k}") - F.col(f"p{k}")).alias("null_count"), *extremes))
    return grouped.groupBy("row_group").agg(*aggs).select("row_group", F.inline(F.array(*structs)))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table and num_rows, from scans that read no column; all tables are counted in one aggregation."""
    one, zero = F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("n")
    spark = next(iter(tables.values())).sparkSession
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, tables))).alias("table"), zero)  # empty tables are counted too
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table"), one) for name, df in tables.items()], names)
    return rows.groupBy("table").agg(F.sum("n").alias("num_rows"))

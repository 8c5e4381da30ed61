"""Dictionaries of columns: distinct values in the order of their first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators.stats import plain_size
from lamella.plans.numbering import durable, numbered

#: A chunk of more distinct values is written without a dictionary.
MAX_ENTRIES = 32767


def bit_width(n: Column) -> Column:
    """The bits of a number; 0 for 0."""
    return F.when(n == 0, F.lit(0)).otherwise(F.length(F.bin(n.cast("long")))).cast("int")


def dictionary(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """value, first_position and index of the distinct values, nulls left out."""
    placed = numbered(df.select(*order, F.col(value).alias("value")), order)
    entries = placed.filter("value IS NOT NULL").groupBy("value").agg(F.min("position").alias("first_position"))
    return numbered(entries, ["first_position"], "index")


def dictionary_encode(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """position and index of each row in the order; a null has no index. A dictionary of at most MAX_ENTRIES is sent to the
    rows; for a larger one they are joined with it."""
    placed = numbered(df.select(*order, F.col(value).alias("value")), order)
    entries = placed.filter("value IS NOT NULL").groupBy("value").agg(F.min("position").alias("first_position"))
    indexed = durable(numbered(entries, ["first_position"], "index").select("value", "index"))
    if indexed.count() <= MAX_ENTRIES:
        indexed = F.broadcast(indexed)
    return placed.join(indexed, "value", "left").select("position", "index")


def dictionary_decode(encoded: DataFrame, entries: DataFrame) -> DataFrame:
    """position and value."""
    return encoded.join(entries.select("index", "value"), "index", "left").select("position", "value")


def dictionary_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: column, entries, eligible, index_bits, dictionary_bytes (distinct values and 4 for each present one) and plain_bytes."""
    out = []
    for c in columns:
        each = df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n")).filter("v IS NOT NULL")
        size = plain_size("v", df.schema[c].dataType)
        zero = F.lit(0).cast("long")
        one = each.agg(F.count("*").alias("entries"), F.coalesce(F.sum("n"), zero).alias("present"), F.coalesce(F.sum(size), zero).alias("distinct_bytes"), F.coalesce(F.sum(size * F.col("n")), zero).alias("plain_bytes"))
        boolean = df.schema[c].dataType.typeName() == "boolean"
        out.append(one.select(
            F.lit(c).alias("column"), "entries", ((F.col("entries") <= MAX_ENTRIES) & F.lit(not boolean)).alias("eligible"), bit_width(F.col("entries")).alias("index_bits"),
            (F.col("distinct_bytes") + 4 * F.col("present")).alias("dictionary_bytes"), "plain_bytes",
        ))
    from functools import reduce

    return reduce(DataFrame.unionByName, out)

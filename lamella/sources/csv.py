"""CSV files with typed columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.handlers import TYPES, handle, parse_hints
from lamella.schema.builder import SchemaBuilder, data_column
from lamella.schema.dsl import Schema
from lamella.sources.scan import read_csv
from lamella.sources.sinks import SinkOptions, write

ROW_GROUP = 100 << 20


def derive_schema(columns: list[str], hints: Mapping[str, str]) -> Schema:
    """All columns are optional, and strings unless there is a hint; hints for other columns don't matter."""
    out = SchemaBuilder("msg")
    for c in columns:
        physical, note, _ = TYPES[hints.get(c, "string")]
        out.column((c,), data_column(physical, "optional", note))
    return out.build()


def typed(df: DataFrame, hints: Mapping[str, str] | str = "") -> DataFrame:
    """A DataFrame of strings with its columns as hinted."""
    known = parse_hints(hints) if isinstance(hints, str) else hints
    return df.select(*[handle(F.col(f"`{c}`"), known.get(c, "string"), c).alias(c) for c in df.columns])


def read_typed_csv(spark: SparkSession, path: str, hints: Mapping[str, str] | str = "", delimiter: str = ",") -> DataFrame:
    """Records that are shorter or longer than the header fail the query."""
    return typed(read_csv(spark, path, delimiter), hints)


def csv_to_parquet(spark: SparkSession, source: str, target: str, hints: Mapping[str, str] | str = "", delimiter: str = ",", options: SinkOptions = SinkOptions(row_group_bytes=ROW_GROUP)) -> None:
    write(read_typed_csv(spark, source, hints, delimiter), target, options)

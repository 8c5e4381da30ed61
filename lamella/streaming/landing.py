"""Files that keep arriving in a folder, read as a stream under a declared schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lamella.functions.handlers import parse_hints
from lamella.schema.dsl import Schema
from lamella.schema.sparktypes import read_schema
from lamella.sources.csv import typed
from lamella.sources.sinks import SinkOptions


def parquet_stream(spark: SparkSession, folder: str, schema: Schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(read_schema(schema)).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def csv_stream(spark: SparkSession, folder: str, columns: list[str], hints: Mapping[str, str] | str = "", delimiter: str = ",") -> DataFrame:
    """Typed rows of CSV files with one header."""
    known = parse_hints(hints) if isinstance(hints, str) else hints
    text = spark.readStream.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("sep", delimiter).option("mode", "FAILFAST").option("nullValue", "\0").option("emptyValue", "").csv(folder)
    return typed(text, known)


def windowed_stats(stream: DataFrame, time: str, value: str, window: str = "1 hour", late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """num_values, null_count, min_value and max_value by window of event time; rows later than the watermark are left out."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    stats = out.agg(F.count("*").alias("num_values"), (F.count("*") - F.count(value)).alias("null_count"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return stats.select(F.col("window.start").alias("window_start"), *keys, "num_values", "null_count", "min_value", "max_value")


def write_stream(stream: DataFrame, target: str, checkpoint: str, options: SinkOptions = SinkOptions(), once: bool = True) -> StreamingQuery:
    """Appends to files, each row once; once: what there is now, and then it ends."""
    writer = stream.writeStream.format("parquet").outputMode("append").options(**options.spark_options()).option("checkpointLocation", checkpoint).option("path", target)
    return (writer.trigger(availableNow=True) if once else writer).start()

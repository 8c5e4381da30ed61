"""Writing files."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.schema.columns import split_path
from lamella.schema.dsl import Schema
from lamella.schema.sparktypes import to_struct_type

CODECS = {"UNCOMPRESSED": "none", "SNAPPY": "snappy", "GZIP": "gzip", "ZSTD": "zstd", "LZ4": "lz4", "LZ4_RAW": "lz4_raw"}


def codecs() -> list[str]:
    return sorted(CODECS)


def register_codec(name: str, spark_name: str) -> None:
    """Makes a codec known under a name: one of Spark's, or the class of a Hadoop codec on the class path."""
    CODECS[name.upper()] = spark_name


def codec(name: str) -> str:
    """Spark's name of a codec."""
    if name.upper() not in CODECS:
        raise ValueError(f"{name} isn't one of {', '.join(codecs())}")
    return CODECS[name.upper()]


@dataclass(frozen=True)
class SinkOptions:
    """row_group_bytes: of data before compression; 0: no limit. dictionary: a column's path to whether it may have one."""

    codec: str = "SNAPPY"
    row_group_bytes: int = 128 << 20
    row_group_rows: int = 0
    page_bytes: int = 1 << 20
    v2_pages: bool = False
    checksums: bool = False
    dictionary: Mapping[str, bool] = field(default_factory=dict)
    schema: Schema | None = None
    mode: str = "errorifexists"
    field_ids: bool = False

    def spark_options(self) -> dict[str, str]:
        out = {
            "compression": codec(self.codec), "parquet.block.size": str(self.row_group_bytes or (1 << 62)), "parquet.page.size": str(self.page_bytes),
            "parquet.writer.version": "PARQUET_2_0" if self.v2_pages else "PARQUET_1_0", "parquet.page.write-checksum.enabled": str(self.checksums).lower(),
        }
        if self.row_group_rows:
            out["parquet.block.row.count.limit"] = str(self.row_group_rows)
        return out | {f"parquet.enable.dictionary#{c}": str(b).lower() for c, b in self.dictionary.items()}


def conform(df: DataFrame, schema: Schema) -> DataFrame:
    """df with the columns, types and nullability of a schema: others are dropped, optional ones that lack are null, and
    a null in a required column fails the job that meets it."""
    want = to_struct_type(schema)
    have = set(df.columns)
    out = []
    for f in want.fields:
        value = F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name not in have and not f.nullable and f.metadata.get("pq.repetition") == "required":
            raise ValueError(f"there is no column {f.name}, which is required")
        if not f.nullable and f.name in have:
            value = F.coalesce(value, F.raise_error(F.lit(f"{f.name} is required")).cast(f.dataType))
        if f.nullable:  # a cast to a struct with a nullable field, which is all that declares this
            value = F.struct(value.alias("v")).cast(T.StructType([T.StructField("v", f.dataType, True)])).getField("v")
        out.append(value.alias(f.name, metadata=f.metadata))
    return df.select(*out)


def write(df: DataFrame, path: str, options: SinkOptions = SinkOptions()) -> None:
    """By Spark's own writer. Warns of V2 pages without compression: Spark 4.1's vectorised reader returns wrong bytes for
    strings in them that have no dictionary; spark.sql.parquet.enableVectorizedReader=false reads them right."""
    if options.v2_pages and codec(options.codec) == "none":
        warnings.warn("read these files with spark.sql.parquet.enableVectorizedReader=false", stacklevel=2)
    if options.schema is not None:
        df = conform(df, options.schema)
    df.write.mode(options.mode).options(**options.spark_options()).parquet(path)


def merge_metadata(everywhere: Mapping[str, str], of_column: Mapping[str, str]) -> dict[str, str]:
    """A column's pairs: those for all columns, and its own, which win."""
    return {**everywhere, **of_column}


def write_with_metadata(df: DataFrame, path: str, metadata: Mapping[str, str], options: SinkOptions = SinkOptions(), column_metadata: Mapping[str, Mapping[str, str]] | None = None, everywhere: Mapping[str, str] | None = None) -> DataFrame:
    """Writes files with key/value pairs in their footers, a file for each partition; returns file and num_rows.

    A column's pairs, by its dotted path, are kept in the field's metadata. Spark's writer has no place for pairs, so pyarrow writes here, batch
    by batch. A task that is repeated leaves a file of another name under _tmp, which isn't moved into place.
    """
    uri = path if "://" in path else f"file://{path}"
    kind = {"none": "none", "lz4_raw": "lz4"}.get(codec(options.codec), codec(options.codec))
    given = {split_path(c): pairs for c, pairs in (column_metadata or {}).items()}

    def marked_field(f: pa.Field, path: tuple[str, ...]) -> pa.Field:
        """f with the pairs of the column at path, and so for those within it; pairs for all columns are the leaves'."""
        if pa.types.is_struct(f.type):
            f = f.with_type(pa.struct([marked_field(f.type.field(k), (*path, f.type.field(k).name)) for k in range(f.type.num_fields)]))
        leaf = everywhere or {} if not pa.types.is_nested(f.type) else {}
        kept = {k.decode(): v.decode() for k, v in (f.metadata or {}).items()}
        return f.with_metadata({**kept, **merge_metadata(leaf, given.get(path, {}))} or None)


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inside = pafs.FileSystem.from_uri(uri)
        fs.create_dir(f"{inside}/_tmp")
        name, out, n = f"part-{uuid.uuid4().hex}.parquet", None, 0
        for batch in batches:
            if out is None:
                marked = pa.schema([marked_field(f, (f.name,)) for f in batch.schema], metadata=dict(metadata))
                out = pq.ParquetWriter(f"{inside}/_tmp/{name}", marked, filesystem=fs, compression=kind, data_page_size=options.page_bytes, data_page_version="2.0" if options.v2_pages else "1.0", write_page_checksum=options.checksums, use_dictionary=[c for c in batch.schema.names if options.dictionary.get(c, True)])
            out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, marked)], schema=marked), row_group_size=options.row_group_rows or None)
            n += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "num_rows": [n]}, schema=pa.schema([("file", pa.string()), ("num_rows", pa.int64())]))

    done = df.mapInArrow(run, "file string, num_rows long").collect()  # a row for each file
    fs, inside = pafs.FileSystem.from_uri(uri)
    for r in done:
        fs.move(f"{inside}/_tmp/{r['file']}", f"{inside}/{r['file']}")
    if fs.get_file_info(f"{inside}/_tmp").type == pafs.FileType.Directory:
        fs.delete_dir(f"{inside}/_tmp")
    return df.sparkSession.createDataFrame([(f"{uri}/{r['file']}", r["num_rows"]) for r in done], "file string, num_rows long")


def merge_files(df: DataFrame, path: str, options: SinkOptions = SinkOptions()) -> None:
    """All rows in one file: an extra, for small results."""
    write(df.coalesce(1), path, options)

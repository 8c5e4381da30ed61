"""Footers as tables: files, row groups, column chunks, key/value pairs and columns, one task a file, no data read.

register(spark) makes the Python data source "parquet_footer" known, whose option "view" chooses the table; the
functions here do that themselves.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamella.schema.columns import ColumnTree, join_path, split_path
from lamella.schema.dsl import Annotation, Node, Schema, render

VIEWS = {
    "files": "file string, size long, version string, created_by string, num_rows long, num_row_groups int, num_columns int, footer_size long, schema string",
    "row_groups": "file string, row_group int, first_row long, num_rows long, total_byte_size long, total_compressed_size long",
    "chunks": "file string, row_group int, column int, path string, physical string, codec string, encodings array<string>, num_values long, null_count long, distinct_count long, min string, max string, "
    "compressed_size long, uncompressed_size long, data_page_offset long, dictionary_page_offset long",
    "counts": "table string, num_rows long",
    "kv": "file string, key string, value string",
    "column_kv": "file string, column string, key string, value string",
    "columns": "file string, index int, path string, repetition string, physical string, length int, annotation string, field_id int, max_definition int, max_repetition int",
}


#: A line of the tree that a footer is printed as.
_LINE = re.compile(r"(required|optional|repeated) (?:(group)|(\w+)(?:\((\d+)\))?) field_id=(-?\d+) (.*?)(?: \((\w+)(?:\((.*)\))?\))?(?: \{|;)")


def _annotation(name: str | None, args: str | None) -> Annotation | None:
    if not name:
        return None
    given = dict(x.strip().split("=") for x in args.split(",")) if args else {}
    units = {"milliseconds": "MILLIS", "microseconds": "MICROS", "nanoseconds": "NANOS"}
    order = {"Time": ("timeUnit", "isAdjustedToUTC"), "Timestamp": ("timeUnit", "isAdjustedToUTC"), "Int": ("bitWidth", "isSigned"), "Decimal": ("precision", "scale")}.get(name, ())
    return Annotation(name.upper(), tuple(units.get(given[k], given[k]) for k in order))


def schema_of(meta: pq.FileMetaData) -> Schema:
    """The schema in a footer."""
    root, above = None, []
    for line in str(meta.schema).splitlines()[1:]:
        if line.strip() == "}":
            above.pop()
        elif m := _LINE.fullmatch(line.strip()):
            repetition, group, physical, length, number, name, note, args = m.groups()
            kind = "binary" if physical == "byte_array" else physical
            node = Node(name, repetition, None if group else kind, int(length) if length else None, _annotation(note, args), int(number) if int(number) >= 0 else None)
            if above:
                above[-1].children.append(node)
            root = root or node
            if group:
                above.append(node)
    return Schema(root)


def _text(x: object) -> str | None:
    if x is None:
        return None
    return x.hex() if isinstance(x, bytes) else str(x)


def field_metadata(fields: Iterable[pa.Field], above: tuple[str, ...] = ()) -> Iterator[tuple[str, dict[bytes, bytes]]]:
    """Dotted path and pairs of the fields that have some, those of structs, lists and maps included."""
    for f in fields:
        path = (*above, f.name)
        if pairs := {k: v for k, v in (f.metadata or {}).items() if k != b"PARQUET:field_id"}:
            yield join_path(path), pairs
        yield from field_metadata([f.type.field(k) for k in range(f.type.num_fields)], path)


def meta_of(name: str) -> pq.FileMetaData:
    fs, path = pafs.FileSystem.from_uri(name)
    return pq.read_metadata(path, filesystem=fs)


def _rows(view: str, name: str) -> Iterator[tuple]:
    fs, path = pafs.FileSystem.from_uri(name)
    meta = meta_of(name)
    if view == "files":
        yield name, fs.get_file_info(path).size, meta.format_version, meta.created_by, meta.num_rows, meta.num_row_groups, meta.num_columns, meta.serialized_size, render(schema_of(meta))
    elif view == "kv":
        for k, v in (meta.metadata or {}).items():
            yield name, k.decode("utf-8", "replace"), v.decode("utf-8", "replace")
    elif view == "column_kv":
        for path, pairs in field_metadata(meta.schema.to_arrow_schema()):
            for k, v in pairs.items():
                yield name, path, k.decode("utf-8", "replace"), v.decode("utf-8", "replace")
    elif view == "columns":
        for r in ColumnTree(schema_of(meta)).rows():
            yield name, *r.values()
    first = 0
    for g in range(meta.num_row_groups if view in ("row_groups", "chunks") else 0):
        group = meta.row_group(g)
        chunks = [group.column(c) for c in range(group.num_columns)]
        if view == "row_groups":
            yield name, g, first, group.num_rows, group.total_byte_size, sum(c.total_compressed_size for c in chunks)
            first += group.num_rows
            continue
        for k, c in enumerate(chunks):
            s = c.statistics
            yield (
                name, g, k, c.path_in_schema, c.physical_type.lower(), c.compression, list(c.encodings), c.num_values, s.null_count if s and s.has_null_count else None, s.distinct_count if s and s.has_distinct_count else None,
                _text(s.min) if s and s.has_min_max else None, _text(s.max) if s and s.has_min_max else None, c.total_compressed_size, c.total_uncompressed_size, c.data_page_offset, c.dictionary_page_offset if c.has_dictionary_page else None,
            )


class _Files(InputPartition):
    """Files, each with the name of the table that it is of, if tables were named."""

    def __init__(self, names: list[tuple[str | None, str]]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, view: str, files: list[tuple[str | None, str]]) -> None:
        self.view, self.files = view, files

    def partitions(self) -> list[InputPartition]:
        n = max(1, len(self.files) // 4096)  # some thousands of tasks at most
        return [_Files(self.files[k : k + n]) for k in range(0, len(self.files), n)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for table, name in partition.names:
            yield from ([(table, meta_of(name).num_rows)] if self.view == "counts" else _rows(self.view, name))


class FooterSource(DataSource):
    """spark.read.format("parquet_footer").option("view", "row_groups").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "parquet_footer"

    def schema(self) -> str:
        view = self.options.get("view", "files")
        if view not in VIEWS:
            raise ValueError(f"view is one of {', '.join(VIEWS)}")
        return VIEWS[view]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001 - called by keyword
        tables = json.loads(self.options["tables"]) if "tables" in self.options else {None: self.options["path"]}
        return _Reader(self.options.get("view", "files"), [(table, file) for table, path in tables.items() for file in list_files(path)])


def list_files(path: str) -> list[str]:
    """The data files at a path: itself, or those below it that aren't hidden."""
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    fs, inside = pafs.FileSystem.from_uri(uri)
    scheme = uri[: uri.index(inside)] if inside in uri else "file://"
    if fs.get_file_info(inside).type == pafs.FileType.File:
        return [uri]
    found = fs.get_file_info(pafs.FileSelector(inside, recursive=True))
    return sorted(f"{scheme}{f.path}" for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FooterSource)


def footer(spark: SparkSession, path: str, view: str = "files") -> DataFrame:
    register(spark)
    return spark.read.format("parquet_footer").option("view", view).load(path)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    return footer(spark, path, "row_groups")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return footer(spark, path, "chunks")


def columns(spark: SparkSession, path: str) -> DataFrame:
    return footer(spark, path, "columns")


def kv_metadata(spark: SparkSession, path: str) -> DataFrame:
    """file and metadata, a map of the file's pairs; a file without pairs has no row."""
    return footer(spark, path, "kv").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def column_metadata(spark: SparkSession, path: str, column: str) -> DataFrame:
    """file and metadata, the pairs of the column at a dotted path; a file in which it has none has no row. A column that isn't there raises."""
    if ColumnTree(file_schema(path)).find(column) is None:
        raise ValueError(f"there is no column {column}")
    pairs = footer(spark, path, "column_kv").filter(F.col("column") == join_path(split_path(column)))
    return pairs.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def row_count(spark: SparkSession, path: str) -> int:
    """From the footers alone."""
    return int(footer(spark, path).agg(F.coalesce(F.sum("num_rows"), F.lit(0))).first()[0])


def row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table and num_rows for some tables, from their footers alone."""
    register(spark)
    found = spark.read.format("parquet_footer").option("view", "counts").option("tables", json.dumps(paths)).load()
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, paths))).alias("table"), F.lit(0).cast("long").alias("num_rows"))  # tables without files are counted too
    return found.unionByName(names).groupBy("table").agg(F.sum("num_rows").alias("num_rows"))


def file_schema(path: str) -> Schema:
    """The schema of one file (of the first, in a folder)."""
    fs, inside = pafs.FileSystem.from_uri(list_files(path)[0])
    return schema_of(pq.read_metadata(inside, filesystem=fs))

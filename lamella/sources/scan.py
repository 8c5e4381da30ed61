"""Projected scans, and parts of files by row group."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lamella.schema.columns import ColumnTree, join_path, split_path
from lamella.schema.dsl import Node, Schema
from lamella.schema.sparktypes import read_schema
from lamella.sources import footer

#: Rows of a row group that a task holds at a time.
BATCH_ROWS = 1 << 14
#: Bytes of neighbouring row groups of a file that one task reads.
TASK_BYTES = 32 << 20


@dataclasses.dataclass(frozen=True)
class ScanOptions:
    """columns: dotted paths (back-ticks quote parts with dots); those that aren't in the file are passed over, unless strict.
    schema: instead of inference. verify_checksums: pages' CRCs. row_groups and skip_row_groups: numbers from 0, in each file, or
    through_files: the files in the order of their names, as if they were one."""

    columns: tuple[str, ...] = ()
    schema: Schema | None = None
    verify_checksums: bool = False
    row_groups: tuple[int, ...] | None = None
    skip_row_groups: tuple[int, ...] = ()
    strict: bool = False
    nanos_as_long: bool = False
    through_files: bool = False


def pruned(schema: Schema, columns: Iterable[str]) -> Schema:
    """The schema with the leaves that are, or lie under, one of the paths; a map keeps its key."""
    tree = ColumnTree(schema)
    kept = {c.path for c in tree.selected([split_path(c) for c in columns])}

    def cut(node: Node, path: tuple[str, ...]) -> Node | None:
        if not node.is_group:
            return node if path in kept else None
        children = [c for c in (cut(c, (*path, c.name)) for c in node.children) if c is not None]
        if not children:
            return None
        if node.repetition == "repeated" and node.child("key") is not None and not any(c.name == "key" for c in children) and node.name in ("key_value", "map"):
            children.insert(0, node.child("key"))
        return dataclasses.replace(node, children=children)

    found = [c for c in (cut(c, (c.name,)) for c in schema.root.children) if c is not None]
    return Schema(dataclasses.replace(schema.root, children=found))


def _inside_repeated(schema: Schema, path: tuple[str, ...]) -> bool:
    """Whether a path ends below the top of a list, a map or another repeated group."""
    node = schema.root
    for name in path[:-1]:
        node = node.child(name)
        if node is None:
            return False
        if node.repetition == "repeated" or node.annotated("LIST", "MAP", "MAP_KEY_VALUE"):
            return True
    return False


def _project(df: DataFrame, tree: ColumnTree, columns: Iterable[str], strict: bool) -> DataFrame:
    """The chosen paths; struct fields that aren't chosen are pruned from the scan."""
    wanted: dict[str, set[tuple[str, ...]]] = {}
    for text in columns:
        path = split_path(text)
        if not tree.selected([path]):
            if strict:
                raise ValueError(f"there is no column {text}")
            continue
        wanted.setdefault(path[0], set()).add(path)

    def pick(column: F.Column, node, depth: int, paths: set[tuple[str, ...]]):  # noqa: ANN202
        if any(len(p) <= depth for p in paths) or not node.is_group or node.annotation is not None or node.repetition == "repeated":
            return column
        inner = []
        for c in node.children:
            below = {p for p in paths if p[depth] == c.name}
            if below:
                inner.append(pick(column.getField(c.name), c, depth + 1, below).alias(c.name))
        value = F.struct(*inner)
        return F.when(column.isNotNull(), value) if node.repetition == "optional" else value

    return df.select(*[pick(F.col(f"`{c.name}`"), c, 1, wanted[c.name]).alias(c.name) for c in tree.schema.root.children if c.name in wanted])


def scan(spark: SparkSession, path: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """A DataFrame over files. Without columns, all of them."""
    if options.row_groups is not None or options.skip_row_groups:
        df = _of_row_groups(spark, path, options, [split_path(c)[0] for c in options.columns] or None)
        return _project(df, ColumnTree(options.schema or footer.file_schema(path)), options.columns, options.strict) if options.columns else df
    reader = spark.read
    if options.verify_checksums:
        reader = reader.option("parquet.page.verify-checksum.enabled", "true")
    schema = options.schema
    if schema is not None:
        reader = reader.schema(read_schema(schema))
    df = reader.parquet(path)
    if options.columns:
        tree = ColumnTree(schema or footer.file_schema(path))
        if any(_inside_repeated(tree.schema, split_path(c)) for c in options.columns):  # fields of lists' and maps' elements are left out by the schema
            if options.strict and (lost := [c for c in options.columns if not tree.selected([split_path(c)])]):
                raise ValueError(f"there is no column {lost[0]}")
            return reader.schema(read_schema(pruned(tree.schema, options.columns))).parquet(path)
        df = _project(df, tree, options.columns, options.strict)
    return df


def _of_row_groups(spark: SparkSession, path: str, options: ScanOptions, names: list[str] | None) -> DataFrame:
    """The rows of the chosen row groups: a row for each of those, from the footers, is dealt out to tasks, which read their
    groups and no others, and of these only the columns named, in batches."""
    groups, number, keep = footer.row_groups(spark, path), F.col("row_group"), F.lit(True)
    if options.through_files:
        earlier = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
        files = groups.groupBy(F.col("file").alias("of")).agg(F.count("*").alias("n")).select("of", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        groups, number = groups.join(F.broadcast(files), F.col("file") == F.col("of")), number + F.col("before")
    if options.row_groups is not None:
        keep = number.isin(list(options.row_groups))
    if options.skip_row_groups:
        keep = keep & ~number.isin(list(options.skip_row_groups))
    reader = spark.read.schema(read_schema(options.schema)) if options.schema is not None else spark.read
    whole = reader.parquet(path).schema
    struct = T.StructType([f for f in whole.fields if names is None or f.name in names])
    kind, checked = to_arrow_schema(struct), options.verify_checksums

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None
        for batch in batches:
            for name, group in zip(batch["file"].to_pylist(), batch["row_group"].to_pylist()):
                if name != opened:  # a footer of many groups takes longer to read than a group
                    fs, inside = pafs.FileSystem.from_uri(name)
                    file, opened = pq.ParquetFile(inside, filesystem=fs, page_checksum_verification=checked), name
                    there = [n for n in kind.names if n in file.schema_arrow.names]
                for part in file.iter_batches(BATCH_ROWS, row_groups=[group], columns=there):
                    table = pa.Table.from_batches([part])
                    columns = [table[f.name].cast(f.type, safe=False) if f.name in there else pa.nulls(part.num_rows, f.type) for f in kind]
                    yield from pa.Table.from_arrays(columns, schema=kind).to_batches()

    run = F.floor(F.col("row_group") * F.col("total_byte_size") / TASK_BYTES).alias("run")  # about the place in the file
    chosen = groups.filter(keep).select("file", "row_group", run)
    # a fixed number of tasks: rows that name groups are small, and adaptive execution would read all of them in one task
    spread = chosen.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "run").sortWithinPartitions("file", "row_group")
    return spread.mapInArrow(read, struct)


def seek(spark: SparkSession, path: str, row_group: int, columns: tuple[str, ...] = (), through_files: bool = False) -> DataFrame:
    """The rows from a row group (from 0) on, in every file, or through_files; the groups before it aren't read."""
    return scan(spark, path, ScanOptions(columns=columns, skip_row_groups=tuple(range(row_group)), through_files=through_files))


def head(df: DataFrame, n: int = 5, order: Iterable[str] = ()) -> DataFrame:
    """The first n rows, of a plain scan in the order of its files; -1: all of them."""
    if n < 0:
        return df
    keys = list(order)
    if keys:
        return df.orderBy(*keys).limit(n)
    try:
        placed = df.orderBy("_metadata.file_path", "_metadata.row_index").limit(n)
        placed.schema  # noqa: B018 - the columns are resolved here
        return placed
    except Exception:  # noqa: BLE001 - not a scan
        return df.limit(n)


def rows(df: DataFrame) -> Iterator:
    """One row after another, a partition at a time in the driver."""
    return df.toLocalIterator(prefetchPartitions=True)


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as strings, by the names in the first record; empty fields are empty strings."""
    return spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"').option("nullValue", "\0").option("emptyValue", "").option("mode", "FAILFAST").option("inferSchema", False).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: Schema | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(read_schema(schema)) if schema else reader).json(path)


def path_text(path: Iterable[str]) -> str:
    return join_path(path)

"""What the operators of this package share: scratch tables, and views of a table under private names.

Every operator first selects the columns that it needs under names of its own, so further columns of the
caller may have any name. Intermediate tables go to the folder in ``spark.checkpoint.dir`` that all executors
share; a lost executor then costs a retry of its tasks and nothing else.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_made: dict[str, set[str]] = {}
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scope = threading.local()
_writing, _writers = threading.Lock(), {}

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset, a local master (tests) has a temporary folder;
    executors on other machines couldn't read one, so there is none for them."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = getattr(scratch_dir, "own", None)
        if base is None:
            base = scratch_dir.own = "file://" + tempfile.mkdtemp(prefix="lamella-")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/lamella-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(folder)
    if getattr(_scope, "made", None) is not None:
        _scope.made.append((spark, folder))
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.get(spark.sparkContext.applicationId, set()).discard(folder)


def discard(table: DataFrame) -> None:
    """Deletes the scratch table behind what stored() returned; nothing may read it any more."""
    folder = _tables.pop(table, None)
    if folder:
        _delete(table.sparkSession, folder)


@contextmanager
def scratch(keep: list[DataFrame]) -> Iterator[None]:
    """Deletes the scratch tables that were made inside it when it ends, but for those whose DataFrames are put into keep."""
    outer, made = getattr(_scope, "made", None), []
    _scope.made = made
    try:
        yield
    finally:
        _scope.made = outer
        kept = {_tables.get(table) for table in keep}
        for spark, folder in made:
            if folder not in kept:
                _delete(spark, folder)
            elif outer is not None:
                outer.append((spark, folder))


def release(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application: to be called when the results that read them are written."""
    for folder in list(_made.get(spark.sparkContext.applicationId, ())):
        _delete(spark, folder)


def stored(df: DataFrame, name: str = "table", codec: str = "zstd") -> DataFrame:
    """Writes df to a scratch table and reads it back: its lineage ends there, and its size is known to the planner.

    The shuffle files of the job that wrote it are of no use any more and go at once, not when the driver's JVM happens
    to collect its garbage."""
    spark = df.sparkSession
    folder = scratch_dir(spark)
    with _writing:
        if not _writers:
            _writers["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writers["n"] = _writers.get("n", 0) + 1
    try:
        df.write.option("compression", codec).parquet(f"{folder}/{name}")
    finally:
        with _writing:
            _writers["n"] -= 1
            if not _writers["n"]:  # the last of several threads
                spark.conf.set(CLEANUP, _writers["before"])
                _writers.clear()
    table = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    _tables[table] = folder
    return table


#: What may stand between a scan of files and its rows, one for one or fewer, in the files' order.
_NARROW = {"Project", "Filter", "SubqueryAlias", "View"}


def is_scan(df: DataFrame) -> bool:
    """Whether df reads files as they lie: each split of a file once, its rows together and in order."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in _NARROW:
        plan = plan.children().head()
    relation = plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation()
    return bool(relation) and relation.getClass().getSimpleName() == "HadoopFsRelation"


def pin_splits(spark: SparkSession) -> None:
    """Later scans of the session cut files as one would now. Spark looks the number of cores up each time, and when an
    executor was lost between two scans of small files, their splits would differ."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def located(df: DataFrame, columns: list[Column], split: str, at: str) -> DataFrame:
    """The columns (of df), the file of each row and where its split begins in it. What isn't a scan of files is written
    to a scratch table first: partitions have no number that is the same in two jobs."""
    if not is_scan(df):
        df = stored(df.select(*columns), "rows")
        columns = [F.col(f"`{c}`") for c in df.columns]
    pin_splits(df.sparkSession)
    place = df.metadataColumn("_metadata")
    return df.select(*columns, place["file_path"].alias(split), place["file_block_start"].alias(at))


def place_key(*columns: Column | str) -> list[Column]:
    """key and check: 128 bits in the place of the columns that say where a row lies, the names of files among them."""
    return [F.xxhash64(*columns).alias("key"), F.xxhash64(F.lit("check"), *columns).alias("check")]


#: A key of more rows than this is answered from a broadcast table, that of the HOT_KEYS largest at most.
HOT, HOT_KEYS = 1 << 20, 1 << 17


def looked_up(rows: DataFrame, table: DataFrame, by: str, n: str, apart: str, hot: int | None = HOT) -> DataFrame:
    """rows inner-joined with a written table on the column by, unique in table, whose column n says how many rows have the
    key. hot: None where no key can have very many. Rows of the largest keys needn't meet: these keys are sent to every task, at most HOT_KEYS of them, so that no other key has
    more than hot rows or a HOT_KEYS-th of all; in the join of the others their rows are spread by the column apart."""
    rest = [c for c in table.columns if c != by]
    if hot is None or table.filter(F.col(n) > hot).limit(1).count() == 0:
        return rows.join(table, by)
    sent = table.filter(F.col(n) > hot).orderBy(F.desc(n)).limit(HOT_KEYS).select(by, *[F.col(c).alias(f"hot_{c}") for c in rest])
    known = F.col(f"hot_{n}").isNotNull()
    spread = rows.join(F.broadcast(sent), by, "left").withColumn("apart_", F.when(known, F.col(apart)).otherwise(F.lit(-1)).cast("long"))
    both = spread.join(table.withColumn("apart_", F.lit(-1).cast("long")), [by, "apart_"], "left")
    both = both.withColumns({c: F.when(known, F.col(f"hot_{c}")).otherwise(F.col(c)) for c in rest}).filter(F.col(n).isNotNull())
    return both.select(*rows.columns, *rest)


def parallelism(df: DataFrame) -> int:
    """spark.sql.shuffle.partitions, which is set to the size of the job."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def view(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under private names."""
    return df.select(*[df[f"`{of}`"].alias(name) for name, of in columns.items()])


def extended(df: DataFrame, columns: dict[str, str]) -> StructType:
    """The schema of df and further columns."""
    out = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out.add(name, kind)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def utf8(column: pa.Array) -> list[bytes]:
    """The strings as UTF-8; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows, so that a task holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def record_batch(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)

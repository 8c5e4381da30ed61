"""Token counts by a separator scan over flat token files.

A token file is nothing but 16-bit ids, each document's followed by the end-of-document id; no index says where
documents lie. Fixed blocks of all files are searched in parallel for the end id, vectorised. A block states how
many ends it holds and where; a prefix scan over the blocks (within groups of blocks, then over the groups) gives
each block the number of ends before it and the place of the last one, so that a document that spans blocks is
counted whole and every document has its ordinal in the file. Texts of any length are tokenised whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import parallelism, record_batch, scratch_dir, slices, stored, view
from lamella.llm.tokens import Encoder, default_vocabulary

END_ID = 50256
BLOCK_BYTES = 8 << 20
FILE_BYTES = 256 << 20
GROUP = 4096

_WRITTEN = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])
_SCAN = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("n_ends", pa.int64()), ("last_end", pa.int64()), ("ends", pa.binary())])
_COUNTS = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("n_tokens", pa.int64()), ("closed", pa.bool_())])


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token files below folder; returns a row per document: file, ordinal, doc_id.

    Null text has no ids but its end. Strings of special tokens in a text are ordinary text, so that the end id
    comes from ends only. A task that is repeated writes files of other names, and only those of the attempt whose
    rows were committed are named in the result.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.at(vocabulary, True), np.array([end_id], "<u2").tobytes()
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path)
        out, ids, size, name = None, [], 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            return record_batch(_WRITTEN, {"file": [f"{folder}/{name}"] * len(ids), "ordinal": list(range(len(ids))), "doc_id": ids})

        for batch in slices(batches, 512):
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                if out is None:
                    name = f"{uuid.uuid4().hex}.u16"
                    out, ids, size = fs.open_output_stream(f"{path}/{name}"), [], 0
                data = encoder.encode(text or "").tobytes() + end
                out.write(data)
                ids.append(i)
                size += len(data)
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = view(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return stored(rows.mapInArrow(run, "file string, ordinal long, doc_id long"), "written")


def _blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    """file, block, first byte, bytes; files: file. Sizes are looked up where the files' tasks run."""
    schema = pa.schema([("file", pa.string()), ("size", pa.int64())])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["file"].to_pylist()
            found = []
            for n in names:
                fs, path = pafs.FileSystem.from_uri(n)
                found.append(fs.get_file_info(path).size)
                if found[-1] is None or found[-1] % 2:
                    raise ValueError(f"{n} isn't a file of 16-bit ids")
            yield record_batch(schema, {"file": names, "size": found})

    sized = files.mapInArrow(sizes, "file string, size long").filter("size > 0")
    last = F.floor((F.col("size") - 1) / block_bytes)
    return sized.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).select("file", "block", (F.col("block") * block_bytes).alias("first"), F.least(F.lit(block_bytes).cast("long"), F.col("size") - F.col("block") * block_bytes).alias("bytes"))


def scan_token_files(files: DataFrame, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of the files (a DataFrame with the column file): file, ordinal, n_tokens (without the
    end), closed. Tokens after the last end of a file are a document with closed false; an empty file has none."""
    if block_bytes % 2:
        raise ValueError("block_bytes is odd")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, first, n in zip(*(batch[c].to_pylist() for c in ("file", "block", "first", "bytes"))):
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(path) as f:
                    f.seek(first)
                    ids = np.frombuffer(f.read(n), "<u2")
                ends = np.flatnonzero(ids == end_id).astype("<i4")
                at = first // 2
                yield record_batch(_SCAN, {"file": [name], "block": [block], "first": [at], "n_tokens": [len(ids)], "n_ends": [len(ends)], "last_end": [at + int(ends[-1]) if len(ends) else None], "ends": [ends.tobytes()]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, n, base, last, is_last, raw in zip(*(batch[c].to_pylist() for c in ("file", "first", "n_tokens", "base", "last", "is_last", "ends"))):
                ends = np.frombuffer(raw, "<i4").astype(np.int64) + first
                counts = np.diff(np.concatenate([[last], ends])) - 1
                open_tail = first + n - 1 - (int(ends[-1]) if len(ends) else last)
                closed = [True] * len(counts)
                if is_last and open_tail:
                    counts, closed = np.append(counts, open_tail), [*closed, False]
                yield record_batch(_COUNTS, {"file": [name] * len(counts), "ordinal": list(range(base, base + len(counts))), "n_tokens": counts.tolist(), "closed": closed})

    # a fixed number of tasks: rows that name blocks are small, and adaptive execution would read all blocks in one task
    spread = _blocks(files, block_bytes).repartition(parallelism(files))
    found = stored(spread.mapInArrow(scan, "file string, block long, first long, n_tokens long, n_ends long, last_end long, ends binary"), "ends")
    brief = found.select("file", "block", F.floor(F.col("block") / GROUP).alias("g"), "n_ends", "last_end")
    before = (Window.unboundedPreceding, -1)
    groups = brief.groupBy("file", "g").agg(F.sum("n_ends").alias("gn"), F.max("last_end").alias("gl"))
    over_groups = Window.partitionBy("file").orderBy("g")
    groups = groups.select("file", "g", F.sum("gn").over(over_groups.rowsBetween(*before)).alias("gn"), F.max("gl").over(over_groups.rowsBetween(*before)).alias("gl"), (F.lead("g").over(over_groups).isNull()).alias("last_group"))
    inside = Window.partitionBy("file", "g").orderBy("block")
    bases = brief.select(
        "file", "block", "g",
        F.coalesce(F.sum("n_ends").over(inside.rowsBetween(*before)), F.lit(0)).alias("n"),
        F.max("last_end").over(inside.rowsBetween(*before)).alias("l"),
        F.lead("block").over(inside).isNull().alias("last_of_group"),
    ).join(groups, ["file", "g"]).select(
        "file", "block", (F.col("n") + F.coalesce("gn", F.lit(0))).alias("base"),
        F.coalesce("l", "gl", F.lit(-1)).alias("last"), (F.col("last_group") & F.col("last_of_group")).alias("is_last"),
    )
    return found.select("file", "block", "first", "n_tokens", "ends").join(bases, ["file", "block"]).mapInArrow(count, "file string, ordinal long, n_tokens long, closed boolean")


def list_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The .u16 files of a folder, as scan_token_files takes them."""
    fs, path = pafs.FileSystem.from_uri(folder)
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    names = [(f"{scheme}{x.path}",) for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".u16")]
    return spark.createDataFrame(names, "file string")


def token_counts(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as token files, scans those, and returns a row per document: doc_id, n_tokens. Null text has 0
    tokens; ids may be null or repeated, each row is a document of its own. An empty table gives no rows."""
    folder = f"{scratch_dir(docs.sparkSession)}/tokens"
    written = write_token_files(docs, folder, vocabulary, end_id, id_col, text_col)
    counts = scan_token_files(written.select("file").distinct(), end_id, block_bytes)
    return written.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""A corpus from documents to packed sequences: what is of low quality goes, then repeated lines, then similar
documents; what is left is mixed by source and packed in that order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.llm.common import discard, scratch, stored
from lamella.llm.line_dedup import line_dedup
from lamella.llm.mixing import mix
from lamella.llm.ngram_join import drop_similar
from lamella.llm.packing import pack
from lamella.llm.quality_rules import quality_filter

#: What line dedup leaves fewer words of than this was made of lines of earlier documents, and goes.
MIN_WORDS = 5
#: Each takes the session, what its predecessor kept, and the folder of the tables; all but the last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", lambda spark, docs, sf_dir: quality_filter(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: line_dedup(docs, min_words=MIN_WORDS)),
    ("ngram_join", lambda spark, docs, sf_dir: drop_similar(docs)),
    ("mixing", lambda spark, docs, sf_dir: mix(docs)),
    ("packing", lambda spark, docs, sf_dir: pack(docs)),
]

#: The order of the mixture and the tokens of the packing aren't for SQL; tests/llm compares run() with a plain program.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with scratch(kept):
            kept.append(stored(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)

"""Folders for tables that a plan writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def base_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local master (tests) has a temporary folder; executors on other
    machines couldn't read one, so there is none for them."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if getattr(base_folder, "own", None) is None:
        base_folder.own = "file://" + tempfile.mkdtemp(prefix="lamella-")
    return base_folder.own


def scratch_folder(spark: SparkSession, name: str) -> str:
    return f"{base_folder(spark)}/lamella-{uuid.uuid4().hex}/{name}"

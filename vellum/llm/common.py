"""Helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space as the contracts define it: U+0020 and U+0009 to U+000D.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE = " \t\n\u000b\u000c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null: empty) and the named columns, whatever else the table has."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    while stem in {c.lower() for c in df.columns}:
        stem += "_"
    return stem


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the folder that the driver and all executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-vellum-")
    return f"{base.rstrip('/')}/vellum-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that is no longer used back to the system: Python workers live on from task to task, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give it back by themselves
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(name: str = "doc_id"):
    """crc32 of doc_id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))

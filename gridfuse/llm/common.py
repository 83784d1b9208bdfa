"""Shared folders, tables that cut lineage, and small helpers of the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a new local one, for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridfuse-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Writes `df` as a table in the shared folder and reads it back: computed once, and no task depends on an executor's memory."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table written by `cut` that nothing will read again."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """pyarrow file system and path of a URI (file, hdfs, s3 and so on), for use inside tasks."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def as_table(documents: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones cannot matter."""
    return documents.select(*[F.col(f"`{c}`") for c in columns])


def unsigned_hex(value: Column) -> Column:
    """16 lower-case hexadecimal digits of a long's 64 bits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null gives empty."""
    return [v or b"" for v in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str, *others: str, size: int = 1_000_000) -> Iterator[tuple]:
    """Each batch in runs of rows of about `size` bytes of text: (values of the other columns..., texts as UTF-8).

    Bounds the memory of numpy work; a longer text is a run of its own, whole.
    """
    for batch in batches:
        values = texts(batch.column(text))
        rest = [batch.column(c).to_pylist() for c in others]
        begin = held = 0
        for i, v in enumerate(values):
            if held and held + len(v) > size:
                yield (*(r[begin:i] for r in rest), values[begin:i])
                begin, held = i, 0
            held += len(v) + 1
        if values:
            yield (*(r[begin:] for r in rest), values[begin:])


def tasks(manifest: DataFrame, most: int = 10_000) -> int:
    """A task for each file of a manifest: its rows are few bytes, its files are not."""
    return max(1, min(most, manifest.count()))


def task_number() -> str:
    """A name that no other attempt of any task has."""
    return f"{os.getpid():x}-{uuid.uuid4().hex[:12]}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

"""Stored files as rows: names, sizes, and digests that are worked out block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 8 << 20
#: Kinds of store that executors can open by themselves; Spark's names and Arrow's.
STREAMED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def listed(spark: SparkSession, folders: list[str], glob: str = "*.parquet") -> DataFrame:
    """(path, size) of the files below the folders; their content isn't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folders)
    return rows.select("path", F.col("length").alias("size"))


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and its name there; a path without a scheme is local."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(f"{STREAMED[scheme]}:{rest}")


def readable(path: str) -> bool:
    """Whether tasks can open the path by themselves; other stores are read by Spark only."""
    scheme, colon, _ = path.partition(":")
    return not colon or scheme in STREAMED


def read_range(path: str, start: int, stop: int) -> bytes:
    """The bytes [start, stop) of a file, or those there are."""
    store, name = store_of(path)
    with store.open_input_file(name) as f:
        f.seek(start)
        return f.read(max(0, stop - start))


def digest(path: str, block: int = BLOCK) -> str:
    """SHA-256 of a file, read ``block`` bytes at a time."""
    found = hashlib.sha256()
    store, name = store_of(path)
    with store.open_input_stream(name) as stream:
        while part := stream.read(block):
            found.update(part)
    return found.hexdigest()


def with_digest(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """``files(path, size)`` with ``sha256``. Each file is streamed by one executor in blocks, whatever its size; files are dealt over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([digest(p, block) for p in batch.column(0).to_pylist()], pa.string())], ["path", "size", "sha256"])

    return files.select("path", "size").repartition("path").mapInArrow(run, "path string, size long, sha256 string")

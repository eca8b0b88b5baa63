"""A table kept where every executor can read it, so that dear work is done once and survives a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a single machine a temporary folder where that is unset, on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandweave-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


#: The innermost open block of this thread or task; blocks of others don't own what is stored here.
_block: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside this block are deleted at its end, so what is built from them must be written in it."""
    mine: list[str] = []
    token = _block.set(mine)
    try:
        yield
    finally:
        _block.reset(token)
        for name in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, owned by the innermost ``scratch`` block if there is one."""
    path = f"{shared_folder(spark)}/strandweave/{uuid.uuid4().hex}"
    if (mine := _block.get()) is not None:
        mine.append(path)
    return path


def stored(frame: DataFrame) -> DataFrame:
    """Write ``frame`` as Parquet in the shared folder and read it back."""
    spark = frame.sparkSession
    path = shared_path(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Bytes that are dealt anew without a thought.
SMALL = 1 << 30


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` over all cores where it stands in a few files with few partitions (one large row group can't be split, say).

    Only inputs of ``SMALL`` bytes at most, by the optimizer's estimate, are dealt anew; larger
    ones stay where they are, without a shuffle, however many cores there are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    few = frame.rdd.getNumPartitions() < 2 * cores and len(frame.inputFiles()) < max(2, cores // 2)
    small = few and int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL
    return frame.repartition(2 * cores) if small else frame

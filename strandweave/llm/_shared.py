"""Tables that must outlive an executor go to the folder every node sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators._store import shared_folder, spread, stored

#: A word is a run of anything but ASCII white space (fixed by the query contracts).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset a temporary folder on a single machine and an error on a cluster."""
    return shared_folder(spark)


def keep(frame: DataFrame) -> DataFrame:
    """Write ``frame`` as Parquet in the shared folder and read it back: lineage is cut, executors may go."""
    return stored(frame)


def within(sample: DataFrame, rows: int) -> DataFrame:
    """``sample(text, ...)`` of distinct texts, kept before; the ``rows`` of smallest text hash if there are more. Only hashes are sorted."""
    if sample.count() <= rows:
        return sample
    h = F.xxhash64("text")
    last = sample.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return sample.where(h <= last)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")

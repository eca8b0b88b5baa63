"""Whole groups from sorted Arrow streams: one task call for many small groups instead of one each."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, in which rows travel between Spark and Python.
BATCH = 4 << 20


def small_batches(spark: SparkSession, most: int = BATCH) -> None:
    """From now on rows go to Python in Arrow batches of about ``most`` bytes, unless the session has its own bound: a batch stands in memory on both sides, and 10,000 texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "64MB", f"{64 << 20}", f"{64 << 20}b"):  # Spark's default
        spark.conf.set(name, str(most))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, whose worker gives free memory back at a task's end: workers outlive their tasks, and stages without Python run beside them."""

    @functools.wraps(run)
    def thrifty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return thrifty


def per_group(frame: DataFrame, key: str, order: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str, together: int = 0) -> DataFrame:
    """Partition by ``key``, sort by ``order`` (which starts with it) and call ``work(rows, bounds)``.

    ``rows`` hold whole groups of ``key`` only; ``bounds`` are their edges. Groups are spread by
    Spark; a task holds an Arrow batch and the group that crosses its end, no more, or with
    ``together`` as many rows, where ``work`` gains from many groups at a time.
    """

    def edges(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        x = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
        return np.flatnonzero(x[1:] != x[:-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0

        def flush() -> pa.RecordBatch | None:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            return work(rows, np.concatenate([[0], edges(rows.column(key)), [rows.num_rows]]))

        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index(key)
            if waiting and held >= together and waiting[-1].column(at)[-1].as_py() != batch.column(at)[0].as_py():
                if (out := flush()) is not None:
                    yield out
                waiting, held = [], 0
            inner = edges(batch.column(at))
            cut = int(inner[-1]) if len(inner) else 0
            if cut and held + cut >= together:
                waiting.append(batch.slice(0, cut))
                if (out := flush()) is not None:
                    yield out
                waiting, held, batch = [], 0, batch.slice(cut)
            waiting.append(batch)
            held += batch.num_rows
        if waiting and (out := flush()) is not None:
            yield out

    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(parts, key).sortWithinPartitions(*order).mapInArrow(run, schema)

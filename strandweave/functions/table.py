"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from strandweave.operators.minimizers import extract


@udtf(returnType="hash bigint, pos bigint, strand int")
class Minimizers:
    """(hash, pos, strand) of one sequence's (w, k) minimizers; none for null or short ones."""

    def eval(self, seq: str | None, k: int = 15, w: int = 10) -> Iterator[tuple[int, int, int]]:
        data = np.frombuffer((seq or "").encode("ascii", "replace"), np.uint8)
        _, hashes, pos, strand = extract(data, np.array([0, len(data)]), k, w)
        yield from zip(hashes.tolist(), pos.tolist(), strand.tolist(), strict=True)


def register_minimizers(spark: SparkSession, name: str = "minimizers") -> None:
    """Make ``SELECT ... FROM t, LATERAL name(seq, k, w)`` work; for tables, ``operators.minimizers`` is the fast form."""
    spark.udtf.register(name, Minimizers)

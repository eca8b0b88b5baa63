"""Ranges of ascending doc_id, cut at quantiles: neighbours meet in one group, no global window or sort.

An id (or null) that many rows share, or whose rows are long, weighs more than a range. It then
has ranges of its own, several of them, and its rows are dealt over these.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that weigh as much as a row.
WEIGH = 4096
_TOP = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Ranges:
    """Numbers of ranges that ascend with a long; nulls come first.

    ``bounds`` are the least values of all ranges but the first. ``width`` is, for nulls and then
    for each range, into how many parts it is dealt: above one only for nulls and for ranges of
    one value.
    """

    bounds: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, cuts: list[int], null_parts: int = 0) -> Ranges:
        """From ascending quantiles; a value that is there k > 1 times has k parts. ``null_parts`` 0: nulls are in the first range."""
        value, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        heavy = value[times > 1]
        bounds = np.unique(np.concatenate([value, heavy[heavy < _TOP] + 1]))
        width = np.ones(len(bounds) + 2, np.int64)
        width[0] = null_parts
        width[2 + np.searchsorted(bounds, heavy)] = times[times > 1]
        return cls(bounds, width)

    @property
    def first(self) -> np.ndarray:
        """The first part of nulls, and of each range."""
        return np.cumsum(self.width) - self.width

    @property
    def parts(self) -> int:
        return int(self.width.sum())

    def index(self, values: np.ndarray, null: np.ndarray) -> np.ndarray:
        """0 for nulls, else 1 + the number of the range."""
        within = np.searchsorted(self.bounds, values, "right") + 1
        return np.where(null, 0 if self.width[0] else 1, within)

    def part(self, values: np.ndarray, null: np.ndarray, deal: np.ndarray) -> np.ndarray:
        """The part of each value; where there are several, ``deal`` (longs) chooses."""
        i = self.index(values, null)
        return self.first[i] + deal % np.maximum(self.width[i], 1)

    def level(self) -> np.ndarray:
        """For each part the first part of its range: parts of one value are level."""
        return np.repeat(self.first, self.width)


def whole_ids(docs: DataFrame, column: str = "doc_id") -> None:
    """Ids of other types have no ranges: say so before a job does."""
    if not isinstance(docs.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} must be a whole number, not {docs.schema[column].dataType.simpleString()}")


def id_and_null(column: str = "doc_id") -> tuple[Column, Column]:
    """An id as a long that pandas keeps whole, and whether it is null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(0)), F.col(column).isNull()


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def exact_cuts(docs: DataFrame, cuts: list[int]) -> list[int]:
    """``percentile_approx`` knows doubles: a cut that is there several times becomes the commonest id that rounds to it."""
    value, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    large = [float(v) for v in value[times > 1].tolist() if abs(v) >= 1 << 53]
    if not large:
        return sorted(cuts)
    near = docs.select(F.col("doc_id").cast("long").alias("id")).withColumn("cut", F.col("id").cast("double")).where(F.col("cut").isin(large))
    common = near.groupBy("cut", "id").count().groupBy("cut").agg(F.max_by("id", F.struct("count", "id")).alias("id"))
    real = {r["cut"]: r["id"] for r in common.collect()}  # one row for each of these cuts
    return sorted(real.get(float(c), c) for c in cuts)


def cut_ranges(docs: DataFrame, parts: int, accuracy: int = 10_000) -> Ranges:
    """Some ``parts`` ranges of ``docs(doc_id, text)`` of about equal weight; a row weighs one and one more for each ``WEIGH`` bytes."""
    whole_ids(docs)
    weight = (F.coalesce(F.octet_length("text"), F.lit(0)) / WEIGH).cast("int") + 1
    # a long row is there as often as it weighs, its id alone
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.sequence(F.lit(1), weight)).alias("_w"))
    at = [i / parts for i in range(1, parts)] or [0.5]
    every, known, cuts = ids.agg(F.count("_w"), F.count("doc_id"), F.percentile_approx("doc_id", at, accuracy)).first()
    nulls = -(-(every - known) * parts // every) if every else 0
    return Ranges.of(exact_cuts(docs, cuts or []), nulls)


def part_of(ranges: Ranges, column: str = "doc_id") -> Column:
    """The part of each row; rows of a value with several parts are dealt by their text and place."""

    @F.pandas_udf(T.IntegerType())
    def part(ids: pd.Series, null: pd.Series, deal: pd.Series) -> pd.Series:
        return pd.Series(ranges.part(ids.to_numpy(), null.to_numpy(bool), deal.to_numpy())).astype("int32")

    return part(*id_and_null(column), F.xxhash64("text", F.monotonically_increasing_id()))

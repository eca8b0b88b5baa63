"""FASTQ by byte ranges: files are split at record borders, batch or stream, and every byte is read once.

A border is where a line starts with ``@`` and the next but one with ``+``: in a record only the
header does, as long as sequences start with neither. So tasks find borders from any place in a file by
reading a little of it. What lies between two borders must be whole records, four lines each; if
it isn't (no ``+`` where it should be, say) that is an error and nothing is lost in silence; where
no border can be found at all the range before runs to the end of the file.

The stream source hands out ranges, a bounded number of bytes a batch, and tasks read them. Its
offsets are bytes of each file, so a file may grow, and a restarted query goes on where the last
finished batch ended.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from strandweave.sources.files import listed, read_range, store_of

WINDOW = 1 << 16
SPLIT = 32 << 20
SPLITS = "path string, start long, stop long"
RECORDS = "path string, start long, k long, offset long, name string, seq string, qual string"


def line_starts(body: bytes) -> np.ndarray:
    """Where lines start after a line end; the last entry may be the end of ``body``."""
    return np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1


def record_lines(body: bytes, starts: np.ndarray) -> np.ndarray:
    """Which of the line starts are those of headers."""
    data = np.append(np.frombuffer(body, np.uint8), 0)
    first = data[starts]
    return np.flatnonzero((first[:-2] == 64) & (first[2:] == 43)) if len(starts) > 2 else np.zeros(0, np.int64)


def border_after(path: str, at: int, size: int, window: int = WINDOW) -> int:
    """The first record border at ``at`` or after; ``size`` if there is none."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    while True:
        body = read_range(path, at - 1, min(at - 1 + window, size))
        starts = line_starts(body)
        found = record_lines(body, starts)
        if len(found):
            return at - 1 + int(starts[found[0]])
        if at - 1 + window >= size:
            return size
        window *= 4


def border_before(path: str, start: int, stop: int, window: int = WINDOW) -> int:
    """The end of the last whole record in [start, stop), every line of it ended; ``start``, a border itself, if there is none."""
    while True:
        low = max(start, stop - window)
        body = (b"\n" if low == start else b"") + read_range(path, low, stop)
        starts = line_starts(body)
        found = record_lines(body, starts)
        whole = found[found + 4 < len(starts)]
        if len(whole):
            return low + int(starts[whole[-1] + 4]) - (low == start)
        if low == start:
            return start
        window *= 4


def records(body: bytes, path: str, start: int, ended: bool) -> pa.RecordBatch:
    """The records of a range; ``ended`` says that the file ends with it, so that a last line without an end counts and a last record without its fourth line doesn't."""
    lines = body.split(b"\n")
    if not lines[-1]:
        lines.pop()
    n = len(lines) // 4
    if len(lines) % 4 and not ended:
        raise ValueError(f"{path}: the bytes from {start} on are no whole records of four lines; is there a third line without +?")
    sizes = np.cumsum([0, *(len(x) + 1 for x in lines)])
    heads = lines[: 4 * n : 4]
    if not all(h.startswith(b"@") for h in heads) or (len(lines) > 4 * n and not lines[4 * n].startswith(b"@")):
        raise ValueError(f"{path}: a FASTQ header must start with @")
    text = lambda xs: pa.array([x.decode("utf-8", "replace") for x in xs], pa.string())
    return pa.record_batch(
        [pa.array([path] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(np.arange(n)), pa.array(start + sizes[: 4 * n : 4], pa.int64()), text(re.split(rb"\s", h[1:], maxsplit=1)[0] for h in heads), text(lines[1 : 4 * n : 4]), text(lines[3 : 4 * n : 4])],
        [x.split()[0] for x in RECORDS.split(", ")],
    )


def read_splits(splits: DataFrame, grow: bool = False) -> DataFrame:
    """``splits(path, start, stop, size)`` as RECORDS, ``k`` counting those of a range: ``start`` and ``stop`` move to the next borders first, unless the file may ``grow`` and they are borders already. A task holds one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not grow:
                    start, stop = border_after(path, start, size), border_after(path, stop, size)
                if stop > start:
                    yield records(read_range(path, start, stop), path, start, ended=not grow and stop == size)

    return splits.select("path", "start", "stop", "size").mapInArrow(run, RECORDS)


def fastq_splits(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Ranges of about ``split`` bytes of all files, dealt over all tasks."""
    files = listed(spark, [path], "*").where("size > 0")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long")))
    return files.select("path", "size", at.alias("start")).withColumn("stop", F.least(F.col("start") + split, F.col("size"))).repartition("path", "start")


class FastqRanges(DataSource):
    """``format("fastq_ranges")``: rows (path, start, stop) of whole records in the files of the folder, or file, ``path``. Options: ``split`` bytes of a range and ``maxBytes`` of a batch, about."""

    @classmethod
    def name(cls) -> str:
        return "fastq_ranges"

    def schema(self) -> str:
        return SPLITS

    def reader(self, schema: object) -> DataSourceReader:
        return _Once(self.options)

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return _Following(self.options)


class _Files:
    def __init__(self, options: dict) -> None:
        self.path, self.split, self.most = options["path"], int(options.get("split", SPLIT)), int(options.get("maxbytes", options.get("maxBytes", 1 << 30)))

    def files(self) -> list[tuple[str, int]]:
        """(path, size) of the files by name."""
        store, name = store_of(self.path)
        head = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        info = store.get_file_info(name)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(name, allow_not_found=True))
        return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))

    def ranges(self, path: str, start: int, stop: int) -> Iterator[tuple[str, int, int]]:
        """[start, stop), both borders, in ranges of about ``split`` bytes."""
        while start < stop:
            end = border_after(path, start + self.split, stop) if start + self.split < stop else stop
            yield path, start, end
            start = end


class _Once(_Files, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for path, size in self.files() for r in self.ranges(path, 0, size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.value


class _Following(_Files, SimpleDataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next whole records, ``most`` bytes of them or one longer record; what isn't ended yet waits."""
        end, left = dict(start), self.most
        for path, size in self.files():
            at = start.get(path, 0)
            if left <= 0 or size <= at:
                continue
            stop = border_before(path, at, min(at + left, size))
            reach = left
            while stop == at and at + reach < size:  # a record that is longer than what is left
                reach *= 4
                stop = border_before(path, at, min(at + reach, size))
                stop = border_after(path, at + 1, stop) if stop > at else at
            if stop > at:
                end[path], left = stop, left - (stop - at)
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for path in sorted(end) for r in self.ranges(path, start.get(path, 0), end[path])])


def follow_fastq(spark: SparkSession, path: str, max_bytes: int = 1 << 30, split: int = SPLIT) -> DataFrame:
    """A streaming (read_id, name, seq, qual, path, offset) of FASTQ files that arrive or grow in a folder, about ``max_bytes`` a batch.

    Only ranges pass the driver, one for each ``split`` bytes; tasks read them. Ids are a hash of file and
    byte offset, so they are the same in every replay. The offset holds a number for each file.
    """
    spark.dataSource.register(FastqRanges)
    ranges = spark.readStream.format("fastq_ranges").option("maxBytes", max_bytes).option("split", split).load(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = read_splits(ranges.withColumn("size", F.col("stop")).repartition(parts, "path", "start"), grow=True)
    return rows.select(F.xxhash64("path", "offset").alias("read_id"), "name", "seq", "qual", "path", "offset")

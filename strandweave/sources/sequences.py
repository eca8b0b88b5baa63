"""FASTA, FASTQ and SAM as DataFrames, with Spark's own text reader (any file system, splittable)."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.operators._store import stored
from strandweave.operators.chunks import SIZE, gather, joined
from strandweave.operators.minimizers import buffers
from strandweave.operators.sam import parse_sam
from strandweave.sources.fastq import SPLIT, fastq_splits, read_splits
from strandweave.sources.files import listed, readable


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Text pieces with (file, block, at): their order in a file is by block and then at."""
    rows = spark.read.text(path, lineSep=sep)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _numbered(pieces: DataFrame, value: str) -> DataFrame:
    """Number pieces from 0 in each file: pieces of earlier blocks plus the rank inside the block, so no window spans a file."""
    counts = pieces.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("file", "block").orderBy("at")
    return pieces.withColumn("_rank", F.row_number().over(inside) - 1).join(base, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).select("file", (F.col("_base") + F.col("_rank")).alias("n"), value)


#: Bases of a FASTA piece at most; pieces become chunks.
PIECE = 1 << 16
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_HEADER = re.compile(rb">[ \t]*([^ \t\r>]*)(?:(?<![> \t])[ \t].*|\r)?", re.DOTALL)


def headers(line: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of the headers in a line. Blanks before a name are skipped; a blank after it ends the name and takes the rest of the line; a carriage return ends the header; so does a further ``>``."""
    at = line.find(b">")
    while at >= 0:
        found = _HEADER.match(line, at)
        yield at, found.end(), found.group(1).decode("utf-8", "replace")
        at = line.find(b">", found.end())


def _fasta_pieces(spark: SparkSession, path: str, piece: int) -> DataFrame:
    """(file, block, local, at, name, bases) in one pass over the lines: ``local`` counts headers from the start of the block of the file (0: the contig that was open there), ``at`` the bases since the last of them. A header is a piece with a name. State goes from line to line inside a block only."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, local, at = None, 0, 0
        for batch in batches:
            files, blocks = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1]))[: len(files)]), len(files))
            for lo, hi in itertools.pairwise(edges.tolist()):
                if key != (key := (int(files[lo]), int(blocks[lo]))):
                    local, at = 0, 0
                data, off = buffers(batch.column(0).slice(lo, hi - lo))
                base, data = off[0], data[off[0] : off[-1]]
                kept = ~_BLANK[data]
                marks = []
                for line in np.unique(np.searchsorted(off - base, np.flatnonzero(data == 62), "right") - 1).tolist():
                    s, e = int(off[line] - base), int(off[line + 1] - base)
                    for a, b, name in headers(data[s:e].tobytes()):
                        marks.append((s + a, name))
                        kept[s + a : s + b] = False
                bases = _UPPER[data[kept]].tobytes()
                before = np.append(0, np.cumsum(kept))
                rows = []
                for (start, name), stop in zip([(0, None), *marks], [*(m[0] for m in marks), len(data)], strict=True):
                    if name is not None:
                        local, at = local + 1, 0
                        rows.append((local, 0, name, b""))
                    x, y = int(before[start]), int(before[stop])
                    rows += [(local, at + i - x, None, bases[i : min(i + piece, y)]) for i in range(x, y, piece)]
                    at += y - x
                if not rows:
                    rows = [(local, at, None, b"")]
                cols = list(zip(*rows, strict=True))
                n = len(rows)
                yield pa.record_batch([pa.array([key[0]] * n), pa.array([key[1]] * n), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array([b.decode("utf-8", "replace") for b in cols[3]], pa.string())], ["file", "block", "local", "at", "name", "bases"])

    return lines.mapInArrow(run, "file long, block long, local long, at long, name string, bases string")


@dataclass(frozen=True)
class Fasta:
    """``names(contig_id, name, length)`` and ``chunks``, a chunk table of ``size`` bases a chunk."""

    names: DataFrame
    chunks: DataFrame
    size: int


def read_fasta_chunks(spark: SparkSession, path: str, size: int = SIZE, piece: int = PIECE) -> Fasta:
    """FASTA by lines, straight into chunks: neither a contig nor a file is ever one row.

    ``>`` starts a contig wherever it stands but in the description after a name; the name ends at
    the first blank; white space goes, letters are raised; text before the first ``>`` is skipped;
    empty contigs stay. Ids follow file name and place. One pass numbers contigs and bases inside
    each block of a file; sums over the blocks of a file, and over files, make them global.
    """
    pieces = stored(_fasta_pieces(spark, path, piece))
    runs = pieces.groupBy("file", "block", "local").agg(F.sum(F.octet_length("bases")).alias("n"))
    blocks = runs.groupBy("file", "block").agg(F.max("local").alias("heads"), F.max_by("n", "local").alias("tail"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of a file
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    blocks = blocks.select("*", zero(F.sum("heads").over(order)).alias("_heads"), zero(F.sum("tail").over(order)).alias("_tails"))
    opened = F.last(F.when(F.col("heads") > 0, F.col("_tails")), True).over(order)
    blocks = blocks.select("file", "block", "_heads", (F.col("_tails") - zero(opened)).alias("_open"))
    paths = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.xxhash64("_metadata.file_path").alias("file"))  # names only, no content
    heads = pieces.where(F.col("name").isNotNull()).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = paths.join(heads, "file").select("file", zero(F.sum("n").over(earlier)).alias("_contigs"))
    at = stored(blocks.join(files, "file").select("file", "block", (F.col("_contigs") + F.col("_heads") - 1).alias("_base"), (F.col("_contigs") - 1).alias("_none"), "_open"))
    rows = pieces.join(at, ["file", "block"]).withColumn("contig_id", F.col("_base") + F.col("local")).where(F.col("contig_id") > F.col("_none"))
    start = F.col("at") + F.when(F.col("local") == 0, F.col("_open")).otherwise(0)
    chunks = gather(rows.select("contig_id", start.alias("start"), "bases"), size)
    names = rows.groupBy("contig_id").agg(F.max("name").alias("name"), F.sum(F.octet_length("bases")).cast("long").alias("length"))
    return Fasta(names, chunks, size)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, name, length, seq) as ``read_fasta_chunks`` reads it, a contig a row; for references of short contigs."""
    fasta = read_fasta_chunks(spark, path)
    rows = fasta.names.join(joined(fasta.chunks), "contig_id", "left")
    return rows.select("contig_id", "name", "length", F.coalesce("seq", F.lit("")).alias("seq"))


def read_fastq(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(read_id, name, seq, qual) from strict four-line records; a header without ``@`` is an error, carriage returns stay, a last record without a line end counts, one without its fourth line doesn't.

    Tasks read ranges of ``split`` bytes that end at record borders, each byte once, and keep the
    records; ids come from the counts of the ranges, in order of file and place. Files in a store
    that only Spark can open are read by its text reader (``read_fastq_lines``).
    """
    files = listed(spark, [path], "*")
    kinds = [r["kind"] for r in files.select(F.substring_index("path", ":", 1).alias("kind")).distinct().limit(9).collect()]
    if not all(readable(f"{k}:") for k in kinds):
        return read_fastq_lines(spark, path)
    kept = stored(read_splits(fastq_splits(spark, path, split)))
    counts = kept.groupBy("path", "start").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = counts.select(F.col("path").alias("_p"), F.col("start").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = kept.join(F.broadcast(base), (F.col("path") == F.col("_p")) & (F.col("start") == F.col("_s")))
    return rows.select((F.col("_base") + F.col("k")).cast("long").alias("read_id"), "name", "seq", "qual")


def read_fastq_lines(spark: SparkSession, path: str) -> DataFrame:
    """``read_fastq`` over Spark's text reader: any store, but lines are numbered and put together by shuffles."""
    lines = _numbered(_pieces(spark, path, "\n"), "value")
    at = F.col("n") % 4
    recs = lines.groupBy("file", F.floor(F.col("n") / 4).alias("rec")).agg(*[F.max(F.when(at == k, F.col("value"))).alias(c) for k, c in enumerate(("head", "seq", "plus", "qual"))])
    recs = recs.where(F.col("qual").isNotNull())
    files = recs.groupBy("file").agg((F.max("rec") + 1).alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    base = files.select(F.col("file").alias("_f"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    name = F.when(F.col("head").startswith("@"), F.split(F.substring("head", 2, 1 << 30), r"\s")[0]).otherwise(F.raise_error(F.lit("a FASTQ header must start with @")).cast("string"))
    return recs.join(F.broadcast(base), F.col("file") == F.col("_f")).select((F.col("_base") + F.col("rec")).cast("long").alias("read_id"), name.alias("name"), "seq", "qual")


def fastq_records(files: DataFrame) -> DataFrame:
    """``files(value)``, a whole FASTQ text a row, as (read_id, name, seq, qual); ids are a hash of the text's start and the record's place."""
    lines = F.split("value", "\n")
    whole = F.floor((F.size("_l") - F.when(F.element_at("_l", -1) == "", 1).otherwise(0)) / 4).cast("int")
    rows = files.select(lines.alias("_l")).where(whole > 0).select("_l", F.explode(F.sequence(F.lit(0), whole - 1)).alias("_k"))
    line = lambda k: F.get("_l", F.col("_k") * 4 + k)
    name = F.when(line(0).startswith("@"), F.split(F.substring(line(0), 2, 1 << 30), r"\s")[0]).otherwise(F.raise_error(F.lit("a FASTQ header must start with @")).cast("string"))
    return rows.select(F.xxhash64(F.get("_l", F.lit(0)), F.get("_l", F.lit(1)), "_k").alias("read_id"), name.alias("name"), line(1).alias("seq"), line(3).alias("qual"))


def stream_fastq(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A streaming (read_id, name, seq, qual) of FASTQ files as they arrive in a folder; a file is one row until its records are split, so large files should arrive in parts."""
    return fastq_records(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_sam(header: DataFrame, lines: DataFrame, path: str) -> None:
    """Header and records as text parts that read in order: the header first, then reads ascending."""
    top = header.select(F.lit(0).alias("_p"), F.col("part").cast("long").alias("_a"), F.coalesce("contig_id", F.lit(0)).cast("long").alias("_b"), F.lit(0).alias("_c"), "value")
    body = lines.select(F.lit(1).alias("_p"), F.col("read_id").cast("long").alias("_a"), F.col("fragment_index").cast("long").alias("_b"), F.col("alt_rank").alias("_c"), "value")
    top.unionByName(body).orderBy("_p", "_a", "_b", "_c").select("value").write.mode("overwrite").text(path)


def write_fasta(contigs: DataFrame, path: str, width: int = 60) -> None:
    """``contigs(contig_id, name, seq)`` as FASTA in parts that read in order of contig_id, lines of ``width`` bases."""
    body = F.regexp_replace(F.coalesce("seq", F.lit("")), f"(.{{{int(width)}}})(?=.)", "$1\n")
    rows = stored(contigs.select("contig_id", F.concat(F.lit(">"), "name", F.lit("\n"), body).alias("value")))  # the sort reads them twice
    rows.orderBy("contig_id").select("value").write.mode("overwrite").text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """``reads(read_id, name, seq, qual)`` as FASTQ in parts that read in order of read_id."""
    text = lambda c: F.coalesce(c, F.lit(""))
    reads.orderBy("read_id").select(F.concat(F.lit("@"), "name", F.lit("\n"), text("seq"), F.lit("\n+\n"), text("qual"))).write.mode("overwrite").text(path)

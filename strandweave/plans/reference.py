"""A reference from FASTA to a stored index with its manifest, and a whole mapping run against it."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.seeds import check, shard_id
from strandweave.operators import index as I
from strandweave.operators._store import scratch, stored
from strandweave.operators.anchors import heavy_seeds, query_seeds
from strandweave.operators.chunks import SIZE, joined
from strandweave.operators.sam import sam_header, sam_lines, sam_records
from strandweave.params import Params
from strandweave.plans.mapping import map_seeds
from strandweave.sources.files import listed, with_digest
from strandweave.sources.sequences import read_fasta_chunks, read_fastq, write_sam


@dataclass(frozen=True)
class Reference:
    """A stored reference: its manifest (JSON text), names and lengths of its contigs, their bases in chunks of ``size``, and the index, bucketed by hash."""

    manifest: str
    names: DataFrame
    chunks: DataFrame
    size: int
    index: DataFrame

    @property
    def contigs(self) -> DataFrame:
        """(contig_id, name, length, seq): a contig a row, for references of short contigs."""
        rows = self.names.join(joined(self.chunks), "contig_id", "left")
        return rows.select("contig_id", "name", "length", F.coalesce("seq", F.lit("")).alias("seq"))


def build_reference(spark: SparkSession, fasta: str, path: str, reference_id: str, params: Params | None = None, taxid: int = 0, buckets: int | None = None, size: int = SIZE) -> Reference:
    """FASTA to ``path``: contigs, chunks and index as Parquet, ``layout.json`` and ``reference.json``.

    The index has ``buckets`` buckets by hash (as its size asks for if not given, see
    ``fit_buckets``). Sizes and hashes of the files are worked out by executors from the stored files; the
    driver only sees the manifest.
    """
    p = check(params)
    with scratch(spark):
        fasta_ = read_fasta_chunks(spark, fasta, size)
        fasta_.names.write.mode("overwrite").parquet(f"{path}/contigs")
        fasta_.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    with scratch(spark):
        buckets = _write_index(spark, path, reference_id, p, taxid, buckets)
    layout = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(size).alias("chunk_size"))
    layout.coalesce(1).write.mode("overwrite").json(f"{path}/layout.json")
    return open_reference(spark, path)


def _write_index(spark: SparkSession, path: str, reference_id: str, p: Params, taxid: int, buckets: int | None) -> int:
    seen = Observation()
    hits = stored(I.seed_hits(None, p, spark.read.parquet(f"{path}/chunks")).observe(seen, F.count(F.lit(1)).alias("hits")))
    buckets = buckets or I.fit_buckets(told(seen, "hits"), p)
    counts = stored(I.seed_counts(hits))  # for the cap and for the manifest
    index = I.under_cap(hits, counts, p).withColumn("shard_id", shard_id(F.col("hash"), p.shard_bits))
    I.store_index(index, f"{path}/index", buckets, p)
    folders = [f"{path}/{x}" for x in ("contigs", "chunks", "index")]
    files = with_digest(listed(spark, folders))
    name = F.regexp_extract("path", "(contigs|chunks|index)/[^/]+(/[^/]+)?$", 0)  # from the reference's own folder on
    about = I.manifest(I.count_stats(counts, p), spark.read.parquet(f"{path}/contigs"), files.select(name.alias("path"), "size", "sha256"), reference_id, p, taxid)
    about.coalesce(1).write.mode("overwrite").text(f"{path}/reference.json")
    return buckets


def open_reference(spark: SparkSession, path: str) -> Reference:
    """A stored reference. Its index is a bucketed table again: a seed join needs no exchange on its side."""
    layout = spark.read.json(f"{path}/layout.json").first()
    return Reference(
        spark.read.text(f"{path}/reference.json").first()[0], spark.read.parquet(f"{path}/contigs"), spark.read.parquet(f"{path}/chunks"),
        layout["chunk_size"], I.open_index(spark, f"{path}/index", layout["buckets"]),
    )


def map_run(spark: SparkSession, fastq: str, reference: Reference, out: str, params: Params | None = None, max_reads: int | None = None) -> dict:
    """Map a FASTQ file against a stored reference: SAM text in ``out``, the summary beside it.

    ``max_reads`` takes the first reads of the file. The summary has reads, mapped, unmapped,
    anchors, fragments, wallMs, rps, the reference's id and its manifest. Reads are parsed once,
    their seeds extracted and joined once; the counters are observed on the way. Folders of the
    index that no seed of the reads is in aren't read.
    """
    with scratch(spark):
        return _run(spark, fastq, reference, out, check(params), max_reads)


def told(seen: Observation, name: str) -> object:
    """What was observed of a table that has been written; 0 where the optimizer found the table empty and left it out, observation and all."""
    try:
        return seen.get[name] or 0
    except Py4JJavaError:  # a row without columns
        return 0


def pruned(index: DataFrame, seeds: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, int]:
    """Stored ``seeds``, the index without the folders that none of them touches, and how many seeds there are: one pass over the reads tells all three."""
    seen = Observation()
    kept = stored(seeds.observe(seen, F.count(F.lit(1)).alias("seeds"), I.part_bitmap(F.col("hash"), p).alias("parts")))
    parts = I.touched_parts(told(seen, "parts") or b"")
    return kept, index.where(F.col("part").isin(parts)) if len(parts) < 1 << min(p.shard_bits, I.PART_BITS) else index, told(seen, "seeds")


@dataclass(frozen=True)
class Mapped:
    """A batch of reads that has been mapped: SAM lines, and the counters that were observed on the way."""

    lines: DataFrame
    counters: dict[str, int]


def map_batch(reads: DataFrame, reference: Reference, p: Params) -> Mapped:
    """Map a batch (or all) of ``reads``: they are kept, their seeds extracted once and joined once; counters need no pass of their own. Call it in a ``scratch`` block."""
    every, hits, placed = Observation(), Observation(), Observation()
    reads = stored(reads.observe(every, F.count(F.lit(1)).alias("reads")))
    seeds, index, many = pruned(reference.index, query_seeds(reads, p), p)
    watch = lambda anchors: anchors.observe(hits, F.count(F.lit(1)).alias("anchors"))
    mapping = map_seeds(seeds, reads, reference.names, p, index, reference.chunks, reference.size, watch, heavy_seeds(seeds, many))
    first = F.col("fragment_index") == 0  # each mapped read has one such row that is no alternate
    own = ~F.col("is_secondary")
    placements = stored(mapping.placements.observe(placed, F.sum((own & first).cast("long")).alias("mapped"), F.sum(own.cast("long")).alias("fragments")))
    n, mapped = told(every, "reads"), told(placed, "mapped")
    counters = {"reads": n, "mapped": mapped, "unmapped": n - mapped, "anchors": told(hits, "anchors"), "fragments": told(placed, "fragments")}
    return Mapped(sam_lines(sam_records(placements, reads, reference.names)), counters)


def _run(spark: SparkSession, fastq: str, reference: Reference, out: str, p: Params, max_reads: int | None) -> dict:
    start = time.perf_counter()
    reads = read_fastq(spark, fastq)
    if max_reads is not None:
        reads = reads.where(F.col("read_id") < max_reads)  # ids count from 0 in file order
    mapped = map_batch(reads, reference, p)
    write_sam(sam_header(reference.names), mapped.lines, out)
    seconds = time.perf_counter() - start
    summary = mapped.counters | {"wallMs": seconds * 1000.0, "rps": mapped.counters["reads"] / seconds}
    about = json.loads(reference.manifest)
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in summary.items()], F.lit(about["referenceId"]).alias("reference"), F.lit(reference.manifest).alias("referenceManifest"))
    row.coalesce(1).write.mode("overwrite").json(f"{out}.summary.json")
    return summary

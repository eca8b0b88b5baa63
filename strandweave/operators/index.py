"""The seed index as tables: hits, directory, statistics, manifest."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions.seeds import HASH_ID, check, shard_id
from strandweave.operators._store import stored
from strandweave.operators.minimizers import chunk_minimizers, minimizers
from strandweave.params import Params


def seed_hits(contigs: DataFrame | None, params: Params | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """All (hash, contig_id, pos, strand) of ``contigs(contig_id, seq)``, or of a chunk table, before the frequency cap."""
    found = minimizers(contigs, params, "contig_id", "seq") if chunks is None else chunk_minimizers(chunks, params)
    return found.select("hash", "contig_id", "pos", "strand")


def seed_counts(hits: DataFrame) -> DataFrame:
    """Hits of each hash; partial sums before the shuffle keep a repetitive seed small."""
    return hits.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


def capped(hits: DataFrame, params: Params | None = None) -> DataFrame:
    """Hits without the hashes that have more than ``freq_cap``.

    Hits are extracted once and kept in the shared folder. Counts come from a partial aggregate;
    over-frequent hashes, at most hits / cap of them, are removed by an anti join, so no window
    ever holds one of them whole.
    """
    hits = stored(hits)
    return under_cap(hits, seed_counts(hits), params)


def under_cap(hits: DataFrame, counts: DataFrame, params: Params | None = None) -> DataFrame:
    """``hits`` whose hash has no more than ``freq_cap`` of them by ``counts(hash, n)``. The others are kept first: where these are few, as their size then tells, hits stay where they are."""
    return hits.join(stored(counts.where(F.col("n") > check(params).freq_cap).select("hash").coalesce(8)), "hash", "left_anti")


def build_index(contigs: DataFrame | None, params: Params | None = None, chunks: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(hash, contig_id, pos, strand, shard_id) of contigs or of a chunk table, after the cap.

    With ``seeds(hash)``, best a stored table, hits of other hashes go before anything is stored or counted: an index for
    these reads only. All hits of a hash stay or go together, so the cap finds the same.
    """
    p = check(params)
    hits = seed_hits(contigs, p, chunks)
    if seeds is not None:
        hits = hits.join(stored(seeds.select("hash").distinct().coalesce(8)), "hash", "left_semi")  # where these are few, as their size then tells, hits stay where they are
    return capped(hits, p).withColumn("shard_id", shard_id(F.col("hash"), p.shard_bits))


def write_index(index: DataFrame, table: str, buckets: int) -> None:
    """Store the index bucketed and sorted by hash: later seed joins on hash need no exchange on this side."""
    (index.repartition(buckets, "hash").sortWithinPartitions("hash", "contig_id", "pos").write.bucketBy(buckets, "hash").sortBy("hash").mode("overwrite").saveAsTable(table))


#: Partitions of a stored index: the low bits of the shard that tell which folder a seed is in.
PART_BITS = 6


def index_part(hash_: Column, params: Params | None = None) -> Column:
    """The folder of a seed in a stored index."""
    return shard_id(hash_, min(check(params).shard_bits, PART_BITS))


#: Hits that a file of a stored index should hold.
FILE_HITS = 1 << 20


def fit_buckets(hits: int, params: Params | None = None) -> int:
    """Buckets of an index of so many hits, so that files hold about ``FILE_HITS`` each: their number follows the index and not the cluster."""
    return max(1, -(-hits // (FILE_HITS << min(check(params).shard_bits, PART_BITS))))


def store_index(index: DataFrame, path: str, buckets: int, params: Params | None = None) -> DataFrame:
    """Store the index at ``path``, bucketed and sorted by hash inside a folder for each of a few groups of shards.

    Each bucket of a folder is one file, written by one task; the writer sorts.
    """
    bucket = F.pmod(F.hash("hash"), F.lit(buckets))  # as Spark's writer has it
    parts = max(buckets, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << PART_BITS)
    rows = index.withColumn("part", index_part(F.col("hash"), params)).repartition(parts, "part", bucket)
    name = _table(path)
    index.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    rows.write.partitionBy("part").bucketBy(buckets, "hash").sortBy("hash", "contig_id", "pos").option("path", path).mode("overwrite").saveAsTable(name)
    return index.sparkSession.table(name)


def open_index(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A stored index, as bucketed as it was written, in any session."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        columns = "hash BIGINT, contig_id BIGINT, pos BIGINT, strand INT, shard_id INT, part INT"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (part) CLUSTERED BY (hash) SORTED BY (hash) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def _table(path: str) -> str:
    return f"seed_index_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def touched_parts(bitmap: bytes) -> list[int]:
    """The places of the set bits."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")).tolist()


def part_bitmap(hash_: Column, params: Params | None = None) -> Column:
    """An aggregate that says, in 4 kB, which folders of a stored index some seeds touch."""
    return F.bitmap_construct_agg(F.bitmap_bit_position(index_part(hash_, params).cast("long") + 1))


def index_stats(hits: DataFrame, params: Params | None = None) -> DataFrame:
    """total_hits and distinct_seeds that stay, capped_seed_hits that go."""
    return count_stats(seed_counts(hits), params)


def count_stats(counts: DataFrame, params: Params | None = None) -> DataFrame:
    """``index_stats`` from ``counts(hash, n)``."""
    p = check(params)
    fine = F.col("n") <= p.freq_cap
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return counts.agg(
        zero(F.sum(F.when(fine, F.col("n")))).alias("total_hits"), zero(F.sum(fine.cast("long"))).alias("distinct_seeds"), zero(F.sum(F.when(~fine, F.col("n")))).alias("capped_seed_hits")
    )


def directory(index: DataFrame) -> DataFrame:
    """(shard_id, hash, hit_offset, n): where each seed's hits start in its shard, seeds ascending."""
    counts = index.groupBy("shard_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard_id").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("shard_id", "hash", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("hit_offset"), "n")


#: Names that an index states about itself.
SEED_SCHEME, HASH_NAME = "canonical-minimizer", "mm_hash64_v1"


def manifest(stats: DataFrame, contigs: DataFrame, files: DataFrame, reference_id: str, params: Params | None = None, taxid: int = 0, format_version: int = 1) -> DataFrame:
    """One JSON row that describes an index.

    ``stats`` is ``index_stats`` of all hits (before the cap, so that capped ones are known);
    ``files(path, size, sha256)`` are the stored files, its own sequence file included.
    """
    p = check(params)
    many = contigs.agg(F.count(F.lit(1)).alias("contigs"))
    listed = files.agg(F.array_sort(F.collect_list(F.struct("path", "size", "sha256"))).alias("files"))  # one row per stored file
    fixed = {"format": "seed-index", "formatVersion": format_version, "referenceId": reference_id, "taxid": taxid, "seedScheme": SEED_SCHEME, "k": p.k, "w": p.w, "shardBits": p.shard_bits, "hashFn": HASH_NAME, "hashFnId": HASH_ID}
    row = F.struct(
        *[F.lit(v).alias(n) for n, v in fixed.items()], F.struct(F.lit(p.freq_cap).alias("freqCapPerHash")).alias("seedSchemeParams"), "contigs", F.lit(1 << p.shard_bits).alias("shards"),
        F.col("total_hits").alias("totalHits"), F.col("distinct_seeds").alias("distinctSeeds"), F.col("capped_seed_hits").alias("cappedSeedHits"), "files",
    )
    return stats.crossJoin(many).crossJoin(listed).select(F.to_json(row).alias("value"))  # three one-row tables


def pos_checked(hits: DataFrame) -> DataFrame:
    """Hits whose position and contig fit the packed form; others raise."""
    ok = (F.col("pos") < (1 << 28)) & (F.col("contig_id") < (1 << 16))
    return hits.withColumn("pos", F.when(ok, F.col("pos")).otherwise(F.raise_error(F.lit("position or contig does not fit the packed hit"))))

"""Seed lookup as an equi-join, and the planning views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.seeds import check, joint_strand, shard_id
from strandweave.operators.minimizers import minimizers
from strandweave.params import Params


def query_seeds(reads: DataFrame, params: Params | None = None) -> DataFrame:
    """(read_id, q_pos, q_strand, hash) of ``reads(read_id, seq)``; a read's repeated seeds stay."""
    rows = minimizers(reads, params, "read_id", "seq")
    return rows.select("read_id", F.col("pos").alias("q_pos"), F.col("strand").alias("q_strand"), "hash")


#: A seed is heavy beyond this share of all query seeds, and beyond so many of them: there are fewer than a thousand, with ``freq_cap`` hits each at most.
HEAVY_SHARE, HEAVY_LEAST = 1000, 1000
#: Cells of the sketch that tells which seeds can be heavy.
CELLS = 1 << 16


def heavy_seeds(seeds: DataFrame, total: int, share: int = HEAVY_SHARE, least: int = HEAVY_LEAST) -> DataFrame | None:
    """(hash) of the seeds that more than ``total`` / ``share`` (and ``least``) rows of ``seeds`` have; None if there can't be any.

    Counts of hashes folded to ``CELLS`` cells are a bound that no heavy seed escapes and that takes no
    more than ``CELLS`` rows a task to shuffle; only seeds of heavy cells are counted one by one.
    """
    bound = max(total // share, least)
    if total <= bound:
        return None
    cell = F.pmod(F.xxhash64("hash"), F.lit(CELLS)).cast("int")
    rows = seeds.select("hash", cell.alias("cell"))
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select("cell")  # fewer than ``share``
    return rows.join(F.broadcast(cells), "cell", "left_semi").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select("hash")


def seed_anchors(seeds: DataFrame, index: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """One row for each (query seed, hit) with equal hash. Sequences are never carried through this join.

    Rows of ``heavy`` seeds (see ``heavy_seeds``) stay where they are, and the hits of these few
    seeds go to all of them; the others meet by hash. So no task gets all rows of one seed.
    """
    hits = index.select("hash", "contig_id", F.col("pos").alias("ref_pos"), F.col("strand").alias("ref_strand"))
    if heavy is None:
        joined = seeds.join(hits, "hash")
    else:
        few = F.broadcast(heavy)
        joined = seeds.join(few, "hash", "left_anti").join(hits, "hash").unionByName(seeds.join(few, "hash", "left_semi").join(F.broadcast(hits.join(few, "hash", "left_semi")), "hash"))
    return joined.select("read_id", "q_pos", "q_strand", "contig_id", "ref_pos", "ref_strand", "hash", joint_strand(F.col("q_strand"), F.col("ref_strand")).alias("joint"))


def anchor_counts(anchors: DataFrame, least: int = 3) -> DataFrame:
    """Anchors of each (read, contig, joint strand) with ``least`` or more."""
    return anchors.groupBy("read_id", "contig_id", "joint").agg(F.count(F.lit(1)).alias("n_anchors")).where(F.col("n_anchors") >= least)


def shard_plan(seeds: DataFrame, params: Params | None = None) -> DataFrame:
    """Query seeds per shard: (shard_id, n_seeds, n_reads); shards without seeds aren't read."""
    p = check(params)
    rows = seeds.withColumn("shard_id", shard_id(F.col("hash"), p.shard_bits))
    return rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_seeds"), F.count_distinct("read_id").alias("n_reads"))


def assign_workers(shards: DataFrame, workers: int) -> DataFrame:
    """Ascending shards in contiguous ranges of ceil(n / workers); at most 2^shard_bits rows, so one window is fine."""
    if workers < 1:
        raise ValueError("workers must be positive")
    order, every = Window.orderBy("shard_id"), Window.partitionBy()
    return shards.select("shard_id").distinct().select(
        "shard_id", F.least(F.lit(workers - 1), F.floor((F.row_number().over(order) - 1) / F.ceil(F.count(F.lit(1)).over(every) / workers))).cast("int").alias("worker")
    )


def anchor_spans(anchors: DataFrame, params: Params | None = None) -> DataFrame:
    """Span, anchors and distinct seeds of all anchors of a (read, contig, joint), as if they were one chain."""
    p = check(params)
    rows = anchors.groupBy("read_id", "contig_id", "joint").agg(
        F.min("q_pos").alias("q0"), F.max("q_pos").alias("q1"), F.min("ref_pos").alias("r0"), F.max("ref_pos").alias("r1"),
        F.count(F.lit(1)).alias("anchor_count"), F.count_distinct("hash").alias("unique_anchors"),
    )
    q0, r0 = F.greatest(F.lit(0), F.col("q0") - (p.k - 1)), F.greatest(F.lit(0), F.col("r0") - (p.k - 1))
    e = F.least(F.lit(p.window_ext), q0, r0)
    return rows.select("read_id", "contig_id", "joint", (q0 - e).alias("q_start"), (F.col("q1") + 1 + p.window_ext).alias("q_end"), (r0 - e).alias("ref_start"), (F.col("r1") + 1 + p.window_ext).alias("ref_end"), "anchor_count", "unique_anchors")

"""The whole mapping as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.seeds import check, project_dna
from strandweave.operators._groups import small_batches
from strandweave.operators._store import spread, stored
from strandweave.operators.anchors import query_seeds, seed_anchors
from strandweave.operators.blocks import HITS, SEEDS, block_chains, hit_blocks, over_cap, seed_blocks
from strandweave.operators.chain import chain_anchors, least_anchors
from strandweave.operators.chunks import SIZE
from strandweave.operators.index import build_index
from strandweave.operators.refine import refine_endpoints
from strandweave.operators.sam import sam_lines, sam_records
from strandweave.operators.select import select_fragments
from strandweave.params import Params


@dataclass(frozen=True)
class Mapping:
    """What a mapping made on the way; every part is a lazy DataFrame."""

    seeds: DataFrame
    anchors: DataFrame
    placements: DataFrame
    all_chains: Callable[[], DataFrame]

    @property
    def chains(self) -> DataFrame:
        """All chains with their anchors, those too short for a placement too; made when asked for, as placements need less."""
        return self.all_chains()


def map_reads(reads: DataFrame, contigs: DataFrame, params: Params | None = None, index: DataFrame | None = None, chunks: DataFrame | None = None, size: int = SIZE) -> Mapping:
    """Map ``reads(read_id, name, seq, qual)`` to ``contigs(contig_id, name, length, seq)``.

    ``index`` is a built one (a bucketed table, say); without it, it is built on the fly. With
    ``refine`` chains are extended before selection; with ``clamp`` spans end at the read's and
    contig's ends. ``chunks`` is the reference as a chunk table of ``size`` bases a chunk;
    with it ``contigs`` need no ``seq``.
    """
    p = check(params)
    return map_seeds(query_seeds(reads, p), reads, contigs, p, build_index(contigs, p, chunks) if index is None else index, chunks, size)


def map_seeds(seeds: DataFrame, reads: DataFrame, contigs: DataFrame, params: Params | None, index: DataFrame, chunks: DataFrame | None = None, size: int = SIZE, watch: Callable[[DataFrame], DataFrame] = lambda x: x, heavy: DataFrame | None = None) -> Mapping:
    """``map_reads`` from the reads' seeds on; ``watch`` gets the anchors on their way to the chains (to observe or to keep them); ``heavy`` are seeds that very many reads have."""
    p = check(params)
    anchors = watch(seed_anchors(seeds, index, heavy))

    def spanned(chains: DataFrame) -> DataFrame:
        if p.refine:
            chains = refine_endpoints(stored(chains), reads, contigs, p, chunks, size)  # chains are read twice: for the flanks to fetch and to extend
        if p.clamp:
            lengths = contigs.select(F.col("contig_id").alias("_c"), (F.col("length") if "length" in contigs.columns else F.length("seq")).alias("_m"))
            sizes = reads.select(F.col("read_id").alias("_r"), F.length("seq").alias("_n"))
            wide = chains.join(sizes, F.col("read_id") == F.col("_r")).join(lengths, F.col("contig_id") == F.col("_c"))
            ends = {"q_end": F.least("q_end", F.col("_n").cast("long")), "ref_end": F.least("ref_end", F.col("_m").cast("long"))}
            chains = wide.select(*[ends[c].alias(c) if c in ends else F.col(c) for c in chains.columns])
        return chains

    placements = select_fragments(spanned(chain_anchors(anchors, p, least_anchors(p), members=False)), p)
    return Mapping(seeds, anchors, placements, lambda: spanned(chain_anchors(anchors, p)))


#: Bases of one contig id up to which contigs are worked on in blocks, and pairs of blocks at most: beyond, the join by hash, whose work grows in proportion, is for them.
BLOCK_BASES, PAIRS = 1 << 26, 1 << 20


def place_reads(reads: DataFrame, contigs: DataFrame, params: Params | None = None) -> DataFrame:
    """The placements of ``map_reads`` for very many reads and contigs of moderate length, without a table of anchors.

    ``contigs`` are best a stored table: they are read for their lengths and for their hits. Hits and
    seeds are kept as blocks, and chains are made from pairs of blocks (see ``operators.blocks``).
    """
    p = check(params)
    if p.refine or p.clamp:
        raise ValueError("refine and clamp need map_reads")
    small_batches(contigs.sparkSession)  # a pair of blocks at a time
    named = contigs.where(F.col("contig_id").cast("long").isNotNull())
    sizes = named.groupBy(F.col("contig_id").cast("long").alias("contig_id")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("seq").cast("long") if "length" not in contigs.columns else "length").alias("bases"))
    ids, rows, longest, bases = sizes.agg(F.count(F.lit(1)), *[F.coalesce(x, F.lit(0)) for x in (F.sum("rows"), F.max("bases"), F.sum("bases"))]).first()
    if longest > BLOCK_BASES:
        return map_reads(reads, contigs, p).placements
    parts = max(2 * contigs.sparkSession.sparkContext.defaultParallelism, bases // (p.w + 1) // HITS)  # each holds about a block: a base gives 2 / (w + 1) hits, less where sequences break
    # contigs of one id are one contig
    hits = stored(hit_blocks(named.coalesce(parts) if ids == rows else named.repartition(parts, "contig_id").sortWithinPartitions("contig_id"), p))
    nameless = contigs.where(F.col("contig_id").cast("long").isNull()).withColumn("contig_id", F.monotonically_increasing_id())  # nothing is placed on them, but their hits count
    often = stored(over_cap(hits.unionByName(hit_blocks(nameless, p)), p).coalesce(8))
    seeds = stored(query_seeds(reads, p))
    total = seeds.count()
    if hits.count() * (total // SEEDS + 1) > PAIRS:
        return map_seeds(seeds, reads, contigs, p, build_index(contigs, p)).placements
    blocks = stored(seed_blocks(seeds.join(often, "hash", "left_anti"), total, p))
    least = least_anchors(p)
    return select_fragments(block_chains(hits, blocks, p, least), p)


def map_to_sam(reads: DataFrame, contigs: DataFrame, params: Params | None = None, index: DataFrame | None = None) -> DataFrame:
    """SAM lines of the mapping: (read_id, fragment_index, alt_rank, value)."""
    return sam_lines(sam_records(stored(map_reads(reads, contigs, params, index).placements), reads, contigs))


def text_contigs(docs: DataFrame) -> DataFrame:
    """A text table as contigs: doc_id is the contig."""
    rows = spread(docs.select("doc_id", "text")).select(F.col("doc_id").alias("contig_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), project_dna(F.coalesce("text", F.lit(""))).alias("seq"))
    return rows.select("contig_id", "name", F.length("seq").cast("long").alias("length"), "seq")


def text_reads(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """A text table as reads of constant quality."""
    rows = items.select(F.col(id_col).alias("read_id"), F.concat(F.lit("item"), F.col(id_col).cast("string")).alias("name"), project_dna(F.coalesce("text", F.lit(""))).alias("seq"))
    return rows.withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))

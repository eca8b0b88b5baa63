"""Queries over the given tables, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import seeds as S_
from strandweave.functions.seeds import approximate_mapq, project_dna, reverse_complement, shard_id
from strandweave.functions.table import register_minimizers
from strandweave.operators import anchors as A
from strandweave.operators import chunks as C
from strandweave.operators import evaluate as E
from strandweave.operators import index as I
from strandweave.operators import minimizers as M
from strandweave.operators import sam as S
from strandweave.operators._store import shared_path, stored
from strandweave.operators.chain import chain_scores
from strandweave.params import Params
from strandweave.plans import oracles as O
from strandweave.plans import reference as R
from strandweave.plans.mapping import Mapping, map_reads, map_seeds, place_reads, text_contigs, text_reads
from strandweave.sources import sequences as Q
from strandweave.sources.fastq import follow_fastq
from strandweave.streaming.mapping import map_growing, totals

P = Params()
CUT = 300


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _contigs(spark: SparkSession, sf: str) -> DataFrame:
    return text_contigs(_table(spark, sf, "documents"))


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    return text_reads(_table(spark, sf, "benchmark"))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return I.build_index(_contigs(spark, sf), P)


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    return A.seed_anchors(A.query_seeds(_reads(spark, sf), P), _index(spark, sf))


def _mapped(spark: SparkSession, sf: str, index: DataFrame | None = None, **changes: object) -> Mapping:
    return map_reads(_reads(spark, sf), _contigs(spark, sf), Params(**changes), index)


def dna_projection(spark: SparkSession, sf: str) -> DataFrame:
    seq = project_dna(F.coalesce("text", F.lit("")))
    rows = _table(spark, sf, "documents").select("doc_id", seq.alias("seq"))
    return rows.select("doc_id", F.length("seq").cast("long").alias("n_bases"), (F.length("seq") - F.length(F.translate("seq", "N", ""))).cast("long").alias("n_breaks"), F.md5("seq").alias("seq_md5"), F.md5(reverse_complement(F.col("seq"))).alias("rc_md5"))


def kmer_hash(spark: SparkSession, sf: str) -> DataFrame:
    return M.kmer_sums(_contigs(spark, sf), P, "contig_id", "seq")


def _mini(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(name, "hash", "pos", F.col("strand").cast("long").alias("strand"))


def minimizers(spark: SparkSession, sf: str) -> DataFrame:
    return _mini(M.minimizers(_contigs(spark, sf), P, "contig_id", "seq"), "contig_id")


def minimizers_sql(spark: SparkSession, sf: str) -> DataFrame:
    return _mini(M.minimizers_sql(_contigs(spark, sf), P, "contig_id", "seq"), "contig_id")


def read_minimizers(spark: SparkSession, sf: str) -> DataFrame:
    return _mini(M.minimizers(_reads(spark, sf), P, "read_id", "seq"), "read_id")


def shard_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.seed_hits(_contigs(spark, sf), P).withColumn("shard_id", shard_id(F.col("hash"), P.shard_bits).cast("long"))
    return rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_hits"))


def shard_plan(spark: SparkSession, sf: str) -> DataFrame:
    return A.shard_plan(A.query_seeds(_reads(spark, sf), P), P).withColumn("shard_id", F.col("shard_id").cast("long"))


def shard_worker_assignment(spark: SparkSession, sf: str) -> DataFrame:
    out = A.assign_workers(A.shard_plan(A.query_seeds(_reads(spark, sf), P), P), 4)
    return out.select(F.col("shard_id").cast("long").alias("shard_id"), F.col("worker").cast("long").alias("worker"))


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return I.index_stats(I.seed_hits(_contigs(spark, sf), P), P)


def index_directory(spark: SparkSession, sf: str) -> DataFrame:
    return I.directory(_index(spark, sf)).withColumn("shard_id", F.col("shard_id").cast("long"))


def seed_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return _anchors(spark, sf).select("read_id", "q_pos", "contig_id", "ref_pos", "hash", F.col("joint").cast("long").alias("joint"))


def anchor_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: which documents share passages with which benchmark items, by seeds."""
    return A.anchor_counts(_anchors(spark, sf)).withColumn("joint", F.col("joint").cast("long"))


def anchor_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Span, anchors and distinct seeds of all anchors of a (read, contig, strand) taken as one chain."""
    return _wide(A.anchor_spans(_anchors(spark, sf), P).where("anchor_count >= 2"))


def chain_dp(spark: SparkSession, sf: str) -> DataFrame:
    rows = chain_scores(_anchors(spark, sf), P)
    return rows.select("read_id", "contig_id", F.col("joint").cast("long").alias("joint"), "ref_pos", "q_pos", F.round("f", 6).alias("f"), "back")


def _wide(rows: DataFrame) -> DataFrame:
    """Small integers as longs, so that engines agree on the schema."""
    return rows.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() == "int" else F.col(f.name) for f in rows.schema])


def _fragments(m: Mapping) -> DataFrame:
    rows = m.placements.withColumn("mapq", approximate_mapq(F.col("f1"), F.col("f2"), F.col("m")))
    return _wide(rows.withColumns({c: F.round(c, 6) for c in ("score", "f1", "f2")}))


def chains(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.transform("anchors", lambda a: F.concat(a["q_pos"].cast("string"), F.lit(":"), a["ref_pos"].cast("string")))
    return _wide(_mapped(spark, sf).chains.withColumns({"score": F.round("score", 6), "anchors": F.array_join(pairs, ",")}))


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    return _fragments(_mapped(spark, sf))


def secondary_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return _fragments(_mapped(spark, sf, secondary=5))


def refined_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return _fragments(_mapped(spark, sf, refine=True))


def sam_header(spark: SparkSession, sf: str) -> DataFrame:
    return S.sam_header(_contigs(spark, sf)).select(F.col("part").cast("long").alias("part"), F.coalesce("contig_id", F.lit(-1)).cast("long").alias("contig_id"), "value")


def sam_body(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(S.sam_lines(S.sam_records(stored(_mapped(spark, sf).placements), _reads(spark, sf), _contigs(spark, sf))))


def sam_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    """The unmapped records of a search that accepts nothing: one line for every read."""
    none = _mapped(spark, sf).placements.where(F.lit(False))
    lines = S.sam_lines(S.sam_records(none, _reads(spark, sf), _contigs(spark, sf)))
    return lines.select("read_id", "value")


def sam_unplaced(spark: SparkSession, sf: str) -> DataFrame:
    """The unmapped records of the real mapping: one line for every read without a placement."""
    placements, reads = stored(_mapped(spark, sf).placements), _reads(spark, sf)
    rest = reads.join(placements.select("read_id").distinct(), "read_id", "left_anti")
    lines = S.sam_lines(S.sam_records(placements.where(F.lit(False)), rest, _contigs(spark, sf)))
    return lines.select("read_id", "value")


def _sam(m: Mapping, spark: SparkSession, sf: str) -> DataFrame:
    return S.parse_sam(S.sam_lines(S.sam_records(stored(m.placements), _reads(spark, sf), _contigs(spark, sf))))


def sam_parsed(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(_sam(_mapped(spark, sf), spark, sf))


def sam_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Reads with and without a placement, supplementary and secondary records of a mapping with alternates."""
    return S.sam_counters(_sam(_mapped(spark, sf, secondary=5), spark, sf))


def cigar_parse(spark: SparkSession, sf: str) -> DataFrame:
    """CIGAR texts made of the line items, and the spans read from them."""
    n = lambda c: F.col(c).cast("long").cast("string")
    clip = F.when(F.col("l_linenumber") % 2 == 0, "S").otherwise("H")
    text = F.concat(n("l_quantity"), clip, n("l_orderkey"), F.lit("M"), n("l_linenumber"), F.lit("I"), n("l_suppkey"), F.lit("D"), n("l_partkey"), F.lit("S"))
    lines = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.lit("16\tc\t7\t30"), text, F.lit("*\t0\t0\t*\t*")).alias("value"))
    rows = S.parse_sam(lines)
    return rows.groupBy("cigar").agg(F.count(F.lit(1)).alias("n"), F.max("q_start").alias("q_start"), F.max("q_end").alias("q_end"), F.max("ref_span").alias("ref_span"), F.max("pos0").alias("pos0"))


def sam_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The default mapping held against the refined one; both are made of one set of contigs and the hits of the reads' seeds."""
    reads, contigs = _reads(spark, sf), stored(_contigs(spark, sf))
    seeds = stored(A.query_seeds(reads, P))
    index = stored(I.build_index(contigs, P, seeds=seeds))
    sides = [map_seeds(seeds, reads, contigs, Params(refine=r), index) for r in (False, True)]
    out = E.diff_sam(*[stored(S.parse_sam(S.sam_lines(S.sam_records(stored(m.placements), reads, contigs)))) for m in sides])
    return out.withColumn("mapq_spearman", F.round("mapq_spearman", 6))


def mapped_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Mapped reads of two seedings: w = 10 and w = 15."""
    return E.mapped_jaccard(*[_sam(_mapped(spark, sf, w=w), spark, sf) for w in (10, 15)])


def spearman_prices(spark: SparkSession, sf: str) -> DataFrame:
    out = E.spearman(_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.withColumn("spearman", F.round("spearman", 6))


def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return E.average_ranks(_table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", F.col("rank").cast("double").alias("rank"))


def text_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def cut_reads(contigs: DataFrame, size: int = CUT) -> tuple[DataFrame, DataFrame]:
    """A read of ``size`` bases, or all there are, from each contig, odd ones reverse-complemented, and where it is from.

    A contig too short for a seed gives a read too: one that can't be placed.
    """
    start = ((F.col("contig_id") * 37) % F.greatest(F.lit(1), F.col("length") - size)).cast("int")
    rows = contigs.select("contig_id", start.alias("start"), F.substring("seq", start + 1, F.lit(size)).alias("s"))
    odd = F.col("contig_id") % 2 == 1
    seq = F.when(odd, reverse_complement(F.col("s"))).otherwise(F.col("s"))
    reads = rows.select(F.col("contig_id").alias("read_id"), F.concat(F.lit("cut"), F.col("contig_id").cast("string")).alias("name"), seq.alias("seq"), F.repeat(F.lit("I"), F.length("s")).alias("qual"))
    return reads, rows.select(F.col("contig_id").alias("read_id"), "contig_id", F.col("start").cast("long").alias("start"), odd.cast("int").alias("joint"))


def truth_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    contigs = stored(_contigs(spark, sf))  # the index, the reads and the truth come from them
    reads, truth = cut_reads(contigs)
    return E.truth_accuracy(place_reads(reads, contigs, P), truth)


def mapping_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a mapping whose seeds are extracted once and joined once: seeds and anchors are kept, as both are counted and used."""
    reads, contigs = _reads(spark, sf), _contigs(spark, sf)
    m = map_seeds(stored(A.query_seeds(reads, P)), reads, contigs, P, I.build_index(contigs, P), watch=stored)
    return E.mapping_stats(reads, m.placements, m.anchors, m.seeds, P.shard_bits)


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts of reads that join a piece of a document and a piece of the next one."""
    contigs = stored(_contigs(spark, sf))  # as in truth_accuracy
    reads, _ = cut_reads(contigs)
    other = reads.select((F.col("read_id") - 1).alias("_r"), F.col("seq").alias("_s"))
    joined = reads.join(other, F.col("read_id") == F.col("_r")).select("read_id", "name", F.concat("seq", "_s").alias("seq")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    return E.contact_summary(E.contacts(place_reads(joined, contigs, P)))


def chunked_minimizers(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' minimizers from chunks of 1,000 bases, each chunk by itself."""
    rows = M.chunk_minimizers(C.cut(_contigs(spark, sf), size=1000), P)
    return _mini(rows, "contig_id")


def reference_windows(spark: SparkSession, sf: str) -> DataFrame:
    """100 bases around the middle of every document's sequence, fetched from chunks of 64 bases."""
    contigs = _contigs(spark, sf)
    middle = F.floor(F.col("length") / 2).cast("long")
    found = C.reference_windows(contigs.select("contig_id", (middle - 50).alias("start"), (middle + 50).alias("end")), C.cut(contigs, size=64, halo=0), 64)
    return found.select("contig_id", "start", F.col("end").alias("stop"), "bases")


def base_codes(spark: SparkSession, sf: str) -> DataFrame:
    """How often each 2-bit code (4: no base) occurs among the first letters of the words of every document."""
    words = _table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("w"))
    return words.where("w <> ''").select("doc_id", S_.base_code(F.substring("w", 1, 1)).cast("long").alias("code")).groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"))


def minimizers_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's minimizers by the table function, in SQL."""
    register_minimizers(spark, "seed_minimizers")
    return spark.sql("SELECT r.read_id, m.hash, m.pos, CAST(m.strand AS BIGINT) AS strand FROM {r} r, LATERAL seed_minimizers(r.seq, 15, 10) m", r=_reads(spark, sf))


def alternate_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each placement's query span that its fragment covers: 1 for the fragment itself, less for most alternates."""
    rows = stored(_mapped(spark, sf, secondary=5).placements).select("read_id", "fragment_index", "alt_rank", "q_start", "q_end")
    own = rows.where("alt_rank = 0").select("read_id", "fragment_index", F.col("q_start").alias("s"), F.col("q_end").alias("e"))
    share = S_.overlap_fraction(F.col("q_start"), F.col("q_end"), F.col("s"), F.col("e"))
    return rows.join(own, ["read_id", "fragment_index"]).select("read_id", *[F.col(c).cast("long").alias(c) for c in ("fragment_index", "alt_rank")], F.round(share, 6).alias("overlap"))


def fasta_contigs(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' sequences written as FASTA and read back by lines."""
    path = shared_path(spark)
    Q.write_fasta(_contigs(spark, sf), path)
    return Q.read_fasta(spark, path).select("contig_id", "name", "length", F.md5("seq").alias("seq_md5"))


def fastq_reads(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's reads written as FASTQ and read back by byte ranges of 2 kB."""
    path = shared_path(spark)
    Q.write_fastq(_reads(spark, sf), path)
    return Q.read_fastq(spark, path, 2048).select("read_id", "name", F.md5("seq").alias("seq_md5"), F.length("qual").cast("long").alias("n_qual"))


def _reference(spark: SparkSession, sf: str) -> R.Reference:
    """The documents as a stored reference, by way of FASTA."""
    fasta = shared_path(spark)
    Q.write_fasta(_contigs(spark, sf), fasta)
    return R.build_reference(spark, fasta, shared_path(spark), "documents", P)


def stored_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What the manifest of the stored reference says."""
    text = _reference(spark, sf).manifest
    one = lambda name, path: F.get_json_object(F.lit(text), f"$.{path}").cast("long").alias(name)
    names = {"contigs": "contigs", "shards": "shards", "k": "k", "w": "w", "freq_cap": "seedSchemeParams.freqCapPerHash", "total_hits": "totalHits", "distinct_seeds": "distinctSeeds", "capped_seed_hits": "cappedSeedHits"}
    return spark.range(1).select(*[one(n, p) for n, p in names.items()])


def stored_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's anchors from the stored, bucketed and pruned index."""
    seeds, index, n = R.pruned(_reference(spark, sf).index, A.query_seeds(_reads(spark, sf), P), P)
    return A.seed_anchors(seeds, index, A.heavy_seeds(seeds, n)).select("read_id", "q_pos", "contig_id", "ref_pos", "hash", F.col("joint").cast("long").alias("joint"))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of a whole run, FASTQ against the stored reference, as they were observed on the way."""
    fastq = shared_path(spark)
    Q.write_fastq(_reads(spark, sf), fastq)
    found = R.map_run(spark, fastq, _reference(spark, sf), shared_path(spark), P)
    return spark.range(1).select(*[F.lit(found[c]).cast("long").alias(c) for c in ("reads", "mapped", "unmapped", "anchors", "fragments")])


def streamed_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The totals of the same reads as a stream of FASTQ, a few at a time."""
    home, fastq, out = _reference(spark, sf), shared_path(spark), shared_path(spark)
    Q.write_fastq(_reads(spark, sf), fastq)
    query = map_growing(follow_fastq(spark, fastq, 1 << 14), home, out, shared_path(spark), P)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.range(1).select(*[F.lit(n).cast("long").alias(c) for c, n in totals(spark, out).items()])


QUERIES = {f.__name__: f for f in (
    dna_projection, kmer_hash, minimizers, minimizers_sql, read_minimizers, shard_histogram, shard_plan, shard_worker_assignment, index_stats, index_directory,
    seed_anchors, anchor_counts, anchor_spans, chain_dp, chains, fragments, secondary_fragments, refined_fragments, sam_header, sam_body, sam_unmapped, sam_unplaced, sam_parsed, sam_counters,
    cigar_parse, sam_diff, mapped_jaccard, spearman_prices, average_ranks, text_sha256, truth_accuracy, mapping_stats, contacts,
    chunked_minimizers, reference_windows, base_codes, minimizers_lateral, alternate_overlap, fasta_contigs, fastq_reads, stored_manifest, stored_anchors, run_summary, streamed_totals,
)}


# --- SQL twins -----------------------------------------------------------------------------

_D, _B = O.D, O.B
_INDEX = f"{_D}, ix AS (SELECT * FROM d_m WHERE hash NOT IN (SELECT hash FROM d_m GROUP BY hash HAVING count(*) > 1000))"
_ANCHORS = f"""{_INDEX}, {_B}, an AS (SELECT b_m.id AS read_id, b_m.pos AS q_pos, ix.id AS contig_id, ix.pos AS ref_pos, ix.hash, xor(b_m.strand, ix.strand) AS joint FROM b_m JOIN ix USING (hash))"""

ORACLES = {
    "dna_projection": f"SELECT doc_id, CAST(length(s) AS BIGINT) AS n_bases, CAST(length(s) - length(replace(s, 'N', '')) AS BIGINT) AS n_breaks, md5(s) AS seq_md5, md5(translate(reverse(s), 'ACGT', 'TGCA')) AS rc_md5 FROM (SELECT doc_id, {O.seq()} AS s FROM documents)",
    "kmer_hash": f"WITH {_D} SELECT id AS contig_id, count(*) AS n_kmers, CAST(sum(hash) AS BIGINT) AS hash_sum, max(hash) AS hash_max, CAST(sum(strand) AS BIGINT) AS n_reverse FROM d_h GROUP BY id",
    "minimizers": f"WITH {_D} SELECT id AS contig_id, hash, pos, strand FROM d_m",
    "read_minimizers": f"WITH {_B} SELECT id AS read_id, hash, pos, strand FROM b_m",
    "shard_histogram": f"WITH {_D} SELECT hash & 4095 AS shard_id, count(*) AS n_hits FROM d_m GROUP BY 1",
    "shard_plan": f"WITH {_B} SELECT hash & 4095 AS shard_id, count(*) AS n_seeds, count(DISTINCT id) AS n_reads FROM b_m GROUP BY 1",
    "shard_worker_assignment": f"WITH {_B}, s AS (SELECT DISTINCT hash & 4095 AS shard_id FROM b_m) SELECT shard_id, CAST(least(3, floor((row_number() OVER (ORDER BY shard_id) - 1) / ceil((SELECT count(*) FROM s) / 4.0::DOUBLE))) AS BIGINT) AS worker FROM s",
    "index_stats": f"WITH {_D}, c AS (SELECT hash, count(*) AS n FROM d_m GROUP BY hash) SELECT CAST(coalesce(sum(n) FILTER (n <= 1000), 0) AS BIGINT) AS total_hits, count(*) FILTER (n <= 1000) AS distinct_seeds, CAST(coalesce(sum(n) FILTER (n > 1000), 0) AS BIGINT) AS capped_seed_hits FROM c",
    "index_directory": f"WITH {_INDEX}, c AS (SELECT hash & 4095 AS shard_id, hash, count(*) AS n FROM ix GROUP BY hash) SELECT shard_id, hash, CAST(coalesce(sum(n) OVER (PARTITION BY shard_id ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS hit_offset, n FROM c",
    "seed_anchors": f"WITH {_ANCHORS} SELECT read_id, q_pos, contig_id, ref_pos, hash, joint FROM an",
    "anchor_counts": f"WITH {_ANCHORS} SELECT read_id, contig_id, joint, count(*) AS n_anchors FROM an GROUP BY ALL HAVING count(*) >= 3",
    "anchor_spans": O.with_(*O.BASE, O.anchors("m", "b", "d"))
    + """ SELECT read_id, contig_id, joint, greatest(0, q0 - 14) - e AS q_start, q1 + 8 AS q_end, greatest(0, r0 - 14) - e AS ref_start, r1 + 8 AS ref_end, anchor_count, unique_anchors
          FROM (SELECT *, least(7, greatest(0, q0 - 14), greatest(0, r0 - 14)) AS e FROM (SELECT read_id, contig_id, joint, min(q_pos) AS q0, max(q_pos) AS q1, min(ref_pos) AS r0, max(ref_pos) AS r1,
                count(*) AS anchor_count, count(DISTINCT hash) AS unique_anchors FROM m_an GROUP BY ALL HAVING count(*) >= 2))""",
    "chain_dp": O.with_(*O.BASE, O.anchors("m", "b", "d"), O.scores("m", 1))
    + " SELECT read_id, contig_id, joint, unnest(rs) AS ref_pos, unnest(qs) AS q_pos, round(unnest(fs), 6) AS f, unnest(bs) - 1 AS back FROM m_dq",
    "sam_header": f"SELECT 1::BIGINT AS part, doc_id AS contig_id, '@SQ\tSN:doc' || doc_id || '\tLN:' || length({O.seq()}) AS value FROM documents UNION ALL SELECT 0, -1, '@HD\tVN:1.6\tSO:unsorted' UNION ALL SELECT 2, -1, '@PG\tID:strandweave\tPN:strandweave\tVN:0.1'",
    "sam_unmapped": f"SELECT item_id AS read_id, 'item' || item_id || '\t4\t*\t0\t0\t*\t*\t0\t0\t' || s || '\t' || repeat('I', length(s)) AS value FROM (SELECT item_id, {O.seq()} AS s FROM benchmark)",
    "cigar_parse": """WITH c AS (SELECT CAST(l_quantity AS BIGINT) AS a, l_orderkey AS m, l_linenumber AS i, l_suppkey AS d, l_partkey AS z, CASE WHEN l_linenumber % 2 = 0 THEN 'S' ELSE 'H' END AS o FROM lineitem)
        SELECT a || o || m || 'M' || i || 'I' || d || 'D' || z || 'S' AS cigar, count(*) AS n, max(a) AS q_start, max(CAST(CASE WHEN o = 'S' THEN a ELSE 0 END + m + i AS BIGINT)) AS q_end, max(CAST(m + d AS BIGINT)) AS ref_span, 6::BIGINT AS pos0 FROM c GROUP BY 1""",
    "spearman_prices": """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a,
        rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
        SELECT l_returnflag, round(corr(a, b), 6) AS spearman, count(*) AS n FROM r GROUP BY l_returnflag""",
    "average_ranks": "SELECT c_custkey, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0::DOUBLE AS rank FROM customer",
    "text_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
}
ORACLES["minimizers_sql"] = ORACLES["chunked_minimizers"] = ORACLES["minimizers"]
ORACLES["minimizers_lateral"] = ORACLES["read_minimizers"]
ORACLES["stored_anchors"] = f"WITH {_INDEX}, ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents), {_B} SELECT b_m.id AS read_id, b_m.pos AS q_pos, k AS contig_id, ix.pos AS ref_pos, ix.hash, xor(b_m.strand, ix.strand) AS joint FROM b_m JOIN ix USING (hash) JOIN ids ON ids.doc_id = ix.id"
ORACLES |= O.MAPPED
ORACLES |= {
    "reference_windows": f"""WITH s AS (SELECT doc_id AS contig_id, {O.seq()} AS s FROM documents), w AS (SELECT *, length(s) // 2 - 50 AS start, length(s) // 2 + 50 AS stop FROM s WHERE s <> '')
        SELECT contig_id, start, stop, s[greatest(start, 0) + 1:stop] AS bases FROM w""",
    "base_codes": r"""WITH w AS (SELECT doc_id, upper(unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))[1]) AS b FROM documents)
        SELECT doc_id, CASE b WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END::BIGINT AS code, count(*) AS n FROM w GROUP BY ALL""",
    "alternate_overlap": f"""WITH f AS ({O.MAPPED["secondary_fragments"]})
        SELECT a.read_id, a.fragment_index, a.alt_rank, round(greatest(0, least(a.q_end, o.q_end) - greatest(a.q_start, o.q_start)) / greatest(1, a.q_end - a.q_start)::DOUBLE, 6) AS overlap
        FROM f a JOIN f o ON a.read_id = o.read_id AND a.fragment_index = o.fragment_index AND o.alt_rank = 0""",
    "fasta_contigs": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS contig_id, 'doc' || doc_id AS name, length(s) AS length, md5(s) AS seq_md5 FROM (SELECT doc_id, {O.seq()} AS s FROM documents)",
    "fastq_reads": f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS read_id, 'item' || item_id AS name, md5(s) AS seq_md5, length(s) AS n_qual FROM (SELECT item_id, {O.seq()} AS s FROM benchmark)",
    "stored_manifest": f"SELECT (SELECT count(*) FROM documents) AS contigs, 4096::BIGINT AS shards, 15::BIGINT AS k, 10::BIGINT AS w, 1000::BIGINT AS freq_cap, total_hits, distinct_seeds, capped_seed_hits FROM ({ORACLES['index_stats']})",
    "run_summary": f"SELECT reads, mapped, unmapped, anchors, fragments FROM ({O.MAPPED['mapping_stats']})",
}
ORACLES["streamed_totals"] = ORACLES["run_summary"]

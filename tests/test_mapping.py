import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.functions import seeds as S
from strandweave.operators import anchors as A
from strandweave.operators import evaluate as E
from strandweave.operators import sam
from strandweave.operators.chain import chain_anchors, scored, scores
from strandweave.operators.refine import extension, refine_endpoints
from strandweave.operators.select import choose, select_fragments
from strandweave.params import Params
from strandweave.plans import catalog
from strandweave.plans.mapping import map_reads, map_to_sam

ANCHOR = "read_id long, q_pos long, contig_id long, ref_pos long, joint int, hash long"


def chains_of(spark, rows, **p):
    return chain_anchors(spark.createDataFrame(rows, ANCHOR), Params(**p)).collect()


def test_colinear_anchors_make_one_chain(spark):
    out = chains_of(spark, [(0, 30 * i, 0, 100 + 30 * i, 0, i) for i in range(10)])
    assert len(out) == 1 and out[0].anchor_count == 10 and out[0].unique_anchors == 10
    assert (out[0].q_start, out[0].q_end, out[0].ref_start, out[0].ref_end) == (0, 278, 86, 378)
    assert out[0].score == 150.0


def test_two_contigs_reverse_and_gaps(spark):
    rows = [(0, 30 * i, c, 1000 + 30 * i, 0, i) for c in (0, 1) for i in range(11)]
    assert sorted((c.contig_id, c.anchor_count) for c in chains_of(spark, rows)) == [(0, 11), (1, 11)]
    back = chains_of(spark, [(0, 200 - 25 * i, 0, 1000 + 25 * i, 1, i) for i in range(8)])
    assert [(c.joint, c.anchor_count) for c in back] == [(1, 8)]
    far = chains_of(spark, [(0, 30 * i + 12_000 * (i > 5), 0, 30 * i, 0, i) for i in range(12)])
    assert max(c.anchor_count for c in far) == 6


def test_chain_limits_ties_and_nulls(spark):
    assert len(chains_of(spark, [(0, 31 * (i % 7), 0, 400 * i, 0, i) for i in range(50)], top_k=3)) <= 3
    assert chains_of(spark, [(0, 5, 0, 5, 0, 1)]) == []
    same = [(0, 30 * i, 0, 30 * i, 0, None) for i in range(4)] + [(None, 1, 0, 1, 0, 1)]
    assert [(c.anchor_count, c.unique_anchors) for c in chains_of(spark, same)] == [(4, 4)]
    assert chains_of(spark, []) == []


def chain(q0, q1, r0, score, contig=0, n=10):
    return {"contig_id": contig, "q_start": q0, "q_end": q1, "ref_start": r0, "ref_end": r0 + q1 - q0, "score": score, "anchor_count": n, "unique_anchors": n}


def pick(chains, params):
    """The selection of some chains as dictionaries."""
    columns = [[c[k] for c in chains] for k in ("q_start", "q_end", "ref_start", "ref_end", "score", "anchor_count")]
    return [
        chains[c] | {"fragment_index": index, "alt_rank": rank, "is_primary": best and rank == 0, "is_supplementary": not best and rank == 0, "is_secondary": rank > 0, "f2": rival}
        for c, index, rank, best, rival in choose(*columns, params)
    ]


def test_selection():
    three = pick([chain(0, 100, 0, 70.0), chain(200, 300, 0, 50.0), chain(120, 180, 0, 40.0)], Params())
    assert [(x["q_start"], x["is_primary"], x["is_supplementary"]) for x in three] == [(0, True, False), (120, False, True), (200, False, True)]
    near = [chain(0, 100, 0, 70.0), chain(2, 98, 9000, 65.0)]
    assert len(pick(near, Params())) == 1 and pick(near, Params())[0]["f2"] == 65.0
    two = pick(near, Params(secondary=1))
    assert [(x["ref_start"], x["alt_rank"], x["is_secondary"], x["f2"]) for x in two] == [(0, 0, False, 65.0), (9000, 1, True, 0.0)]
    late = pick([chain(500, 600, 0, 90.0), chain(0, 100, 0, 30.0)], Params(min_score_ratio=0.0))
    assert [x["is_primary"] for x in late] == [False, True]
    assert pick([chain(0, 100, 0, 100.0, n=2), chain(0, 100, 0, 20.0)], Params()) == []
    assert pick([], Params()) == []


def test_mapq_cigar_and_flags(spark):
    def mapq(f1, f2, m):
        return spark.range(1).select(S.approximate_mapq(F.lit(f1), F.lit(f2), F.lit(m))).first()[0]

    assert mapq(0.0, 0.0, 9) == 0 and mapq(-1.0, 0.0, 9) == 0 and mapq(float("nan"), 0.0, 9) == 0
    assert mapq(100.0, 0.0, 30) == 60 and mapq(100.0, 95.0, 30) * 4 < mapq(100.0, 0.0, 30) and mapq(2.0, 0.0, 1) == 3
    rows = spark.createDataFrame([(30, 980, 0, 950, 1000, False), (30, 980, 0, 950, 1000, True), (0, 1000, 0, 1000, 1000, False), (50, 1000, 0, 950, 1000, False), (0, 800, 0, 800, 1000, False), (0, 10, 5, 5, 10, False)], "a long, b long, c long, d long, n long, s boolean")
    got = [r[0] for r in rows.select(S.cigar(*[F.col(c) for c in "abcdns"])).collect()]
    assert got == ["30S950M20S", "30H950M20H", "1000M", "50S950M", "800M200S", "*"]


def test_cigar_spans(spark):
    rows = spark.createDataFrame([("30S950M20S",), ("30H950M20H",), ("10M5I3D2N4=1X7S",), ("*",)], "c string")
    assert [tuple(r) for r in rows.select(*S.cigar_spans(F.col("c"))).collect()] == [(30, 980, 950), (30, 950, 950), (0, 20, 20), (0, 0, 0)]


def test_extension():
    grow = lambda *pairs: extension(*[pd.Series(list(x), dtype=object) for x in zip(*pairs, strict=True)], 10, 0.7).tolist()
    assert grow(("ACGT" * 5, "ACGT" * 5), ("TCGT", "ACGT"), ("AAAAAAAAAACCCCCCCCCC", "AAAAAAAAAAGGGGGGGGGG")) == [20, 0, 13]
    assert grow(("ACG", "ACGT"), (None, "A"), ("", ""), ("A", None), ("A", "A")) == [0, 0, 0, 0, 1]
    rng = random.Random(9)
    pairs = [tuple("".join(rng.choice("AC") if rng.random() < 0.3 else "A" for _ in range(n)) for _ in range(2)) for n in range(1, 41) for _ in range(5)]

    def plain(a, b):
        hits = []
        for x, y in zip(a, b, strict=True):
            hits.append(x == y)
            if sum(hits[-10:]) / len(hits[-10:]) < 0.7:
                return len(hits) - 1
        return len(hits)

    assert grow(*pairs) == [plain(a, b) for a, b in pairs]


def test_buckets_of_one_size_are_scored_together():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 9, 300)
    edges = np.append(0, np.cumsum(sizes))
    q, joint = rng.integers(0, 400, edges[-1]), np.repeat(rng.integers(0, 2, 300), sizes)
    r = np.concatenate([np.sort(rng.integers(0, 400, n)) for n in sizes])
    f, back = scored(q, r, joint, edges, Params())
    for lo, hi in itertools.pairwise(edges.tolist()):
        one = scores(q[lo:hi], r[lo:hi], int(joint[lo]), Params())
        assert f[lo:hi].tolist() == one[0].tolist() and back[lo:hi].tolist() == one[1].tolist()


def test_refinement_both_strands(spark):
    rng = random.Random(3)
    ref = "".join(rng.choice("ACGT") for _ in range(60))
    contigs = spark.createDataFrame([(0, ref)], "contig_id long, seq string")
    reads = spark.createDataFrame([(0, ref)], "read_id long, seq string")
    flipped = reads.select("read_id", S.reverse_complement(F.col("seq")).alias("seq"))
    one = spark.createDataFrame([(0, 0, 0, 20, 40, 20, 40)], "read_id long, contig_id long, joint int, q_start long, q_end long, ref_start long, ref_end long")
    assert tuple(refine_endpoints(one, reads, contigs).first())[3:] == (0, 60, 0, 60)
    assert tuple(refine_endpoints(one, reads, contigs, Params(max_ext=5)).first())[3:] == (15, 45, 15, 45)
    back = refine_endpoints(one.withColumn("joint", F.lit(1)), flipped, contigs).first()
    assert tuple(back)[3:] == (0, 60, 0, 60)
    lost = refine_endpoints(one.withColumn("contig_id", F.lit(9).cast("long")), reads, contigs).first()
    assert tuple(lost)[3:] == (20, 40, 20, 40)


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(42)
    return ["".join(rng.choice("ACGT") for _ in range(20_000)) for _ in range(2)]


def flip(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def tables(spark, genome):
    contigs = spark.createDataFrame([(i, f"chr{i + 1}", len(s), s) for i, s in enumerate(genome)], "contig_id long, name string, length long, seq string")
    cuts = [(i, genome[0][100 + 150 * i : 400 + 150 * i], 0) for i in range(50)] + [(50 + i, flip(genome[1][100 + 150 * i : 400 + 150 * i]), 1) for i in range(50)]
    reads = spark.createDataFrame([(i, f"r{i}", s, "I" * 300) for i, s, _ in cuts], "read_id long, name string, seq string, qual string")
    truth = spark.createDataFrame([(i, j, 100 + 150 * (i % 50), j) for i, _, j in cuts], "read_id long, contig_id long, start long, joint int")
    return contigs, reads, truth


@pytest.mark.parametrize("refine", [False, True])
def test_end_to_end(spark, genome, refine):
    contigs, reads, truth = tables(spark, genome)
    m = map_reads(reads, contigs, Params(refine=refine))
    row = E.truth_accuracy(m.placements, truth).first()
    assert row.n_placed >= 95 and row.n_right >= 95 and row.within_10 >= 90
    clamped = map_reads(reads, contigs, Params(refine=refine, clamp=True)).placements
    assert clamped.agg(F.max("q_end")).first()[0] <= 300
    stats = E.mapping_stats(reads, m.placements, m.anchors, m.seeds, 12).first()
    assert stats.reads == 100 and stats.mapped + stats.unmapped == 100 and stats.fragments >= stats.mapped


def test_sam_of_split_and_unmapped_reads(spark, genome):
    contigs, _, _ = tables(spark, genome)
    split = genome[0][1000:2000] + flip(genome[1][5000:6000])
    reads = spark.createDataFrame([(0, "split", split, "I" * 2000), (1, "none", "ACGTN" * 30, "J" * 150)], "read_id long, name string, seq string, qual string")
    lines = [r.value.split("\t") for r in map_to_sam(reads, contigs, Params(refine=True)).orderBy("read_id", "fragment_index").collect()]
    assert len(lines) == 3
    assert sorted((x[1], x[2]) for x in lines[:2]) in ([("0", "chr1"), ("2064", "chr2")], [("16", "chr2"), ("2048", "chr1")])
    assert abs(int(lines[0][3]) - 1001) <= 10 and abs(int(lines[1][3]) - 5001) <= 10
    assert lines[0][11] == lines[1][11] and lines[0][11].startswith("SA:Z:chr1,") and lines[0][11].count(";") == 2
    assert sorted(x[9] == "*" for x in lines[:2]) == [False, True]
    assert lines[2] == ["none", "4", "*", "0", "0", "*", "*", "0", "0", "ACGTN" * 30, "J" * 150]
    with pytest.raises(Exception, match="needs a name"):
        map_to_sam(reads.withColumn("name", F.lit("")), contigs).collect()


def test_unplaced_reads_are_those_the_mapping_leaves(spark, tmp_path):
    rng = random.Random(5)
    make = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(80))
    docs, alien = [make() for _ in range(3)], make()
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [docs[1][70:490], alien, None, docs[2][:350]]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.read_id, r.value) for r in catalog.sam_unplaced(spark, str(tmp_path)).collect())
    assert [k for k, _ in got] == [1, 2]
    assert got == sorted((r.read_id, r.value) for r in catalog.sam_body(spark, str(tmp_path)).collect() if r.value.split("\t")[1] == "4")


def test_diff_pairs_greedily(spark):
    cols = "name string, ref_name string, reverse boolean, pos0 long, mapq int, q_start long, cigar string, unmapped boolean"
    ours = spark.createDataFrame([("a", "c", False, 100, 60, 0, "9M", False), ("a", "c", False, 105, 50, 5, "9M", False), ("b", "*", False, -1, 0, 0, "*", True), ("d", "c", True, 7, 9, 0, "9M", False)], cols)
    golden = spark.createDataFrame([("a", "c", False, 104, 55, 0, "9M", False), ("a", "c", False, 150, 40, 0, "9M", False), ("b", "c", False, 9, 9, 0, "9M", False), ("d", "c", False, 7, 9, 0, "9M", False)], cols)
    pairs = sorted((r.pos_ours, r.pos_golden) for r in E.pair_records(ours, golden).collect())
    assert pairs == [(100, 104), (105, 150)]
    row = E.diff_sam(ours, golden).first()
    assert (row.compared, row.matched, row.match_rate, row.n_both, row.n_any) == (2, 1, 0.5, 2, 3)
    assert row.mapq_rmse == 5.0 and row.mapq_spearman == 0.0
    assert E.diff_sam(ours.where("false"), golden.where("false")).first().jaccard == 0.0


def test_average_ranks_window_distinct_values(spark):
    """Ties and nulls; the rows themselves pass no window, so it reads one row per distinct value."""
    rows = [(0, "b"), (1, "a"), (2, None), (3, "b"), (4, None), (5, "b")]
    frame = spark.createDataFrame(rows, "id long, v string")
    out = E.average_ranks(frame, "v")
    assert {r.id: r["rank"] for r in out.collect()} == {2: 1.5, 4: 1.5, 1: 3.0, 0: 5.0, 3: 5.0, 5: 5.0}
    grouped = E.average_ranks(frame.withColumn("g", F.col("id") % 2), "v", by=["g"])
    assert {r.id: r["rank"] for r in grouped.collect()} == {2: 1.5, 4: 1.5, 0: 3.0, 1: 1.0, 3: 2.5, 5: 2.5}
    plan = catalog.average_ranks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and "Aggregate" in plan[plan.index("Window ") :].split("\n")[1]


def test_cut_reads_from_every_contig(spark, genome):
    sizes = [0, 10, 50, 300, 301, 400, 401, 900]
    contigs = spark.createDataFrame([(i, f"c{i}", n, genome[0][2000 * i : 2000 * i + n]) for i, n in enumerate(sizes)], "contig_id long, name string, length long, seq string")
    reads, truth = catalog.cut_reads(contigs)
    seqs, starts = ({r.read_id: r for r in x.collect()} for x in (reads, truth))
    for i, n in enumerate(sizes):
        s = genome[0][2000 * i + starts[i].start :][: min(n, 300)]
        assert len(s) == len(seqs[i].qual) and seqs[i].seq == (flip(s) if i % 2 else s) and starts[i].start + len(s) <= n
    assert starts[7].start == 37 * 7 % 600
    row = E.truth_accuracy(map_reads(reads, contigs, Params()).placements, truth).first()
    assert row.n_reads == len(sizes) and row.n_placed == row.n_right == 6


def test_contacts(spark):
    rows = [(0, 0, 0, 100), (0, 1, 1, 500), (1, 0, 1, 500), (1, 1, 0, 100), (2, 0, 0, 100), (2, 1, 0, 300), (3, 0, 0, 0), (3, 1, 0, 9000)]
    p = spark.createDataFrame(rows, "read_id long, fragment_index int, contig_id long, ref_start long")
    p = p.select("*", F.lit(False).alias("is_secondary"), F.lit(100.0).alias("f1"), F.lit(0.0).alias("f2"), F.lit(10).alias("m"))
    assert tuple(E.contact_summary(E.contacts(p)).first()) == (3, 1, 1, 1, 0.5)


def test_planner(spark):
    seeds = spark.createDataFrame([(0, 16), (0, 17), (1, 33), (1, 55)], "read_id long, hash long")
    assert sorted(map(tuple, A.shard_plan(seeds, Params(shard_bits=3)).collect())) == [(0, 1, 1), (1, 2, 2), (7, 1, 1)]
    shards = spark.range(8).select(F.col("id").alias("shard_id"))
    assert [r.worker for r in A.assign_workers(shards, 4).orderBy("shard_id").collect()] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert [r.worker for r in A.assign_workers(shards.where("shard_id < 5"), 4).orderBy("shard_id").collect()] == [0, 0, 1, 1, 2]


def test_bucketed_index_joins_without_exchange(spark, genome):
    from strandweave.operators.index import build_index, write_index

    contigs, reads, _ = tables(spark, genome)
    write_index(build_index(contigs), "seed_index_test", 4)
    other = A.query_seeds(reads).repartition(4, "hash")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.seed_anchors(other, spark.table("seed_index_test"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE seed_index_test")
    assert "ENSURE_REQUIREMENTS" not in plan


def test_sam_header_and_select_schema(spark, genome):
    contigs, reads, _ = tables(spark, genome)
    head = [r.value for r in sam.sam_header(contigs).orderBy("part", "contig_id").collect()]
    assert head[0] == "@HD\tVN:1.6\tSO:unsorted" and head[1] == "@SQ\tSN:chr1\tLN:20000" and head[-1].startswith("@PG")
    assert select_fragments(map_reads(reads.limit(0), contigs).chains).count() == 0


def test_repeats_by_place_equal_the_plain_recurrence():
    """A large bucket with many anchors at each place, on both strands, in any slices, with and without the table of gains."""
    from strandweave.operators import chain

    rng = np.random.default_rng(5)
    q = rng.integers(0, 40, 1600) * 9 + 14
    r = np.repeat(np.arange(100) * 7, 16) + 14
    q, r = np.unique(np.stack([r, q], 1), axis=0)[:, ::-1].T
    assert len(q) > chain.LARGE and len(q) >= chain.DENSE * len(np.unique(r))
    for p in (Params(), Params(max_gap=90), Params(max_drift=0), Params(max_drift=5000)):
        for joint in (0, 1):
            f, back = scores(q, r, joint, p)
            got = scored(q, r, np.full(len(q), joint), np.array([0, len(q)]), p)
            assert (got[0] == f).all() and (got[1] == back).all()


def test_buckets_too_small_for_a_placement_never_change_one(spark):
    """A pair of anchors that outscores a longer chain: the chain is placed with and without the pair, and only all chains show the pair."""
    from strandweave.operators.chain import least_anchors
    from strandweave.operators.select import select_fragments

    p = Params()
    rows = [(1, q, 7, q + 5, 0, q) for q in (20, 50)] + [(1, q, 8, 5 * q, 0, q) for q in (20, 30, 40)] + [(2, 20, 7, 30, 0, 1)]
    anchors = spark.createDataFrame(rows, ANCHOR)
    few, every = chain_anchors(anchors, p, least_anchors(p), members=False), chain_anchors(anchors, p)
    assert least_anchors(p) == 3 and {x.contig_id for x in few.collect()} == {8} and {x.contig_id for x in every.collect()} == {7, 8}
    assert [x.asDict() for x in select_fragments(few, p).collect()] == [x.asDict() for x in select_fragments(every, p).collect()]
    assert least_anchors(Params(min_score_ratio=0.6)) == 2 and least_anchors(Params(min_anchors=1)) == 2


def test_groups_come_together(spark):
    """Many small groups in many Arrow batches reach the work in one call."""
    from strandweave.operators._groups import per_group

    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        frame = spark.range(1000).selectExpr("id div 4 AS k", "id AS v")
        count = lambda rows, bounds: pa.record_batch([pa.array([len(bounds) - 1]), pa.array([rows.num_rows])], ["groups", "n"])
        for together, least, most in ((0, 80, 250), (200, 5, 5), (1 << 20, 1, 1)):
            got = per_group(frame, "k", ["k"], count, "groups long, n long", together).collect()
            assert sum(x.n for x in got) == 1000 and sum(x.groups for x in got) == 250
            assert least <= len(got) <= most
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", parts)

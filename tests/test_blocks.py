"""Placements made of pairs of blocks are those of the join by hash, and no anchors leave a task."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandweave.operators import blocks as B
from strandweave.operators.index import seed_counts, seed_hits
from strandweave.params import Params
from strandweave.plans import catalog
from strandweave.plans import mapping as M


def flip(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def tables(spark):
    """Contigs of few words, of which some come again and again, with two rows of one id, two without, and short ones; reads of one and of two pieces, with a repeated id, null and none."""
    rng = random.Random(8)
    words = ["".join(rng.choice("ACGT") for _ in range(rng.randint(8, 40))) for _ in range(60)]
    make = lambda n: "".join(rng.choice(words) if rng.random() < 0.7 else "".join(rng.choice("ACGTN") for _ in range(20)) for _ in range(n))
    seqs = [make(rng.randint(5, 60)) for _ in range(30)] + [words[0] * 40, "", "ACGT", None]
    ids = [*range(len(seqs))]
    ids[5] = ids[25] = 3
    ids[8] = ids[9] = None
    contigs = spark.createDataFrame(list(zip(ids, seqs)), "contig_id long, seq string").selectExpr("contig_id", "concat('c', contig_id) AS name", "coalesce(length(seq), 0L) AS length", "seq").repartition(5)
    cut = lambda s, n: (lambda a: s[a : a + n])(rng.randrange(max(1, len(s) - n)))
    pieces = [cut(seqs[rng.randrange(30)], rng.randint(30, 300)) for _ in range(80)]
    reads = [a + flip(b) if k % 3 else flip(a) for k, (a, b) in enumerate(zip(pieces, pieces[1:]))] + [seqs[30][:600], None, ""]
    names = [*range(100, 100 + len(reads))]
    names[7] = names[40]
    names[11] = None
    return contigs, spark.createDataFrame(list(zip(names, reads)), "read_id long, seq string")


@pytest.mark.parametrize("change", [{}, {"freq_cap": 40, "secondary": 3, "min_score_ratio": 0.8}, {"k": 20, "min_anchors": 2}])
def test_pairs_of_blocks_give_the_same_placements(spark, monkeypatch, change):
    contigs, reads = tables(spark)
    p = Params(**change)
    want = M.map_reads(reads, contigs, p).placements
    rows = sorted(want.collect())
    assert len(rows) > 60
    assert sorted(M.place_reads(reads, contigs, p).select(*want.columns).collect()) == rows
    made = []
    monkeypatch.setattr(M, "block_chains", lambda hits, seeds, *x: made.append((hits.count(), seeds.count())) or B.block_chains(hits, seeds, *x))
    for name, size in (("HITS", 300), ("SEEDS", 200), ("TOGETHER", 100), ("SENT", 50)):
        monkeypatch.setattr(B, name, size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = M.place_reads(reads, contigs, p).select(*want.columns).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == rows and min(made[0]) > 3
    monkeypatch.setattr(M, "BLOCK_BASES", 1000)  # contigs too long for blocks
    assert sorted(M.place_reads(reads, contigs, p).select(*want.columns).collect()) == rows and len(made) == 1


def test_the_cap_counts_all_blocks(spark, monkeypatch):
    contigs, _ = tables(spark)
    for p in (Params(freq_cap=3), Params(freq_cap=20), Params(freq_cap=40)):
        want = {x.hash for x in seed_counts(seed_hits(contigs, p)).where(f"n > {p.freq_cap}").collect()}
        for size, few in ((1 << 21, 1 << 22), (300, 1 << 22), (300, 0)):
            monkeypatch.setattr(B, "HITS", size)
            monkeypatch.setattr(B, "FEW", few)
            numbered = contigs.selectExpr("monotonically_increasing_id() AS contig_id", "seq")
            assert {x.hash for x in B.over_cap(B.hit_blocks(numbered, p), p).collect()} == want and want


def test_packed_arrays():
    for x in (np.arange(5, dtype=np.uint32) << 20, np.zeros(0, np.uint64), np.array([-1, 7, 1 << 60])):
        assert B.unpack(pa.py_buffer(B.pack(x)), x.dtype.type).tolist() == x.tolist()
    assert B._sorted(np.array([1 << 62, 3, 3, 0]), np.array([0, 9, 1 << 40, 5])).tolist() == [3, 1, 2, 0]


@pytest.mark.parametrize("name", ["contacts", "truth_accuracy"])
def test_no_anchors_are_joined_or_shuffled(spark, name, monkeypatch):
    """Anchors were a table of rows, joined by hash and shuffled by read: 3.6 times the input for ``contacts``, 1.8 times for ``truth_accuracy``."""
    plans = []
    monkeypatch.setattr(M, "select_fragments", lambda chains, p, real=M.select_fragments: plans.append(chains._jdf.queryExecution().optimizedPlan().toString()) or real(chains, p))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "Join Cross" in plans[0] and "RepartitionByExpression" not in plans[0] and "ref_pos" not in plans[0]

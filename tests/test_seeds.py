import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.functions import seeds as S
from strandweave.operators import index as I
from strandweave.operators import minimizers as M
from strandweave.params import Params


def model_hash(x, k):
    m = (1 << 2 * k) - 1
    x = (~x + (x << 21)) & m
    x ^= x >> 24
    x = (x + (x << 3) + (x << 8)) & m
    x ^= x >> 14
    x = (x + (x << 2) + (x << 4)) & m
    x ^= x >> 28
    return (x + (x << 31)) & m


def model_minimizers(seq, k, w):
    code = {"A": 0, "C": 1, "G": 2, "T": 3}
    out, run = [], []
    for pos in range(k - 1, len(seq)):
        kmer = seq[pos - k + 1 : pos + 1]
        if any(b not in code for b in kmer):
            run = []
            continue
        fwd = rev = 0
        for b in kmer:
            fwd = fwd * 4 + code[b]
        for b in reversed(kmer):
            rev = rev * 4 + 3 - code[b]
        run.append((model_hash(min(fwd, rev), k), pos, int(rev < fwd)))
        if len(run) >= w:
            h, neg, strand = min((h, -p, s) for h, p, s in run[-w:])
            out.append((h, -neg, strand))
    return sorted(set(out), key=lambda x: x[1])


@pytest.mark.parametrize("k", [5, 15, 28])
def test_hash_agrees_in_all_forms(spark, k):
    rng = random.Random(k)
    xs = [0, (1 << 2 * k) - 1, *[rng.randrange(1 << 2 * k) for _ in range(300)]]
    want = [model_hash(x, k) for x in xs]
    assert M.mix_seed(np.array(xs, np.uint64), k).tolist() == want
    rows = S.with_seed_hash(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x long"), "x", k).orderBy("i")
    assert [r.hash for r in rows.collect()] == want
    one = spark.createDataFrame([(x,) for x in xs[:5]], "x long").select(S.seed_hash(F.col("x"), k).alias("h"))
    assert [r.h for r in one.collect()] == want[:5]
    assert len(set(want)) == len(set(xs)) and max(want) < 1 << 2 * k


@pytest.mark.parametrize(("k", "w"), [(5, 4), (15, 10), (3, 1), (28, 3)])
def test_minimizers_match_the_model(spark, k, w):
    rng = random.Random(w)
    seqs = ["", "ACGT", "A" * 30 + "N" + "C" * 30, "".join(rng.choice("ACGTN" + "ACGT" * 9) for _ in range(900)), "ACGT" * 20, None, "ACG" * 7]
    frame = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    want = sorted((i, *m) for i, s in enumerate(seqs) for m in model_minimizers(s or "", k, w))
    p = Params(k=k, w=w)
    assert sorted(map(tuple, M.minimizers(frame, p).collect())) == want
    assert sorted(map(tuple, M.minimizers_sql(frame, p).collect())) == want


def model_kmers(seq, k):
    """(pos, hash, strand) of every k-mer without a break."""
    found = []
    for i in range(len(seq) - k + 1):
        kmer = seq[i : i + k]
        if set(kmer) <= set("ACGT"):
            other = kmer[::-1].translate(str.maketrans("ACGT", "TGCA"))
            low = min(kmer, other)
            found.append((i + k - 1, model_hash(int(low.translate(str.maketrans("ACGT", "0123")), 4), k), int(other < kmer)))
    return found


@pytest.mark.parametrize("k", [1, 4, 15, 16, 28])
def test_kmers_and_their_sums_match_the_model(spark, k, monkeypatch):
    rng = random.Random(k)
    seqs = ["", "ACGT", None, "N" * 40, "A" * 31, *["".join(rng.choice("ACGTN" + "ACGT" * 20) for _ in range(n)) for n in (k, 30, 31, 32, 700)]]
    frame = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string").coalesce(1)
    rows = {i: model_kmers(s or "", k) for i, s in enumerate(seqs)}
    assert sorted(map(tuple, M.kmers(frame, Params(k=k)).collect())) == sorted((i, *r) for i, rs in rows.items() for r in rs)
    if k > 16:
        frame = frame.where(F.length("seq") < 100)  # longer sums pass a long
        rows = {i: rs for i, rs in rows.items() if len(seqs[i] or "") < 100}
    want = sorted((i, len(rs), sum(r[1] for r in rs), max(r[1] for r in rs), sum(r[2] for r in rs)) for i, rs in rows.items() if rs)
    monkeypatch.setattr(M, "SLICE", 64)
    assert sorted(map(tuple, M.kmer_sums(frame, Params(k=k)).collect())) == want


def test_sql_minimizers_need_no_sort_and_no_shuffle(spark):
    """A task once held and sorted all k-mers of its texts: a row each, a hundred times the text."""
    frame = spark.createDataFrame([(7, "ACGT" * 99)], "seq_id long, seq string")
    text = M.minimizers_sql(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Sort", "Exchange", "Window", "Python"))


@pytest.mark.parametrize(("k", "w"), [(28, 255), (26, 255), (15, 1), (1, 7)])
def test_minimizers_agree_at_the_ends_of_their_ranges(spark, k, w):
    rng = random.Random(k + w)
    frame = spark.createDataFrame([(1, "".join(rng.choice("ACGT") for _ in range(1500))), (2, "ACGT" * 200 + "N" + "A" * 400)], "seq_id long, seq string")
    p = Params(k=k, w=w)
    assert sorted(map(tuple, M.minimizers_sql(frame, p).collect())) == sorted(map(tuple, M.minimizers(frame, p).collect())) != []


def test_long_sequences_cross_pieces(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(5000))
    frame = spark.createDataFrame([(7, seq)], "seq_id long, seq string")
    want = [(7, *m) for m in model_minimizers(seq, 15, 10)]
    assert sorted(map(tuple, M.minimizers_sql(frame).collect())) == sorted(want) == sorted(map(tuple, M.minimizers(frame).collect()))


def test_hashes_of_reverse_complement(spark):
    seq = "ACGTTGCAAC" * 4
    both = spark.createDataFrame([(0, seq)], "seq_id long, seq string")
    both = both.unionByName(both.select(F.lit(1).cast("long").alias("seq_id"), S.reverse_complement(F.col("seq")).alias("seq")))
    rows = M.minimizers(both, Params(k=5, w=4)).collect()
    assert {r.hash for r in rows if r.seq_id == 0} == {r.hash for r in rows if r.seq_id == 1}


def test_known_genome_counts(spark):
    """A public recipe: four contigs of 250,000 uniform bases from a fixed seed have these index totals."""
    rng = random.Random(42)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(250_000))) for i in range(4)]
    hits = I.seed_hits(spark.createDataFrame(rows, "contig_id long, seq string"))
    assert tuple(I.index_stats(hits).first()) == (186_624, 186_501, 0)


def test_scalar_functions(spark):
    one = spark.createDataFrame([("ACGTNxacgt", 12345, 1, 5)], "s string, pos long, strand long, flags long")
    row = one.select(S.reverse_complement(F.col("s")).alias("rc"), S.base_code(F.lit("g")).alias("g"), S.base_code(F.lit("N")).alias("n"), S.pack_hit(F.col("pos"), F.col("strand"), F.col("flags")).alias("w"), S.shard_file(F.lit(37)).alias("f")).first()
    assert (row.rc, row.g, row.n, row.f) == ("acgtNNACGT", 2, 4, "seed-shard-0037.bin")
    back = spark.createDataFrame([(row.w,)], "w long").select(*S.unpack_hit(F.col("w"))).first()
    assert tuple(back) == (12345, 1, 5)
    entry = one.select(S.pack_entry(F.lit(1000), F.lit(3)).alias("e"))
    assert tuple(entry.select(*S.unpack_entry(F.col("e"))).first()) == (1000, 3)
    with pytest.raises(ValueError, match="shard bits"):
        S.shard_id(F.col("pos"), 31)
    with pytest.raises(ValueError, match="k must"):
        Params(k=29)


def test_projection_keeps_breaks(spark):
    row = spark.createDataFrame([("Ab c.\nZ9é",)], "t string").select(S.project_dna(F.col("t")).alias("s")).first()
    assert row.s == "ACGNCNN"


def test_frequency_cap_and_directory(spark):
    hits = spark.createDataFrame([(h, 0, p, 0) for h, n in ((16, 3), (17, 1), (33, 2), (48, 5)) for p in range(n)], "hash long, contig_id long, pos long, strand int")
    p = Params(freq_cap=3, shard_bits=4)
    assert tuple(I.index_stats(hits, p).first()) == (6, 3, 5)
    index = I.capped(hits, p).withColumn("shard_id", S.shard_id(F.col("hash"), 4))
    assert sorted(map(tuple, I.directory(index).collect())) == [(0, 16, 0, 3), (1, 17, 0, 1), (1, 33, 1, 2)]
    files = spark.createDataFrame([("b", 2, "y"), ("a", 1, "x")], "path string, size long, sha256 string")
    text = I.manifest(I.index_stats(hits, p), spark.createDataFrame([(0,)], "contig_id long"), files, 'ref"1', p).first().value
    assert '"cappedSeedHits":5' in text and '"hashFn":"' in text and '"seedSchemeParams":{"freqCapPerHash":3}' in text
    assert '"totalHits":6' in text and '"distinctSeeds":3' in text and text.index('"path":"a"') < text.index('"path":"b"') and '\\"1' in text


def test_overlap_fraction(spark):
    rows = spark.createDataFrame([(0, 10, 5, 20), (0, 10, 20, 30), (5, 5, 0, 9), (0, 10, 0, 10)], "a long, b long, c long, d long")
    assert [r[0] for r in rows.select(S.overlap_fraction(*[F.col(c) for c in "abcd"])).collect()] == [0.5, 0.0, 0.0, 1.0]

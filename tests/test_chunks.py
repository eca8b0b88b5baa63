"""Long sequences in chunks: the same results whatever the size of a chunk, a block or a line."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import chunks as C
from strandweave.operators import index as I
from strandweave.operators import minimizers as M
from strandweave.params import Params
from strandweave.plans.mapping import map_reads
from strandweave.sources import sequences as Q
from tests.test_seeds import model_minimizers

BLANKS = " \t\r\v\f"


def some_sequences():
    rng = random.Random(12)
    out = ["", "ACGT", None, "ACGTTGCAACGGATCCATGCATTG", "AC" * 700, "A" * 300 + "N" + "C" * 300, "N" * 80]
    out += ["".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(n)) for n in (23, 24, 25, 49, 50, 51, 99, 100, 101, 1000, 4321)]
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "w"), [(15, 10), (5, 4), (3, 1), (4, 60)])
def test_minimizers_do_not_depend_on_pieces(spark, monkeypatch, k, w):
    p = Params(k=k, w=w)
    frame = spark.createDataFrame(some_sequences(), "seq_id long, seq string")
    want = sorted((i, *m) for i, s in some_sequences() for m in model_minimizers(s or "", k, w))
    for piece in (None, 50, 1000):
        assert sorted(map(tuple, M.minimizers(frame, p, piece=piece).collect())) == want
    table = C.cut(frame, "seq_id", "seq", 64)
    assert sorted(map(tuple, M.chunk_minimizers(table, p, "seq_id").collect())) == want
    monkeypatch.setattr(M, "SLICE", 37)  # a sequence is worked on in slices
    assert sorted(map(tuple, M.minimizers(frame, p).collect())) == want


def test_one_contig_uses_all_tasks(spark):
    rng = random.Random(1)
    frame = spark.createDataFrame([(0, "".join(rng.choice("ACGT") for _ in range(20_000)))], "seq_id long, seq string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert M.minimizers(frame, piece=500).select(F.spark_partition_id()).distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def model_fasta(text):
    """The scan a character at a time."""
    out, in_header, drain = [], False, False
    for c in text:
        if drain:
            drain = c != "\n"
        elif c == ">":
            out.append(["", ""])
            in_header = True
        elif in_header:
            if c in "\n\r":
                in_header = False
            elif c in " \t":
                if out[-1][0]:
                    in_header, drain = False, True
            else:
                out[-1][0] += c
        elif c not in BLANKS + "\n" and out:
            out[-1][1] += c.upper()
    return [tuple(x) for x in out]


def random_fasta(rng, lines):
    words = [">", "> ", ">a", ">b c>d", ">\t e", "ACGT", "acgtn", "AC GT", "\r", "x>y\rGG", ">p>q", "", "\v\f", "GATTACA" * 9]
    return "junk" * rng.randint(0, 1) + "\n".join("".join(rng.choice(words) for _ in range(rng.randint(0, 3))) if rng.random() < 0.3 else "".join(rng.choice("ACGTacgt") for _ in range(60)) for _ in range(lines)) + "\n" * rng.randint(0, 2)


def test_fasta_by_lines_is_the_scan(spark, tmp_path):
    rng = random.Random(6)
    texts = [random_fasta(rng, n) for n in (0, 1, 5, 400, 900)] + [">one\n" + "ACGTN" * 3000, "no contig at all\nACGT\n"]
    want = []
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.fa").write_bytes(t.encode())
        want += model_fasta(t)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        whole = Q.read_fasta(spark, str(tmp_path / "*.fa")).orderBy("contig_id").collect()
        fasta = Q.read_fasta_chunks(spark, str(tmp_path / "*.fa"), size=64, piece=50)
        chunks, names = fasta.chunks.collect(), fasta.names.orderBy("contig_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r) for r in whole] == [(i, n, len(s), s) for i, (n, s) in enumerate(want)] and len(want) > 100
    assert [tuple(r) for r in names] == [(i, n, len(s)) for i, (n, s) in enumerate(want)]
    table = C.cut(spark.createDataFrame([(i, s) for i, (_, s) in enumerate(want)], "contig_id long, seq string"), size=64).collect()
    assert sorted(map(tuple, chunks)) == sorted(map(tuple, table))


def test_a_chunk_knows_its_surroundings(spark):
    rows = C.cut(spark.createDataFrame([(3, "ACGTACGTAC"), (4, ""), (5, None)], "contig_id long, seq string"), size=4, halo=3).orderBy("chunk").collect()
    assert [tuple(r) for r in rows] == [(3, 0, 0, 0, 4, "ACGTACG"), (3, 1, 4, 1, 4, "TACGTAC"), (3, 2, 8, 1, 2, "TAC")]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_windows_are_put_together_over_borders(spark, size):
    rng = random.Random(size)
    seqs = {i: "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((1, 64, 65, 500))}
    table = C.cut(spark.createDataFrame(list(seqs.items()), "contig_id long, seq string"), size=size, halo=5)
    asked = [(rng.randrange(5), a := rng.randint(-20, 520), a + rng.randint(-2, 150), "x") for _ in range(200)]
    got = {tuple(r)[:4]: r.bases for r in C.reference_windows(spark.createDataFrame(asked + asked[:9], "contig_id long, start long, end long, lead string"), table, size).collect()}
    want = {(c, a, b, x): t for c, a, b, x in asked if (t := seqs.get(c, "")[max(a, 0) : max(b, 0)])}
    assert got == want and any(a // size != b // size for _, a, b, _ in want) or size > 500


def test_mapping_does_not_depend_on_chunks(spark):
    rng = random.Random(21)
    genome = ["".join(rng.choice("ACGT") for _ in range(6000)) for _ in range(2)]
    genome[1] = genome[1][:700] + "N" * 30 + genome[1][730:]
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    cuts = [genome[i % 2][max(0, 211 * i - 40) : 211 * i + 260] for i in range(27)]
    cuts = [flip(c) if i % 3 == 0 else c for i, c in enumerate(cuts)]
    noisy = ["".join(rng.choice("ACGT") if rng.random() < 0.03 else b for b in c) for c in cuts]
    contigs = spark.createDataFrame([(i, f"c{i}", len(s), s) for i, s in enumerate(genome)], "contig_id long, name string, length long, seq string")
    reads = spark.createDataFrame([(i, f"r{i}", s, None) for i, s in enumerate(noisy)], "read_id long, name string, seq string, qual string")
    p = Params(refine=True, clamp=True)
    want = sorted(map(repr, map_reads(reads, contigs, p).placements.collect()))
    assert len(want) >= 25
    for size in (64, 1 << 20):
        table = C.cut(contigs, size=size)
        got = map_reads(reads, contigs.drop("seq"), p, None, table, size).placements  # no sequence is there to be joined
        assert sorted(map(repr, got.collect())) == want
    plain = sorted(map(repr, map_reads(reads, contigs, Params()).placements.collect()))
    assert plain != want and I.seed_hits(None, p, C.cut(contigs, size=64)).count() == I.seed_hits(contigs, p).count()

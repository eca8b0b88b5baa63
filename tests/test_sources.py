import json
import random
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strandweave.functions.table import register_minimizers
from strandweave.operators import index as I
from strandweave.operators import minimizers as M
from strandweave.operators.sam import sam_header
from strandweave.params import Params
from strandweave.plans import reference as R
from strandweave.plans.mapping import map_to_sam
from strandweave.sources import packed as P
from strandweave.sources import sequences as Q
from strandweave.streaming.mapping import map_stream, observed


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\n> one first contig\nacgt\nAC GT\r\n>two\n\n>three\tx\nNNAC")
    (tmp_path / "b.fa").write_text(">four\nA\n")
    rows = Q.read_fasta(spark, str(tmp_path / "*.fa")).orderBy("contig_id").collect()
    assert [tuple(r) for r in rows] == [(0, "one", 8, "ACGTACGT"), (1, "two", 0, ""), (2, "three", 4, "NNAC"), (3, "four", 1, "A")]


def test_fasta_order_survives_splits(spark, tmp_path):
    path = tmp_path / "big.fa"
    path.write_text("".join(f">c{i}\n{'ACGT' * (i % 9)}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = Q.read_fasta(spark, str(path)).orderBy("contig_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.name for r in rows] == [f"c{i}" for i in range(3000)]
    assert [r.length for r in rows] == [4 * (i % 9) for i in range(3000)]


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@a x=1\nACGT\n+\nIIII\n@b\nAC\r\n+\nII\r\n@c\nG\n+\nI")
    rows = Q.read_fastq(spark, str(tmp_path / "r.fastq")).orderBy("read_id").collect()
    assert [tuple(r) for r in rows] == [(0, "a", "ACGT", "IIII"), (1, "b", "AC\r", "II\r"), (2, "c", "G", "I")]
    (tmp_path / "cut.fastq").write_text("@a\nACGT\n+\nIIII\n@b\nAC\n+\n")
    assert [r.name for r in Q.read_fastq(spark, str(tmp_path / "cut.fastq")).collect()] == ["a"]  # a record without its last line is no record
    (tmp_path / "bad.fastq").write_text("x\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="must start with @"):
        Q.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()


def test_sam_round_trip(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "c", 60, "ACGTTGCAACGGATCCATGCA" * 3)], "contig_id long, name string, length long, seq string")
    reads = spark.createDataFrame([(i, f"r{i}", "ACGT", "IIII") for i in range(5)], "read_id long, name string, seq string, qual string")
    Q.write_sam(sam_header(contigs), map_to_sam(reads, contigs), str(tmp_path / "out"))
    text = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x.split("\t")[0] for x in text] == ["@HD", "@SQ", "@PG", "r0", "r1", "r2", "r3", "r4"]
    assert Q.read_sam(spark, str(tmp_path / "out")).where("unmapped").count() == 5


def test_shards(spark, tmp_path):
    hits = spark.createDataFrame([(16, 0, 5, 1), (16, 1, 7, 0), (32, 0, 9, 0), (17, 3, 1, 1)], "hash long, contig_id long, pos long, strand int").withColumn("shard_id", (F.col("hash") % 16).cast("int"))
    files = P.shards(hits).collect()
    for f in files:
        (tmp_path / f"{f.shard_id}.bin").write_bytes(f.content)
        assert f.size == 64 + 16 * (2 if f.shard_id == 0 else 1) + 6 * (3 if f.shard_id == 0 else 1)
    back = P.read_shards(spark, str(tmp_path)).drop("flags").orderBy("hash", "contig_id").collect()
    assert [tuple(r) for r in back] == [(0, 16, 0, 5, 1), (0, 16, 1, 7, 0), (1, 17, 3, 1, 1), (0, 32, 0, 9, 0)]
    body = bytearray(files[0].content)
    with pytest.raises(ValueError, match="magic"):
        P.decode_shard(b"X" + bytes(body[1:]))
    body[64 + 12] += 1
    with pytest.raises(ValueError, match="add up"):
        P.decode_shard(bytes(body))
    with pytest.raises(Exception, match="does not fit"):
        I.pos_checked(hits.withColumn("pos", F.lit(1 << 28).cast("long"))).collect()


def test_contigs_sequences_and_bundles():
    body = P.encode_contigs(["chr1", "é"], [10, 7])
    assert P.decode_contigs(body) == [(0, "chr1", 10), (1, "é", 7)]
    assert P.contig_offsets([0, 1, 4, 5, 16]) == [0, 0, 1, 2, 4]
    packed = P.pack_bases("ACGTNACgt")
    assert len(packed) == 3 and P.unpack_bases(packed, 0, 9, 9) == "ACGTAACGT" and P.unpack_bases(packed, 3, 99, 9) == "TAACGT" and P.unpack_bases(packed, 9, 12, 9) == ""
    bundle = P.encode_bundle({"b": b"22", "a": b"1", "c/d": b""})
    assert P.decode_bundle(bundle) == {"a": b"1", "b": b"22", "c/d": b""}
    for bad in (b"Y" + bundle[1:], bundle[:-1], bundle[:8] + b"\x63" + bundle[9:]):
        with pytest.raises(ValueError):
            P.decode_bundle(bad)


def test_stream_equals_batch(spark, tmp_path):
    seq = "ACGTTGCAACGGATCCATGCATTGACCGTAAGCTTGGCATCAGTCCAGATTACAGGCATCGAT" * 8
    contigs = spark.createDataFrame([(0, "c", len(seq), seq)], "contig_id long, name string, length long, seq string")
    reads = spark.createDataFrame([(i, f"r{i}", seq[i * 9 : i * 9 + 120], "I" * 120) for i in range(8)], "read_id long, name string, seq string, qual string")
    reads.repartition(2).write.parquet(str(tmp_path / "in"))
    index, got = I.build_index(contigs, Params()).cache(), []
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = map_stream(stream, contigs, index, lambda lines, _: got.extend(r.value for r in lines.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted(got) == sorted(r.value for r in map_to_sam(reads, contigs).collect())
    from strandweave.plans.mapping import map_reads

    seen = Observation("run")
    placements = map_reads(reads, contigs).placements
    assert observed(placements, seen).count() == placements.count()
    assert seen.get == {"records": placements.count(), "mapped": 8, "fragments": placements.where("not is_secondary").count()}


def fasta_and_fastq(folder):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT") for _ in range(4000)) for _ in range(3)]
    (folder / "ref.fa").write_text("".join(f">chr{i}\n{s}\n" for i, s in enumerate(seqs)))
    reads = [(f"r{i}", seqs[i % 3][i * 90 : i * 90 + 300]) for i in range(30)] + [("none", "".join(rng.choice("ACGT") for _ in range(200)))]
    (folder / "reads.fastq").write_text("".join(f"@{n} x\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads))
    return len(reads)


def test_reference_in_one_call_and_a_run(spark, tmp_path):
    n = fasta_and_fastq(tmp_path)
    ref = R.build_reference(spark, str(tmp_path / "ref.fa"), str(tmp_path / "index"), "ref")
    about = json.loads(ref.manifest)
    hits = I.seed_hits(Q.read_fasta(spark, str(tmp_path / "ref.fa")))
    assert about["contigs"] == 3 and about["referenceId"] == "ref" and about["totalHits"] == hits.count() and about["cappedSeedHits"] == 0
    assert about["files"] and all(len(f["sha256"]) == 64 and f["size"] > 0 for f in about["files"])
    again = R.open_reference(spark, str(tmp_path / "index"))
    assert again.index.count() == hits.count() and again.contigs.count() == 3 and Q.read_manifest(spark, str(tmp_path / "index" / "reference.json")).first().referenceId == "ref"
    summary = R.map_run(spark, str(tmp_path / "reads.fastq"), again, str(tmp_path / "out"))
    assert (summary["reads"], summary["mapped"], summary["unmapped"]) == (n, n - 1, 1) and summary["anchors"] > 0 and summary["rps"] > 0
    stored = json.loads(next((tmp_path / "out.summary.json").glob("part-*")).read_text())
    assert stored["reads"] == n and stored["reference"] == "ref"
    direct = map_to_sam(Q.read_fastq(spark, str(tmp_path / "reads.fastq")), again.contigs)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect() if not r.value.startswith("@")]
    assert sorted(lines) == sorted(r.value for r in direct.collect())
    few = R.map_run(spark, str(tmp_path / "reads.fastq"), again, str(tmp_path / "few"), max_reads=7)
    assert few["reads"] == 7


def test_fastq_stream_equals_the_file(spark, tmp_path):
    fasta_and_fastq(tmp_path)
    (tmp_path / "in").mkdir()
    text = (tmp_path / "reads.fastq").read_text()
    (tmp_path / "in" / "a.fastq").write_text(text)
    (tmp_path / "in" / "b.fastq").write_text("@last\nACGT\n+\nIIII\n@cut\nAC\n")
    got = []
    stream = Q.stream_fastq(spark, str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(lambda rows, _: got.extend(map(tuple, rows.select("name", "seq", "qual").collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = [tuple(r) for r in Q.read_fastq(spark, str(tmp_path / "reads.fastq")).select("name", "seq", "qual").collect()]
    assert sorted(got) == sorted([*want, ("last", "ACGT", "IIII")])
    assert len({r.read_id for r in Q.fastq_records(spark.read.text(str(tmp_path / "in"), wholetext=True)).collect()}) == len(want) + 1


def test_minimizers_in_sql(spark):
    register_minimizers(spark, "minimizers_of")
    seqs = spark.createDataFrame([(0, "ACGTTGCAACGGATCCATGCATTGACCGTAAGCTTGGCATCAGTCCAG" * 2), (1, None), (2, "ACGT")], "seq_id long, seq string")
    seqs.createOrReplaceTempView("some_sequences")
    got = spark.sql("SELECT seq_id, m.hash, m.pos, m.strand FROM some_sequences, LATERAL minimizers_of(seq, 15, 10) m")
    want = M.minimizers(seqs).select("seq_id", "hash", "pos", "strand")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 3


def test_scratch_tables_go(spark, tmp_path):
    from strandweave.operators._store import scratch, shared_folder, spread, stored

    before = len(list(Path(shared_folder(spark).removeprefix("file:"), "strandweave").glob("*")))
    with scratch(spark):
        stored(stored(spark.range(10))).write.parquet(str(tmp_path / "out"))
    kept = stored(spark.range(3))
    assert len(list(Path(shared_folder(spark).removeprefix("file:"), "strandweave").glob("*"))) == before + 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10 and kept.count() == 3
    spark.range(10).repartition(1).write.parquet(str(tmp_path / "one"))
    spark.range(10).repartition(6).write.parquet(str(tmp_path / "six"))
    parts = [spread(spark.read.parquet(str(tmp_path / x))).rdd.getNumPartitions() for x in ("one", "six")]
    assert parts[0] == 8 and parts[1] <= 6 and spread(spark.read.parquet(str(tmp_path / "one"))).count() == 10

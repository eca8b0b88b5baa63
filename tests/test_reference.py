"""The stored reference: bucketed, pruned, hashed in blocks, and mapped against in one pass."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators import index as I
from strandweave.operators.anchors import query_seeds, seed_anchors
from strandweave.params import Params
from strandweave.plans import reference as R
from strandweave.plans.mapping import map_reads
from strandweave.sources import files
from strandweave.sources import sequences as Q


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("reference")
    rng = random.Random(17)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (9000, 50, 7000)]
    (home / "ref.fa").write_text("".join(f">chr{i} about\n" + "\n".join(s[a : a + 60] for a in range(0, len(s), 60)) + "\n" for i, s in enumerate(seqs)))
    reads = [(f"r{i}", seqs[2 * (i % 2)][i * 130 : i * 130 + 280]) for i in range(40)] + [("none", "ACGT" * 30)]
    (home / "reads.fastq").write_text("".join(f"@{n} x\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads))
    (home / "one.fastq").write_text(f"@one\n{seqs[0][500:540]}\n+\n{'I' * 40}\n")
    R.build_reference(spark, str(home / "ref.fa"), str(home / "stored"), "small", buckets=3, size=512)
    return home


def reopened(spark, folder):
    """As another session would find it: the files only."""
    for t in spark.catalog.listTables():
        if t.name.startswith("seed_index_") and not t.isTemporary:
            spark.sql(f"DROP TABLE {t.name}")
    return R.open_reference(spark, str(folder / "stored"))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_index_is_joined_where_it_lies(spark, folder, no_broadcast):
    ref = reopened(spark, folder)
    assert ref.size == 512 and ref.chunks.agg(F.max("own")).first()[0] == 512 and ref.names.count() == 3
    reads = Q.read_fastq(spark, str(folder / "reads.fastq"))
    seeds, index, n = R.pruned(ref.index, query_seeds(reads), Params())
    found = seed_anchors(seeds, index)
    text = plan(found)
    assert len(re.findall(r"Exchange hashpartitioning\(hash", text)) == 1 and "Bucketed: true" in text  # that of the seeds
    fresh = I.build_index(ref.contigs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, seed_anchors(query_seeds(reads), fresh).collect())) and n == seeds.count()


def test_untouched_parts_are_not_read(spark, folder):
    ref = reopened(spark, folder)
    reads = Q.read_fastq(spark, str(folder / "one.fastq"))
    seeds, index, n = R.pruned(ref.index, query_seeds(reads), Params())
    touched = {r["hash"] % 64 for r in seeds.collect()}
    assert 0 < len(touched) <= n < 20
    # no join here: these are the files that a scan of the pruned index opens
    assert len(set(f.split("part=")[1].split("/")[0] for f in index.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])) == len(touched)
    assert "PartitionFilters: [part" in plan(index) and len(ref.index.select("part").distinct().collect()) > 50
    assert seed_anchors(seeds, index).count() == seed_anchors(seeds, ref.index).count() > 0


def test_no_seeds_at_all(spark, folder, tmp_path):
    (tmp_path / "short.fastq").write_text("@a\nACGT\n+\nIIII\n")
    (tmp_path / "none.fastq").write_text("")
    ref = reopened(spark, folder)
    got = R.map_run(spark, str(tmp_path / "short.fastq"), ref, str(tmp_path / "out"))
    assert (got["reads"], got["mapped"], got["unmapped"], got["anchors"], got["fragments"]) == (1, 0, 1, 0, 0)
    assert R.map_run(spark, str(tmp_path / "none.fastq"), ref, str(tmp_path / "out2"))["reads"] == 0
    other = "".join(random.Random(99).choice("ACGT") for _ in range(200))
    (tmp_path / "other.fastq").write_text(f"@b\n{other}\n+\n{'I' * 200}\n")
    got = R.map_run(spark, str(tmp_path / "other.fastq"), ref, str(tmp_path / "out3"))
    assert (got["reads"], got["mapped"], got["anchors"]) == (1, 0, 0)


@pytest.mark.parametrize("refine", [False, True])
def test_a_run_counts_on_its_way(spark, folder, tmp_path, monkeypatch, refine):
    ref, p = reopened(spark, folder), Params(refine=refine)
    reads = Q.read_fastq(spark, str(folder / "reads.fastq"))
    direct = map_reads(reads, ref.contigs, p)
    want = {"reads": reads.count(), "anchors": direct.anchors.count(), "mapped": direct.placements.select("read_id").distinct().count(), "fragments": direct.placements.where("not is_secondary").count()}
    lines = sorted(r.value for r in R.sam_lines(R.sam_records(direct.placements, reads, ref.contigs)).collect())
    calls = []
    monkeypatch.setattr(R, "query_seeds", lambda *a, real=R.query_seeds: calls.append("seeds") or real(*a))
    monkeypatch.setattr(DataFrame, "count", lambda self: pytest.fail("a count is a pass of its own"))
    got = R.map_run(spark, str(folder / "reads.fastq"), ref, str(tmp_path / "out"), p)
    monkeypatch.undo()
    assert calls == ["seeds"] and {k: got[k] for k in want} == want and got["unmapped"] == want["reads"] - want["mapped"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect() if not r.value.startswith("@")) == lines


def test_the_manifest_lists_every_file(spark, folder):
    about = json.loads(reopened(spark, folder).manifest)
    found = {str(f.relative_to(folder / "stored")): f for f in (folder / "stored").rglob("*.parquet")}
    assert {f["path"] for f in about["files"]} == set(found) and len(found) > 60
    for f in about["files"]:
        body = found[f["path"]].read_bytes()
        assert f["size"] == len(body) and f["sha256"] == hashlib.sha256(body).hexdigest()
    stats = I.index_stats(I.seed_hits(R.open_reference(spark, str(folder / "stored")).contigs)).first()
    assert (about["totalHits"], about["distinctSeeds"], about["contigs"]) == (stats["total_hits"], stats["distinct_seeds"], 3)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_digests_do_not_depend_on_blocks(tmp_path, block):
    for size in (0, 1, 7, 100):
        (tmp_path / "f").write_bytes(bytes(range(size)))
        assert files.digest(f"file:{tmp_path}/f", block) == files.digest(f"file://{tmp_path}/f", block) == hashlib.sha256(bytes(range(size))).hexdigest()


def test_files_of_an_index_follow_its_size(spark, folder, tmp_path):
    """They were 64 for each shuffle partition, so a larger cluster made more and smaller files."""
    assert [I.fit_buckets(n) for n in (0, 1, 64 * I.FILE_HITS, 64 * I.FILE_HITS + 1, 1000 * 64 * I.FILE_HITS)] == [1, 1, 1, 2, 1000]
    ref = R.build_reference(spark, str(folder / "ref.fa"), str(tmp_path / "fitted"), "fitted", size=512)
    rows = ref.index.select(F.input_file_name().alias("file"), "hash", "contig_id", "pos", "strand").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r[0], []).append(tuple(r)[1:])
    assert len(by_file) <= 64 and all(x == sorted(x) for x in by_file.values())
    assert sorted(tuple(r)[1:] for r in rows) == sorted(map(tuple, reopened(spark, folder).index.select("hash", "contig_id", "pos", "strand").collect()))


def test_few_heavy_seeds_leave_hits_where_they_are(spark):
    hits = spark.createDataFrame([(1, 0, i, 0) for i in range(9)] + [(2, 0, 50, 1)], "hash long, contig_id long, pos long, strand int")
    found = I.under_cap(hits, I.seed_counts(hits), Params(freq_cap=8))
    assert "SortMergeJoin" not in plan(found) and [tuple(r) for r in found.collect()] == [(2, 0, 50, 1)]

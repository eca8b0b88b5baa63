"""FASTQ by byte ranges: any split gives the same reads, growing files are read once, restarts lose and repeat nothing."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandweave.plans import reference as R
from strandweave.sources import fastq as B
from strandweave.sources import sequences as Q
from strandweave.streaming import mapping as S


def some_reads(n, seed=3):
    """Qualities start with @ and + as often as they can."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([1, 5, 40, 300])
        out.append((f"r{i}", "".join(rng.choice("ACGTN") for _ in range(size)), "".join(rng.choice("@+I#") for _ in range(size))))
    return out


def text_of(reads, plus="+"):
    return "".join(f"@{n} about it\n{s}\n{plus}{n if plus and i % 3 == 0 else ''}\n{q}\n" for i, (n, s, q) in enumerate(reads))


@pytest.mark.parametrize("split", [1, 50, 333, 1 << 20])
def test_any_split_gives_the_same_reads(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(B, "WINDOW", 64)
    reads = some_reads(60)
    (tmp_path / "a.fastq").write_text(text_of(reads[:45])[:-1])  # no last line end
    (tmp_path / "b.fastq").write_text(text_of(reads[45:]) + "@cut\nACGT\n+\n")
    (tmp_path / "c.fastq").write_text("")
    got = Q.read_fastq(spark, str(tmp_path / "*.fastq"), split).orderBy("read_id").collect()
    assert [tuple(r) for r in got] == [(i, *r) for i, r in enumerate(reads)]
    lines = Q.read_fastq_lines(spark, str(tmp_path / "*.fastq")).orderBy("read_id").collect()
    assert [tuple(r) for r in lines] == [tuple(r) for r in got]


def test_without_plus_a_file_is_one_range_or_an_error(spark, tmp_path):
    reads = [(n, s, "I" * len(s)) for n, s, _ in some_reads(20)]
    (tmp_path / "odd.fastq").write_text(text_of(reads, plus=""))
    got = Q.read_fastq(spark, str(tmp_path / "odd.fastq"), 100).orderBy("read_id").collect()
    assert [r.name for r in got] == [n for n, _, _ in reads]
    (tmp_path / "bad.fastq").write_text(text_of(reads[:5]) + "\n" + text_of(reads[5:]))
    for split in (64, 1 << 20):
        with pytest.raises(Exception, match="must start with @|no whole records"):
            Q.read_fastq(spark, str(tmp_path / "bad.fastq"), split).collect()


def test_borders(tmp_path):
    body = text_of(some_reads(40, 8))
    (tmp_path / "x").write_text(body)
    true, at = [0], 0
    for k, line in enumerate(body.splitlines(True)):
        at += len(line)
        if k % 4 == 3:
            true.append(at)
    path, size = str(tmp_path / "x"), len(body)
    for at in range(0, size + 1, 7):
        assert B.border_after(path, at, size, 16) == min(t for t in true if t >= at)
        assert B.border_before(path, 0, at, 16) == max(t for t in true if t <= at)
    start = true[5]
    assert B.border_before(path, start, true[6] - 1, 16) == start and B.border_before(path, start, true[9] + 1, 16) == true[9]


def follow(spark, folder, work, max_bytes=400):
    rows = B.follow_fastq(spark, str(folder / "in"), max_bytes, split=150)
    got = []

    def each(batch, batch_id):
        got.append((batch_id, [tuple(r) for r in batch.orderBy("path", "offset").collect()]))
        work(batch_id)

    return got, rows.writeStream.foreachBatch(each).option("checkpointLocation", str(folder / "cp")).start()


def test_a_growing_file_is_read_once_and_restarts_lose_nothing(spark, tmp_path):
    reads = some_reads(50, 5)
    (tmp_path / "in").mkdir()
    body = text_of(reads)
    target, other = tmp_path / "in" / "grow.fastq", tmp_path / "in" / "other.fastq"
    half = len(body) // 2
    target.write_text(body[:half])  # ends inside a record

    def fail(batch_id):
        if batch_id == 2:
            raise RuntimeError("killed in its third batch")

    first, query = follow(spark, tmp_path, fail)
    with pytest.raises(Exception, match="third batch"):
        query.awaitTermination(120)
    with target.open("a") as f:
        f.write(body[half:])
    other.write_text(text_of([("late", "ACGT", "IIII")]))
    second, query = follow(spark, tmp_path, lambda _: None)
    deadline = time.time() + 120
    while sum(len(rows) for _, rows in second) < 45 and time.time() < deadline and query.isActive:
        query.processAllAvailable()
    query.stop()
    assert [b for b, _ in first] == [0, 1, 2] and second[0] == first[2]  # the batch that failed comes again, the same
    rows = [r for b, part in first[:2] + second for r in part]
    assert sorted((n, s, q) for _, n, s, q, *_ in rows) == sorted([*reads, ("late", "ACGT", "IIII")])
    assert len({r[0] for r in rows}) == 51 and max(len(part) for _, part in first + second) < 45  # batches are bounded
    batch = spark.read.format("fastq_ranges").option("split", 200).load(str(tmp_path / "in"))
    again = B.read_splits(batch.withColumn("size", F.col("stop")), grow=True)
    assert sorted(r.name for r in again.collect()) == sorted(r[1] for r in rows)


def test_totals_survive_a_killed_query(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(6000))
    (tmp_path / "ref.fa").write_text(f">c\n{seq}\n")
    ref = R.build_reference(spark, str(tmp_path / "ref.fa"), str(tmp_path / "stored"), "t", buckets=2)
    reads = [(f"r{i}", seq[i * 150 : i * 150 + 250], "I" * 250) for i in range(24)] + [("none", "ACGT" * 40, "I" * 160)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq").write_text(text_of(reads))
    whole = R.map_run(spark, str(tmp_path / "in" / "a.fastq"), ref, str(tmp_path / "batch"))
    out = str(tmp_path / "out")
    assert S.totals(spark, out) == dict.fromkeys(S.COUNTERS, 0)

    def start():
        return S.map_growing(B.follow_fastq(spark, str(tmp_path / "in"), 6000), ref, out, str(tmp_path / "cp"))

    calls = []

    def dying(*args, real=R.map_batch):
        calls.append(1)
        mapped = real(*args)
        if len(calls) == 2:
            raise RuntimeError("killed after mapping")
        return mapped

    monkeypatch.setattr(S, "map_batch", dying)
    with pytest.raises(Exception, match="killed after"):
        start().awaitTermination(200)
    monkeypatch.undo()
    assert 0 < S.totals(spark, out)["reads"] < len(reads)
    query = start()
    query.processAllAvailable()
    query.stop()
    assert S.totals(spark, out) == {c: whole[c] for c in S.COUNTERS}
    mine = sorted(r.value for r in spark.read.text(f"{out}/sam").collect())
    assert mine == sorted(r.value for r in spark.read.text(str(tmp_path / "batch")).collect() if not r.value.startswith("@"))


def test_a_listener_adds_up(spark, tmp_path):
    frame = spark.createDataFrame([(i, i % 3 == 0, i % 5 == 0) for i in range(90)], "read_id long, is_primary boolean, is_secondary boolean")
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    totals = S.RunningTotals("seen", {"records": 10})
    spark.streams.addListener(totals)
    try:
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = S.observed(stream, "seen").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        deadline = time.time() + 30
        while totals.sums["records"] < 100 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(totals)
    assert totals.sums == {"records": 100, "mapped": 30, "fragments": 72}

"""Rows that share an id, have none, or repeat: nothing is lost and nothing grows with them."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strandweave.llm import _ranges, fingerprints, language, quality, sharding, suffixes, toxicity

#: No double is equal to it.
BIG = 2**60 + 77
EN = "the quick brown dogs walk through the old town and {} people watch them over there"
DE = "die schnellen braunen hunde laufen durch die alte stadt und {} leute schauen ihnen dort zu"


def test_a_language_whose_rows_share_an_id_is_learned(spark):
    rows = [(0, EN.format(i), "en") for i in range(6000)] + [(1, EN.format("few"), "en")] * 3000 + [(i + 2, DE.format(i), "de") for i in range(400)] + [(None, DE.format("keine"), "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample = {r["lang"]: r["n"] for r in language.training(frame, 200).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert sample == {"en": 200, "de": 200}
    model = language.fit(language.training(frame, 200))
    got = language.with_language(frame.select("doc_id", "text"), model).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in got} == {"en": 9000, "de": 401}


def test_training_takes_all_of_few_rows(spark):
    rows = [(i, EN.format(i % 7), "en") for i in range(40)]
    assert language.training(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality, "quality")])
def test_fits_are_bounded_by_rows_not_ids(spark, monkeypatch, module, column):
    docs = spark.createDataFrame([(i % 2, f"text {i} of two ids {'x' * (i % 5)}") for i in range(3000)], "doc_id long, text string")
    marks = spark.createDataFrame([(0, 0), (1, 1)], f"doc_id long, {column} int")
    sizes = []
    monkeypatch.setattr(module, "within", lambda sample, rows, real=module.within: sizes.append(real(sample, rows)) or sizes[-1])
    module.train(docs, marks, 100)
    assert sizes[0].count() == 100 if module.labelled(docs, marks, 100).count() > 100 else sizes[0].count() <= 100


def test_repeated_rows_do_not_break_the_law_of_bytes(spark, tmp_path):
    same = [(None, "a" * 120)] * 3000
    others = [(i, "b" * (20 + i * 37 % 150)) for i in range(4000)]
    spark.createDataFrame(same + others, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op2_virtual_slots(spark, str(tmp_path)).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 7000 and len(sizes) == 8 and sizes.max() - sizes.min() <= got["size"].max()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumns({"shard": F.lit("x"), "size": F.lit(1)})
    sharded = sharding.shard_documents(docs)
    assert sharded.schema["shard"].dataType.simpleString() == "int" and {r["size"] for r in sharded.select("size").collect()} == {1}
    loads = [r["b"] for r in sharded.groupBy("shard").agg(F.sum(F.length("text") + 1).alias("b")).collect()]
    assert len(loads) == 8 and max(loads) < 1.05 * min(loads)


def follow(rows):
    """(doc_id, n_chars, edited_sha256) of rows in order, the first following the last."""
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(t) // 2
        yield repr((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))


@pytest.mark.parametrize("deal", [1, 10**9])
def test_successors_of_rows_without_an_id_are_spread(spark, monkeypatch, deal):
    """A third of all rows has no id, another repeats a (large) id and text: no part holds many of them, and each text still meets the next."""
    monkeypatch.setattr(fingerprints, "DEAL", deal)
    rows = [(None, f"none {i} of these has an id {i * 7919 % 1000}") for i in range(3000)] + [(BIG, "the same again and again")] * 3000
    rows += [(BIG, f"not the same {i}") for i in range(30)] + [(i - 500, f"text {i} by itself") for i in range(3000)] + [(2**63 - 1, "last"), (-(2**63), "first")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = fingerprints.successors(frame, 40)
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert max(sizes) < 3 * len(rows) / 40 if deal == 1 else max(sizes) < 3600
    got = fingerprints.fingerprint_edits(frame).collect()
    order = frame.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect()
    assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(follow([tuple(r) for r in order]))


def test_a_dealt_text_follows_itself(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "DEAL", 1)
    monkeypatch.setattr(fingerprints, "successors", lambda docs, real=fingerprints.successors: real(docs, 30))
    rows = [(None, "one text of all of these rows")] * 2000 + [(i, f"text {i} by itself") for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprints.fingerprint_edits(frame).collect()
    assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(follow(rows))


def test_batches_of_bytes_and_shared_ids(spark, monkeypatch):
    """op9: an id of a third of the text has level batches; strings of one id don't count against each other, later ids still meet them."""
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 4000)
    line = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = [(None, f"{line(i % 50)} {i}") for i in range(300)] + [(7, line(i % 90)) for i in range(300)] + [(BIG + i, line(i)) for i in range(3)] + [(i, line(i) * (1 + 20 * (i % 97 == 0))) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranges = _ranges.cut_ranges(frame, 16, 10_000)
    assert ranges.width[0] > 3 and ranges.width[1:].max() > 3
    loads = [r["n"] for r in frame.groupBy(_ranges.part_of(ranges)).agg(F.sum(F.octet_length("text") + _ranges.WEIGH).alias("n")).collect()]
    assert max(loads) < 3 * sum(loads) / 16
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    want = []
    for d, t in rows:
        gone = {j for i in range(len(t) - 49) if first[t[i : i + 50]] != d for j in range(i, i + 50)}
        want.append((str(d), "".join(x for i, x in enumerate(t) if i not in gone)))
    assert sorted((str(r.doc_id), bytes(r.kept).decode()) for r in suffixes.find_repeats(frame).collect()) == sorted(want)


@pytest.mark.parametrize("apply", [fingerprints.fingerprint_edits, suffixes.find_repeats])
def test_ids_that_are_no_numbers_are_refused(spark, apply):
    with pytest.raises(TypeError, match="whole number"):
        apply(spark.createDataFrame([("a", "text")], "doc_id string, text string"))

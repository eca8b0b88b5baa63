"""The pipeline's stages on the small tables: columns, decisions, and what stays."""

import math
import random

import duckdb
import pytest

import corpus_pipeline
from strandweave.llm import catalog, neardup, toxicity
from tests.llm.test_operators import vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if k < 4:
            assert docs.columns == COLUMNS
        if name == "toxicity":
            scored = toxicity.with_score(before, toxicity.train(before, marks))
            assert docs.count() == scored.where("toxicity < 0.3").count() < before.count()
        if name == "near_dedup":
            assert docs.count() == neardup.classes(before).select("class_id").distinct().count()
        if name == "decontaminate":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            gone = before.join(docs, "doc_id", "left_anti").collect()
            assert gone and all(any(t in r.text for t in items) for r in gone)
            assert not any(t in r.text for r in docs.collect() for t in items)
    assert {*docs.columns} == {*COLUMNS, "virtual_slot", "shard"} and docs.count() == seen["mix"].count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "shard"]


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    """Null and shared ids, repeated rows, null, empty and long texts, clashing columns; then an empty table."""
    rng = random.Random(51)
    words = vocabulary(600, 51)
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    item = make(25)
    texts = [("idiot you moron " if i % 4 == 0 else "") + make(rng.randint(5, 80)) for i in range(120)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(None, None, None, None), (None, make(30), "en", None), (None, f"{make(9)} {item}", "en", "s1"), (7, make(40), "en", "s1"), (7, f"{make(20)} {item} {make(5)}", "en", "s1"), (7, texts[7], "en", "s1")]
    rows += [(200, "", "en", "s2"), (201, make(50_000), "en", "s2"), (202, texts[3], "en", "s0"), (203, texts[3], "en", "s0"), (204, " \n", "en", "s0")]
    names = "shard string, virtual_slot long, size int, k1 long, toxicity double, copies string, _key string, rank int, batch int, piece int"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "a", 1, 2, 3, 0.5, "b", "c", 4, 5, 6) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (2, None), (None, make(20))], "item_id long, text string")
    for folder, rows_ in (("full", docs), ("none", docs.where("false"))):
        rows_.write.parquet(str(tmp_path / folder / "documents.parquet"))
        marks.write.parquet(str(tmp_path / folder / "labels.parquet"))
        bench.write.parquet(str(tmp_path / folder / "benchmark.parquet"))
    kept, steps = spark.read.parquet(str(tmp_path / "full" / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path / "full")).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        steps.append(kept.collect())
        assert k == 4 or kept.columns == docs.columns
    toxic, near, clean, mixed, dealt = steps
    assert {r.doc_id for r in toxic} >= {7, 200, 201, None} and not any((r.text or "").startswith("idiot") for r in toxic if r.doc_id is not None and r.doc_id < 100)
    assert sum(r.text == texts[3] for r in near) == 1 and sum(r.doc_id == 7 for r in near) == 3 and sum(not r.text for r in near) == 1  # null and empty are equal texts
    lost = [r for r in near if r.text and item in r.text]
    assert len(lost) == 2 and len(clean) == len(near) - 2 and not any(r.text and item in r.text for r in clean) and sum(r.doc_id == 7 for r in clean) == 2
    assert {r.text for r in mixed} <= {r.text for r in clean} and len(dealt) == len(mixed)
    assert corpus_pipeline.run(spark, str(tmp_path / "full")).count() == len(dealt)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_queries_have_the_contracts_columns(spark):
    want = {
        "op2_": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op4_": {"doc_id", "size", "source_size", "target", "taken"},
        "op5_": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
        "op6_": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op7_": {"doc_id", "held_out", "lang_pred", "score"},
        "op8_": {"doc_id", "held_out", "score", "predicted"}, "op9_": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op10_": {"doc_id", "held_out", "score", "predicted"},
    }
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for prefix, columns in want.items():
        name = next(q for q in catalog.QUERIES if q.startswith(prefix))
        out = catalog.QUERIES[name](spark, SF)
        assert columns <= set(out.columns) and out.count() == n


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    plain = lambda rows: sorted(repr(tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)) for r in rows)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert plain(frame.select(*columns).collect()) == plain(want) and want


def test_rows_go_to_python_in_small_batches(spark):
    """After a stage's call a batch holds few bytes however long the texts are; a session's own bound stays; what a task yields doesn't change."""
    import pyarrow as pa

    from strandweave.llm._arrow import BATCH, frugal, small_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    @frugal
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "b"])

    try:
        small_batches(spark)
        rows = spark.range(0, 2000, 1, 1).selectExpr("id", "repeat('word ', 2000) AS text").mapInArrow(sizes, "n long, b long").collect()
        assert sum(r.n for r in rows) == 2000 and max(r.b for r in rows) < 2 * BATCH
        spark.conf.set(name, "1000000")
        small_batches(spark)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name)

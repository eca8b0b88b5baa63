"""Exact dedup with counting quotient filters and byte verification.

One pass writes a narrow row per document: its id, a 64-bit fingerprint and the SHA-256 of its
normalised text (A-Z lowered, null is empty). Every task puts the fingerprints it holds into
counting quotient filters, one per block of fingerprints; filters of a block meet and merge. Only
fingerprints whose count is above one are of interest from then on: a bit per fingerprint prefix
(a bounded broadcast) lets the second pass over the texts drop nearly all others before anything
is shuffled. What is left is grouped by its bytes, after partial counts in each task, and groups
of two and more are the classes of equal texts. The bytes decide: two texts of one fingerprint
are two groups, and two of one SHA-256 (which tells rows their class) would be an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm._arrow import sliced
from strandweave.llm._quotient import QuotientFilter, counted, merge
from strandweave.llm._shared import documents, keep

#: Remainder bits beside the quotient bits that the number of rows asks for: a row meets a stranger's fingerprint with probability 2^-32.
SPARE = 32
#: Fingerprints of a block on average, and of a task's filter at most.
BLOCK = 1 << 20
#: Bits of the sieve that all tasks get (16 MB); beyond as many repeated fingerprints more texts pass it, never fewer.
SIEVE = 27
#: Classes with more than a ten-thousandth of all rows, fewer than ten thousand of them, are joined by broadcast.
HEAVY = 10_000

U = np.uint64
FILTER = "block long, bits int, q int, slots int, occupied binary, run_ends binary, counted binary, remainders binary, counts array<long>"


def normalised(texts: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each text with A-Z lowered; null is empty."""
    lowered = pc.ascii_lower(texts.fill_null("") if texts.null_count else texts)
    wide = pa.types.is_large_string(lowered.type)
    off = np.frombuffer(lowered.buffers()[1], np.int64 if wide else np.int32)[lowered.offset : lowered.offset + len(lowered) + 1].tolist()
    body = memoryview(lowered.buffers()[2] or b"")
    return [body[a:b] for a, b in zip(off, off[1:])]


def fingerprint(body: memoryview) -> int:
    """64 bits, independent of SHA-256; as a signed number."""
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "big", signed=True)


def marks(docs: DataFrame, prints=fingerprint) -> DataFrame:
    """(row, doc_id, print, sha) of every row: a number of its own, its id, its text's fingerprint and SHA-256."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                bodies = normalised(part.column(2))
                yield pa.record_batch([part.column(0), part.column(1), pa.array([prints(b) for b in bodies], pa.int64()), pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary())], ["row", "doc_id", "print", "sha"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, print long, sha binary")


def layout(rows: int, partitions: int) -> tuple[int, int]:
    """Bits of a fingerprint that are used, and how many of them choose the block."""
    bits = min(64, max(1, rows).bit_length() + SPARE)
    block = max((rows // BLOCK).bit_length(), max(1, 2 * partitions - 1).bit_length())
    return bits, min(block, bits - 16)


def filters(prints: DataFrame, bits: int, block: int, most: int = BLOCK) -> DataFrame:
    """Counting quotient filters of ``prints(print)``: each task's own, one for each block it meets, of ``most`` fingerprints at most together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, U), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            head = (values >> U(bits - block)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.append(True, head[1:] != head[:-1])), len(head))
            rows = [(int(head[a]), QuotientFilter.build(values[a:b] & U((1 << bits - block) - 1), counts[a:b], bits - block)) for a, b in zip(edges, edges[1:])]
            return pa.RecordBatch.from_pylist([{"block": k, "bits": f.bits, "q": f.q, "slots": f.slots, "occupied": f.occupied, "run_ends": f.run_ends, "counted": f.counted, "remainders": f.remainders, "counts": f.counts.tolist()} for k, f in rows], schema=SCHEMA)

        for batch in batches:
            new = batch.column(0).to_numpy().view(U) >> U(64 - bits)
            values, counts = counted(np.append(values, new), np.append(counts, np.ones(len(new), np.int64)))
            if len(values) >= most:
                yield out()
                values, counts = values[:0], counts[:0]
        if len(values):
            yield out()

    return prints.mapInArrow(run, FILTER)


SCHEMA = pa.schema([("block", pa.int64()), ("bits", pa.int32()), ("q", pa.int32()), ("slots", pa.int32()), *[(x, pa.binary()) for x in ("occupied", "run_ends", "counted", "remainders")], ("counts", pa.list_(pa.int64()))])


def repeated(parts: DataFrame, bits: int) -> DataFrame:
    """(print, n): the fingerprints (their ``bits`` upper bits) whose count over all filters is above one. A block is merged by one call; blocks have ``BLOCK`` fingerprints on average."""

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        values, counts = merge([QuotientFilter(counts=np.array(r.pop("counts"), np.int64), **{k: v for k, v in r.items() if k != "block"}) for r in rows])
        more = counts > 1
        values = values[more] | (U(rows[0]["block"]) << U(rows[0]["bits"]))
        return pa.table([pa.array(values.view(np.int64)), pa.array(counts[more])], ["print", "n"])

    return parts.groupBy("block").applyInArrow(work, "print long, n long")


def sieve(prints: DataFrame, bits: int, most: int = SIEVE) -> tuple[np.ndarray, int]:
    """A bit for each prefix of a repeated fingerprint, and how many bits a prefix has: 32 times as many prefixes as fingerprints, 2^``most`` at most."""
    wide = min(most, bits, max(10, prints.count().bit_length() + 5))
    at = F.shiftrightunsigned("print", bits - wide)
    words = prints.select(F.shiftright(at, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(1, (1 << wide) // 32), np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out, wide


def classes(docs: DataFrame, found: tuple[np.ndarray, int], prints=fingerprint) -> DataFrame:
    """(sha, n): texts that stand in ``n`` > 1 rows, told apart by their bytes. Only texts whose fingerprint passes the sieve leave their task, equal ones of a task once."""
    words = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieved, wide = words.value
        for batch in batches:
            for part in sliced(batch, "text"):
                bodies = normalised(part.column(0))
                code = np.array([prints(b) for b in bodies], np.int64)
                at = (code.view(U) >> U(64 - wide)).astype(np.int64)
                passed = np.flatnonzero((sieved[at >> 5] >> (at & 31).astype(np.uint32)) & 1)
                held = [bodies[i] for i in passed]
                yield pa.record_batch([pa.array(code[passed]), pa.array([hashlib.sha256(b).digest() for b in held], pa.binary()), pa.array([bytes(b) for b in held], pa.binary())], ["print", "sha", "body"])

    groups = docs.select("text").mapInArrow(run, "print long, sha binary, body binary").groupBy("print", "sha", "body").agg(F.count(F.lit(1)).alias("n"))
    told = groups.groupBy("sha").agg(F.count(F.lit(1)).alias("_texts"), F.max("n").alias("n")).where((F.col("n") > 1) | (F.col("_texts") > 1))
    return told.select("sha", F.when(F.col("_texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts have one SHA-256"))).cast("long").alias("n"))


def exact_duplicates(docs: DataFrame, prints=fingerprint) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs(doc_id, text)``.

    Texts are equal if they are identical after lowering A-Z; null counts as empty. Of equal texts
    the row of largest doc_id is kept, null being the least id; of rows equal in both, one.
    ``keep_id`` is the kept row's id, so null if all ids of a group are. Repeated rows, long texts
    and other columns are no special case; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = keep(marks(docs, prints))
    total = rows.count()
    bits, block = layout(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    twice = keep(repeated(filters(rows.select("print"), bits, block), bits))
    best = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("doc_id", "row")).alias("best")).where("_n > 1").drop("_n")
    known = keep(classes(docs, sieve(twice, bits), prints).join(best, "sha").select("sha", "n", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")))
    heavy = F.col("n") * HEAVY > total
    tagged = rows.join(F.broadcast(known.where(heavy)), "sha", "left")
    rest = tagged.where("n is null").select("sha", "row", "doc_id").join(known.where(~heavy), "sha", "left")
    done = tagged.where("n is not null").select(*rest.columns).unionByName(rest)
    single = F.col("n").isNull()
    return done.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_duplicates`` of all ``documents``: null texts are empty, of rows equal in id and text one stays, null ids come last, other columns are ignored, no rows give no rows."""
    return exact_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


#: The same by grouping the texts themselves.
ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
 row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256 FROM t"""

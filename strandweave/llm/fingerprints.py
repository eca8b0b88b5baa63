"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ascending list of the k smallest distinct shingle hashes. Sketches of parts
merge into the sketch of the whole, and two sketches estimate resemblance, containment and the
number of distinct shingles. The algebra (merge, resemblance, ...) is DataFrame columns; the
sketches themselves are cut from whole texts in Arrow batches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm._arrow import Texts, prefix_hash, shingles, sliced, spans, table
from strandweave.llm._ranges import Ranges, exact_cuts, id_and_null, text_bytes, whole_ids
from strandweave.llm._shared import documents

K = 128
SHINGLE = 5
_T = table(5)
#: Hashes lose their last bit so that they fit a long and sort alike in every engine.
TOP = float(2**63)


def sketches(t: Texts, k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """The bottom-k sketch of each text (uint64, ascending, distinct); empty for a text without words."""
    start, end, first = t.words()
    h, owner = shingles(spans(prefix_hash(_T[t.data]), start, end), first, size)
    h = h >> np.uint64(1)
    by_hash = np.argsort(h)
    order = by_hash[np.argsort(owner[by_hash].astype(np.uint16 if len(t) < 65536 else np.int64), kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    bounds = np.searchsorted(owner, np.arange(len(t) + 1))
    return [h[a : min(b, a + k)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance: the share of the k smallest of both sketches that is in both; exact when neither sketch is full, 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    again = both[1:] == both[:-1]
    distinct = both[np.append(True, ~again)]
    n = len(distinct) if max(len(a), len(b)) < k else min(k, len(distinct))
    return float((both[1:][again] <= distinct[n - 1]).sum()) / n


def encode(sketch: np.ndarray) -> str:
    """A sketch as text: base64 of big-endian 64-bit hashes; equal sketches, equal strings."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def fingerprint(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, sketch array<long>, shingles long): bottom-k sketch of each whole text and its exact number of distinct shingles. Null texts count as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                every = sketches(Texts(part.column(1)), np.iinfo(np.int64).max // 2, size)
                rows = [x[:k].astype(np.int64) for x in every]
                counts = pa.array([len(x) for x in every], pa.int64())
                yield pa.record_batch([part.column(0), pa.array(rows, pa.list_(pa.int64())), counts], ["doc_id", "sketch", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sketch array<long>, shingles long")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merged(sketch: Column, k: int = K) -> Column:
    """Aggregate: the sketch of a group of a few parts (the k smallest distinct hashes of all); it gathers their sketches, so use ``merge_groups`` for groups of any size."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(sketch)))), 1, k)


def merge_groups(parts: DataFrame, by: list[str], k: int = K, salts: int = 256) -> DataFrame:
    """``parts(by..., sketch)`` as (by..., sketch): the sketch of each group, however many parts it has.

    Each of ``salts`` shares of a group keeps its k smallest hashes before they meet, so a group
    of a third of all parts is no task's burden. Null and empty sketches add nothing; a group of
    nothing else has an empty sketch.
    """
    rows = parts.select(*by, F.explode_outer("sketch").alias("_h"), F.pmod(F.xxhash64("sketch"), F.lit(salts)).alias("_salt"))
    for share in ([*by, "_salt"], by):
        rows = rows.distinct().withColumn("_n", F.dense_rank().over(Window.partitionBy(*share).orderBy(F.col("_h").asc_nulls_last()))).where(F.col("_n") <= k).select(*share, "_h")
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set("_h")).alias("sketch"))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * F.lit(TOP) / F.element_at(sketch, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketches; 1 for two empty ones."""
    union = merge(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(shared / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too; 1 for an empty a."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def _starts(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of all code points, and the first code point of each text."""
    at = np.flatnonzero((t.data & 0xC0) != 0x80)
    return at, np.searchsorted(at, t.off)


def _compare(t: Texts, k: int) -> dict:
    """All columns of every text but the last, which only serves as the next text of the one before."""
    at, first = _starts(t)
    chars = np.diff(first)
    half = chars // 2
    at = np.append(at, len(t.data))
    data = t.data.tobytes()
    n = len(t) - 1
    cut = np.minimum(at[first[:-1] + chars - half], t.off[1:])
    stop = np.minimum(at[first[1:-1] + np.minimum(half[:-1], chars[1:])], t.off[2:]) if n else np.zeros(0, np.int64)
    edited = [data[t.off[i] : cut[i]] + data[t.off[i + 1] : stop[i]] for i in range(n)]
    own, new = sketches(t, k), sketches(Texts(pa.array(edited, pa.binary())), k)
    return {
        "n_chars": chars[:n], "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
        "fingerprint": [encode(s) for s in own[:n]], "edited_fingerprint": [encode(s) for s in new],
        "near_edited": [likeness(own[i], new[i], k) for i in range(n)], "near_next": [likeness(own[i], own[i + 1], k) for i in range(n)],
    }


#: Fewer rows in a range than this, and rows that share id and text aren't dealt over several.
DEAL = 1000


class _Places:
    """Ranges of the order (doc_id, hash of the text), nulls first; an id that weighs more than a range is cut by hash, and a text of it that still does is dealt by place."""

    def __init__(self, outer: Ranges, inner: dict[int, Ranges]) -> None:
        # an id with hash ranges has as many parts as these
        width = outer.width.copy()
        for i, r in inner.items():
            width[i] = r.parts
        self.outer, self.inner = Ranges(outer.bounds, width), inner

    def part(self, ids: np.ndarray, null: np.ndarray, key: np.ndarray, deal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each row, and the part that stands for all rows of its (id, hash): the same but for a dealt text."""
        i = self.outer.index(ids, null)
        part = self.outer.first[i]
        lead = part.copy()
        for k, r in self.inner.items():
            mine = np.flatnonzero(i == k)
            at, no = key[mine], np.zeros(len(mine), bool)
            part[mine] += r.part(at, no, deal[mine])
            lead[mine] += r.first[r.index(at, no)]
        return part, lead


def _place(key: Column) -> Column:
    """As much of a hash as a double can tell, which quantiles are made of; it ascends with the hash."""
    return F.shiftright(key, 11)


def _places(docs: DataFrame, parts: int) -> _Places:
    whole_ids(docs)
    steps = lambda n: [i / n for i in range(1, n)] or [0.5]
    rows, known, cuts = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.percentile_approx(F.col("doc_id").cast("long"), steps(parts), 10_000)).first()
    nulls = -(-(rows - known) * parts // rows) if rows else 0
    outer = Ranges.of(exact_cuts(docs, cuts or []), nulls)
    # ids with several ranges: at most one for each range
    heavy = {int(outer.bounds[i - 2]): i for i in np.flatnonzero(outer.width > 1).tolist() if i}
    inner = {}
    some = docs.where(F.col("doc_id").isin(list(heavy)) | F.col("doc_id").isNull()) if nulls > 1 else docs.where(F.col("doc_id").isin(list(heavy)))
    if heavy or nulls > 1:
        most = int(outer.width.max())
        found = some.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.percentile_approx(_place(F.xxhash64("text")), steps(most), 10_000).alias("cuts"))
        for r in found.collect():  # one row for each heavy id
            i = 0 if r["id"] is None else heavy[r["id"]]
            wide = int(outer.width[i])
            own = [r["cuts"][j * most // wide - 1] for j in range(1, wide)]
            inner[i] = Ranges.of(own if rows >= DEAL * parts else sorted(set(own)))
    return _Places(outer, inner)


def successors(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``docs(doc_id, text)`` dealt to ranges of ascending (doc_id, hash of the text): adds ``part`` and ``head``.

    Each range also gets the first rows of the next range (``head``; the last range those of the
    first), so every text meets its successor without a global window. Bounds are quantiles, one
    for each of ``parts`` (the shuffle partitions, or one for each 64 MB of text if these are
    more); nulls come first. Parts that hold a share of one repeated (id, text) follow themselves;
    the first of them also gets the head of what comes after it.
    """
    spark = docs.sparkSession
    if parts is None:
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes(docs) >> 26)
    places = _places(docs, parts)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    at = [*id_and_null(), _place(F.col("key"))]

    @F.pandas_udf(T.IntegerType())
    def lead_of(ids: pd.Series, null: pd.Series, key: pd.Series) -> pd.Series:
        none = np.zeros(len(ids), np.int64)
        return pd.Series(places.part(ids.to_numpy(), null.to_numpy(bool), key.to_numpy(), none)[1]).astype("int32")

    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), _place(F.col("key"))))
    heads = keyed.groupBy(lead_of(*at).alias("part")).agg(least.alias("m")).collect()  # one row per range
    first = sorted((r["part"], tuple(r["m"])) for r in heads)
    part_of_head = np.array([p for p, _ in first], np.int64)
    before = np.roll(part_of_head, 1)
    heads_id, heads_known, heads_key = (np.array([m[k] for _, m in first], kind) for k, kind in ((1, np.int64), (0, bool), (2, np.int64)))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def parts_of(ids: pd.Series, null: pd.Series, key: pd.Series, deal: pd.Series) -> pd.Series:
        i, no, k = ids.to_numpy(), null.to_numpy(bool), key.to_numpy()
        part, lead = places.part(i, no, k, deal.to_numpy())
        if not len(part_of_head):
            return pd.Series([[p] for p in part.tolist()])
        slot = np.minimum(np.searchsorted(part_of_head, lead), len(part_of_head) - 1)
        # a dealt text is the head of a range in its first share only
        is_head = (part == lead) & (part_of_head[slot] == lead) & (heads_id[slot] == i) & (heads_known[slot] != no) & (heads_key[slot] == k)
        return pd.Series([[p, b] if h else [p] for p, b, h in zip(part.tolist(), before[slot].tolist(), is_head.tolist(), strict=True)])

    both = F.posexplode(parts_of(*at, F.xxhash64(F.monotonically_increasing_id()))).alias("head", "part")
    return keyed.select("doc_id", "text", "key", both).repartitionById(max(parts, places.outer.parts), "part").sortWithinPartitions("part", "head", "doc_id", "key", "text")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they are.

    The next document is the next row by (doc_id, xxhash64 of the text); of the last row it is the
    first. Null texts are empty; null ids come first; repeated rows follow each other; a lone
    document follows itself. Ids are whole numbers (others raise a ``TypeError``).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def emit(rows: pa.RecordBatch) -> pa.RecordBatch:
        """Results of all rows but the last; one without a successor in its part follows itself."""
        head, part = (rows.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
        own = head == 0
        alone = np.flatnonzero(own[:-1] & (part[:-1] != part[1:]))
        if len(alone):
            at = np.sort(np.concatenate([np.arange(rows.num_rows), alone]))
            again = np.append(False, at[1:] == at[:-1])
            rows, own = rows.take(pa.array(at)), own[at] & ~again
        out = _compare(Texts(rows.column(1)), k)
        both = pa.record_batch([rows.column(0).slice(0, rows.num_rows - 1), *[pa.array(v) for v in out.values()]], names)
        return both.filter(pa.array(own[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row still waits for its successor
        for batch in batches:
            for rows in sliced(batch):
                if held is not None:
                    rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                if rows.num_rows > 1:
                    yield emit(rows)
                held = rows.slice(rows.num_rows - 1)
        if held is not None and held.column(2)[0].as_py() == 0:
            yield emit(held.take(pa.array([0, 0])))

    return successors(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "text", "head", "part").mapInArrow(run, schema)


def op5_bottom_k(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """``fingerprint_edits`` of all ``documents``: null texts are empty, null ids come first, rows with one id go by text, repeated rows follow each other, other columns are ignored, no rows give none. Ids are numbers."""
    return fingerprint_edits(documents(spark, sf_dir), k)

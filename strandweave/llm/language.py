"""Language identification with string kernels.

phi(x) marks which byte n-grams (n = 1..4, letters lowered, everything else a blank) occur in a
text, hashed to ``BITS`` positions; k(x, y) is the cosine of two such presence vectors. Nystrom
landmarks turn the kernel into explicit features, and one ridge regression per language (one
versus rest) is solved in closed form. Scoring a slice is two matrix products.

The fit reads a bounded sample: ``PER_LANG`` rows of each language, those of smallest hash of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm._arrow import Texts, sliced
from strandweave.llm._shared import documents, keep

GRAMS = (1, 2, 3, 4)
BITS = 13
PER_LANG = 500
#: Presence rows that are worked on at once: 16 MB, however short their texts are.
ROWS = 512
LANDMARKS = 192
RIDGE = 1e-3
SHARP = 4.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def presence(t: Texts) -> np.ndarray:
    """A 0/1 row per text: which hashed n-grams its bytes hold. Grams of blanks only aren't counted."""
    size = 1 << BITS
    out = np.zeros((len(t), size), np.float32)
    flat = out.reshape(-1)
    d = _FOLD[t.data].astype(np.uint32)
    owner = np.repeat(np.arange(len(t), dtype=np.int64), np.diff(t.off))
    row = owner * size
    code = np.zeros(len(d), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        m = len(d) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(0x01000193) + d[n - 1 :]
        if n not in GRAMS:
            continue
        h = (code ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
        at = row[:m] + h
        inside = owner[:m] == owner[n - 1 :]
        flat[at if inside.all() else at[inside]] = 1
    return out


def kernel(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Cosines of presence rows; 0 for a text without grams."""
    nx = np.sqrt(np.maximum(x.sum(1), 1))
    nm = np.sqrt(np.maximum(marks.sum(1), 1))
    return (x @ marks.T) / nx[:, None] / nm[None, :]


def training(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(lang, text): at most ``per_lang`` rows of each language outside the held-out quarter, those of smallest hash of id and text.

    Rows equal in id, text and language are one; rows that share only an id are as many as they are.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    known = known.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("_h"))
    each = known.select("lang", "_h").distinct()
    # rows far above the smallest hashes of their language never reach its window
    sizes = each.groupBy(F.col("lang").alias("_l")).agg(F.count(F.lit(1)).alias("_many"))
    near = each.join(sizes, F.col("lang") == F.col("_l")).where(F.col("_h").cast("double") * F.col("_many") <= F.lit(4.0 * per_lang * (1 << 40)))
    first = Window.partitionBy("lang").orderBy("_h")
    chosen = near.select("lang", "_h", F.row_number().over(first).alias("_n")).where(F.col("_n") <= per_lang).drop("_n")
    return known.join(F.broadcast(chosen), ["lang", "_h"]).dropDuplicates(["lang", "_h"]).select("lang", "text")  # per_lang keys a language


def fit(sample: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """Landmarks, their whitening and one weight column per language. Presence rows reach the driver as packed bits."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", rows=ROWS):
                bits = np.packbits(presence(Texts(part.column(1))).astype(bool), axis=1)
                yield pa.record_batch([part.column(0), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "bits"])

    table = sample.mapInArrow(pack, "lang string, bits binary").toPandas().sort_values(["lang", "bits"], ignore_index=True)
    langs = sorted(table["lang"].unique())
    if not langs:
        return {"langs": []}
    x = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in table["bits"]]), axis=1)
    code = np.searchsorted(langs, table["lang"].to_numpy(str))
    share = max(1, landmarks // len(langs))
    chosen = np.concatenate([at[np.unique(np.linspace(0, len(at) - 1, min(share, len(at))).astype(int))] for k in range(len(langs)) for at in [np.flatnonzero(code == k)]])
    marks = x[chosen].astype(np.float32)
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    good = values > values.max() * 1e-6
    white = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([kernel(x[i : i + 500].astype(np.float32), marks) @ white for i in range(0, len(x), 500)])
    phi = np.concatenate([phi, np.ones((len(phi), 1))], 1)
    y = np.where(code[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = 1.0 / np.bincount(code, minlength=len(langs))[code]  # languages count alike
    left = phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1]) * weight.sum() / len(phi)
    solved = np.linalg.solve(left, phi.T @ (y * weight[:, None]))
    return {"langs": [str(x) for x in langs], "marks": marks, "project": (white @ solved[:-1]).astype(np.float32), "bias": solved[-1]}


def predict(model: dict, t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language of each text and its softmax share."""
    # einsum: a row's result doesn't depend on the other rows; the kernel's counts are whole numbers anyway
    f = np.einsum("ij,jk->ik", kernel(presence(t), model["marks"]), model["project"], optimize=False) + model["bias"]
    best = f.argmax(1)
    e = np.exp(SHARP * (f - f.max(1, keepdims=True)))
    return best, (e.max(1) / e.sum(1)).astype(float)


def with_language(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, lang_pred, score). Null texts and texts without a letter are ``und`` with score 0; so is all if nothing was learned."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", rows=ROWS):
                best, share = predict(model, Texts(part.column(1)))
                names = np.array(model["langs"], object)[best]
                lettered = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                names[~lettered], share[~lettered] = "und", 0.0
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    if not model["langs"]:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select("doc_id", "text", lettered).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``documents``.

    A prediction is a function of the text alone; rows with one id and repeated rows are predicted
    one by one, long texts whole; a null id is not held out, but is in no fit. Other columns are
    ignored; an empty table gives an empty result.
    """
    docs = documents(spark, sf_dir)
    model = fit(keep(training(docs)))
    return with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out"), "lang_pred", "score"
    )

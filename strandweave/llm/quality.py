"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` bytes each, the whole text). Each passage is
described by shares of character classes and word shapes, encoded by a learned layer, and given
a gated attention weight; the weighted mean of the encodings is what the label's logistic
regression sees. Weights, encoder and regression are learned together from document labels.

The fit reads a bounded sample of labelled rows (``FIT_ROWS``, smallest id hash first, and of
whole texts with about ``FIT_PASSAGES`` passages together). A score is a function of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm._arrow import SPACE, Texts, prefix_hash, sliced, spans, table
from strandweave.llm._shared import documents, keep, labels, within

FIT_ROWS = 6_000
FIT_PASSAGES = 400_000
PASSAGE = 512
HIDDEN = 16
GATE = 8
EPOCHS = 40
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1  # capitals
_CLASS[48:58] = 2  # digits
_CLASS[[33, 63]] = 3  # ! ?
_CLASS[[124, 62, 60]] = 4  # | > <
_CLASS[[35, 36, 37, 38, 42, 64, 94, 95, 126, 43, 61]] = 5  # signs
_CLASS[[46, 44, 59, 58]] = 6  # stops
_CLASS[10] = 7  # line ends
_CLASS[[47, 92, 40, 41, 91, 93, 123, 125, 34, 39, 45]] = 8
_CLASS[SPACE.nonzero()[0]] = np.where(SPACE.nonzero()[0] == 10, 7, 9)
_CLASS[128:] = 10
WIDTH = 11 + 6
_T = table(10)


def passages(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the passages (as one rising array over the buffer) and passages per text; an empty text has one empty passage."""
    size = np.diff(t.off)
    per = np.maximum(1, -(-size // PASSAGE))
    owner = np.repeat(np.arange(len(t)), per)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    return np.append(np.minimum(t.off[:-1][owner] + k * PASSAGE, t.off[1:][owner]), t.off[-1]), per


def describe(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and passages per text."""
    bounds, per = passages(t)
    n, size = len(bounds) - 1, np.maximum(np.diff(bounds), 1)
    out = np.zeros((n, WIDTH), np.float32)
    where = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(where * 11 + _CLASS[t.data], minlength=n * 11).reshape(n, 11)
    out[:, :11] = counts / size[:, None]
    start, end, first = t.words()
    if len(start):
        home = np.searchsorted(bounds, start, "right") - 1
        length = end - start
        words = np.bincount(home, minlength=n)
        per_word = np.maximum(words, 1)
        out[:, 11] = np.bincount(home, length, n) / per_word / 10
        out[:, 12] = np.bincount(home, length <= 2, n) / per_word
        out[:, 13] = np.bincount(home, length > 14, n) / per_word
        # words met before in the passage, and pairs of words met before in the document
        h = spans(prefix_hash(_T[t.data]), start, end)
        out[:, 14] = np.bincount(home, _seen(h, home), n) / per_word
        owner = np.repeat(np.arange(len(t)), np.diff(first))
        both = np.flatnonzero(owner[1:] == owner[:-1])  # the last word of a text has no pair
        pair = h[both] + h[both + 1] * np.uint64(0x9E3779B97F4A7C15)
        out[:, 15] = np.bincount(home[both], _seen(pair, owner[both]), n) / per_word
    out[:, 16] = np.log1p(np.diff(bounds)) / 8
    return out, per


def _seen(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether an equal key stood earlier in the same group."""
    joint = (keys ^ (group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
    order = np.argsort(joint, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = joint[order[1:]] == joint[order[:-1]]
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b whose rows don't depend, to the last bit, on how many others there are."""
    return np.einsum("ij,jk->ik", a, b, optimize=False)


def forward(m: dict, x: np.ndarray, per: np.ndarray) -> dict:
    """Encodings, gated attention and the bag's log odds."""
    first = np.cumsum(per) - per
    h = np.tanh(times((x - m["mean"]) / m["scale"], m["W"]) + m["b"])
    a, g = np.tanh(times(h, m["V"])), 1 / (1 + np.exp(-times(h, m["G"])))
    s = times(a * g, m["w"][:, None])[:, 0]
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), per))
    p = e / np.repeat(np.add.reduceat(e, first), per)
    z = np.add.reduceat(h * p[:, None], first)
    return {"h": h, "a": a, "g": g, "p": p, "z": z, "logit": times(z, m["c"][:, None])[:, 0] + m["d"], "first": first}


def learn(x: np.ndarray, per: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.01) -> dict:
    """Adam on the log loss of bags; deterministic for given rows."""
    rng = np.random.default_rng(10)
    m = {"mean": x.mean(0), "scale": x.std(0) + 1e-3, "W": rng.normal(0, 0.3, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "G": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": np.zeros(HIDDEN), "d": np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))}
    names = ["W", "b", "V", "G", "w", "c", "d"]
    mean, var = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}
    start = np.cumsum(per) - per
    step = 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            bags = order[lo : lo + batch]
            n = per[bags]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[bags], n)
            xb = x[at]
            f = forward(m, xb, n)
            out = (1 / (1 + np.exp(-f["logit"])) - y[bags]) / len(bags)
            dz = out[:, None] * m["c"]
            rep = np.repeat(np.arange(len(bags)), n)
            dp = (f["h"] * dz[rep]).sum(1)
            ds = f["p"] * (dp - np.add.reduceat(f["p"] * dp, f["first"])[rep])
            da = ds[:, None] * m["w"] * f["g"] * (1 - f["a"] ** 2)
            dg = ds[:, None] * m["w"] * f["a"] * f["g"] * (1 - f["g"])
            dh = (f["p"][:, None] * dz[rep] + da @ m["V"].T + dg @ m["G"].T) * (1 - f["h"] ** 2)
            grad = {"W": ((xb - m["mean"]) / m["scale"]).T @ dh, "b": dh.sum(0), "V": f["h"].T @ da, "G": f["h"].T @ dg, "w": ((f["a"] * f["g"]) * ds[:, None]).sum(0), "c": f["z"].T @ out, "d": out.sum()}
            step += 1
            for k in names:
                mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
                var[k] = 0.999 * var[k] + 0.001 * grad[k] ** 2
                m[k] = m[k] - lr * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return m


def labelled(docs: DataFrame, marks: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, y): labelled rows outside the held-out fifth, smallest id hash first, equal texts once; of several labels the lowest counts.

    Rows without id, text or a 0/1 label are left out.
    """
    known = marks.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")  # at most ``rows`` narrow rows; ids may be shared, so the texts are bounded after this
    return found.groupBy("text").agg(F.min("y").alias("y"))


def train(docs: DataFrame, marks: DataFrame, rows: int = FIT_ROWS) -> dict:
    """The fitted model; with labels of one kind only (or none) the score is that constant (1 without labels)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                x, per = describe(Texts(part.column(0)))
                bags = np.split(x.astype(np.float32), np.cumsum(per)[:-1])
                yield pa.record_batch([pa.array([b.tobytes() for b in bags], pa.binary()), part.column(1)], ["x", "y"])

    sample = within(keep(labelled(docs, marks, rows)), rows)
    many = sample.agg(F.sum(F.ceil(F.octet_length("text") / PASSAGE))).first()[0] or 0
    if many > FIT_PASSAGES:  # whole texts go, by hash
        sample = sample.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(FIT_PASSAGES / many * (1 << 30)))
    rows_ = sample.mapInArrow(measure, "x binary, y int").toPandas().sort_values(["y", "x"], ignore_index=True)
    y = rows_["y"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 1.0}
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows_["x"]]
    return learn(np.concatenate(bags).astype(float), np.array([len(b) for b in bags]), y)


def score(model: dict, t: Texts) -> np.ndarray:
    if "constant" in model:
        return np.full(len(t), model["constant"])
    x, per = describe(t)
    return 1 / (1 + np.exp(-forward(model, x, per)["logit"]))


def with_score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, score, passages): the bag's score and how many passages it was read in."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                t = Texts(part.column(1))
                yield pa.record_batch([part.column(0), pa.array(score(model, t)), pa.array(passages(t)[1])], ["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, passages long")


def op10_quality(spark: SparkSession, sf_dir: str, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``.

    Null and empty texts are scored as one empty passage, long ones whole; repeated rows and rows
    with one id are scored one by one; a null id counts as held out (it is in no fit). Other
    columns are ignored; an empty table gives an empty result.
    """
    docs = documents(spark, sf_dir)
    scored = with_score(docs, train(docs, labels(spark, sf_dir), rows))
    return scored.select(
        "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages",
    )

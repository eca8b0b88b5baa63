"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features are rates, so long and short texts compare: densities of a fixed and of a learned
lexicon, closeness of lexicon words to a second person, capitals, punctuation and obfuscation
(letters mixed with digits or signs inside a word, stretched letters, spelled-out letters).
The learned lexicon holds word stems that labelled toxic rows use and others don't.

The model is fitted on a bounded sample of labelled rows (``FIT_ROWS``, rows of smallest id
hash, each text once); scoring reads every row and whole texts, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm._arrow import Texts, frugal, mix, owners, prefix_hash, sliced, spans, sums, table
from strandweave.llm._shared import documents, keep, labels, within
from strandweave.llm._trees import fit_isotonic, fit_trees, predict_isotonic, predict_trees

FIT_ROWS = 20_000
THRESHOLD = 0.3
LEXICON = 512
FOLDS = 4
#: Stem counts that a task holds at once.
HELD = 1_000_000
#: Insults looked for from the start.
INSULTS = "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown clowns dumb fool jerk ugly filth garbage".split()
#: Second-person words in the four languages.
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú ti usted tus vosotros".split()
NEAR = 5
STEMS = (4, 5, 6)
NAMES = (
    "insult_rate", "insult_log", "learned_rate", "learned_log", "near_second", "second_rate", "capital_rate", "capital_word_rate",
    "mark_rate", "exclaim_rate", "mixed_rate", "stretched_rate", "single_rate", "words_log",
)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_T = table(8)


def _keys_of(words: list[str]) -> np.ndarray:
    t = Texts(pa.array(words))
    return np.sort(spans(prefix_hash(_T[LOWER[t.data]]), t.off[:-1], t.off[1:]))


def _within(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys


def _letters(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters: starts, ends, first run of each text, running hash of the lowered bytes."""
    return *t.runs(LETTER), prefix_hash(_T[LOWER[t.data]])


def stem_keys(start: np.ndarray, end: np.ndarray, running: np.ndarray) -> list[np.ndarray]:
    """For each word the keys of its stems (4, 5, 6 bytes) and of the whole word, told apart by kind."""
    out = [mix(spans(running, start, np.minimum(start + n, end)) + np.uint64(n)) for n in STEMS]
    return [*out, mix(spans(running, start, end) + np.uint64(99))]


def features(t: Texts, lexicon: np.ndarray) -> np.ndarray:
    """One row of NAMES per text; all zero for an empty text."""
    n = len(t)
    start, end, first, running = _letters(t)
    words = np.maximum(np.diff(first), 1)
    keys = spans(running, start, end)
    insult = _within(keys, _INSULTS)
    second = _within(keys, _SECOND)
    learned = np.zeros(len(start), bool)
    for x in stem_keys(start, end, running):
        learned |= _within(x, lexicon)
    hit = insult | learned
    near = np.zeros(len(start) + 1, np.int64)
    np.cumsum(second, out=near[1:])
    owner = owners(first)
    lo = np.maximum(np.arange(len(start)) - NEAR, first[:-1][owner])
    hi = np.minimum(np.arange(len(start)) + NEAR + 1, first[1:][owner])
    close = hit & (near[hi] > near[lo])
    d = t.data
    size = np.maximum(np.diff(t.off), 1)
    letters = np.maximum(sums(LETTER[d], t.off), 1)
    capitals = np.zeros(len(d) + 1, np.int64)
    np.cumsum(UPPER[d], out=capitals[1:])
    shouted = (capitals[end] - capitals[start] == end - start) & (end - start > 1)
    wstart, wend, wfirst = t.words()
    solid = np.zeros(len(d) + 1, np.int64)
    np.cumsum(LETTER[d], out=solid[1:])
    inside = solid[wend - 1] - solid[np.minimum(wstart + 1, wend - 1)] if len(wstart) else np.zeros(0, np.int64)
    mixed = LETTER[d[wstart]] & LETTER[d[wend - 1]] & (wend - wstart > 2) & (inside < wend - wstart - 2) if len(wstart) else np.zeros(0, bool)
    stretched = np.zeros(len(d), bool)
    if len(d) > 2:
        stretched[2:] = (d[2:] == d[1:-1]) & (d[1:-1] == d[:-2]) & LETTER[d[2:]]
        head = t.off[:-1]  # the first two bytes of a text have no two before them
        stretched[head[head < len(d)]] = False
        stretched[(head + 1)[head + 1 < len(d)]] = False
    wordn = np.maximum(np.diff(wfirst), 1)
    hits, insults = sums(learned, first), sums(insult, first)
    out = np.empty((n, len(NAMES)))
    for k, x in enumerate((
        insults / words, np.log1p(insults), hits / words, np.log1p(hits), sums(close, first) / words, sums(second, first) / words,
        sums(UPPER[d], t.off) / letters, sums(shouted, first) / words, sums(MARK[d], t.off) / size, sums(d == 33, t.off) / size,
        sums(mixed, wfirst) / wordn, sums(stretched, t.off) / size, sums(end - start == 1, first) / words, np.log1p(np.diff(wfirst)),
    )):
        out[:, k] = x
    return out


_INSULTS, _SECOND = _keys_of(INSULTS), _keys_of(SECOND)


def labelled(docs: DataFrame, marks: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The bounded fit sample: (text, y, fold), rows with a 0/1 label outside the held-out quarter, smallest id hash first, equal texts once.

    A document with several labels counts as toxic if one says so.
    """
    known = marks.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")  # at most ``rows`` narrow rows; ids may be shared, so the texts are bounded after this
    return found.groupBy("text").agg(F.max("y").alias("y")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))


def stem_counts(sample: DataFrame) -> DataFrame:
    """For each stem key and fold of the sample: texts that hold it (n) and toxic ones among them (t)."""

    def total(key: np.ndarray, fold: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((fold, key))
        key, fold = key[order], fold[order]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (fold[1:] != fold[:-1]))) if len(key) else np.zeros(0, np.int64)
        add = lambda x: np.add.reduceat(x[order], new) if len(new) else x[:0]
        return key[new], fold[new], add(t), add(n)

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # counts of slices, joined before they grow large

        def flush() -> pa.RecordBatch:
            key, fold, t, n = total(*[np.concatenate(x) for x in zip(*held, strict=True)])
            held.clear()
            return pa.record_batch([pa.array(key.view(np.int64)), pa.array(fold), pa.array(t), pa.array(n)], ["k", "fold", "t", "n"])

        for batch in batches:
            for part in sliced(batch):
                start, end, first, running = _letters(Texts(part.column(0)))
                y, fold = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                owner = owners(first)
                for x in stem_keys(start, end, running):
                    key, of = _pairs(x, owner)
                    held.append(total(key, fold[of], y[of].astype(np.int64), np.ones(len(key), np.int64)))
                if sum(len(h[0]) for h in held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return sample.mapInArrow(count, "k long, fold int, t long, n long").groupBy("k", "fold").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def learn_lexicons(sample: DataFrame, size: int = LEXICON) -> list[np.ndarray]:
    """Keys of stems that toxic rows use: in at least 3 texts and 1 % of the toxic ones, four in five of its texts toxic.

    One lexicon for each fold, learned from the other folds (its features for the fit then don't
    know their own labels), and last the one of all rows.
    """
    counts = stem_counts(sample)
    totals = [r["t"] for r in sample.groupBy("fold").agg(F.sum("y").alias("t")).collect()]
    least = max(3, int(sum(totals) * 0.01))
    skip = F.explode(F.array(*[F.lit(k) for k in range(-1, FOLDS)]))
    good = keep(
        counts.withColumn("skip", skip).where("fold != skip").groupBy("skip", "k").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        .where((F.col("t") >= least) & ((F.col("t") + 0.5) / (F.col("n") + 1) >= 0.8))
    )
    # the first ``size`` of each skip without a window over all of them
    out = {k: [r["k"] for r in good.where(F.col("skip") == k).orderBy(F.desc("t"), "k").limit(size).collect()] for k in range(-1, FOLDS)}
    return [np.sort(np.array(out[k], np.int64).view(np.uint64)) for k in (*range(FOLDS), -1)]


def _pairs(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, owner)."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return k[new], o[new]


def train(docs: DataFrame, marks: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Lexicon, trees and calibration. With labels of one kind only (or none) the score is that constant (0 without labels)."""
    sample = within(keep(labelled(docs, marks, rows)), rows)
    *folds, lexicon = learn_lexicons(sample)

    @frugal
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                t, fold = Texts(part.column(0)), part.column(2).to_numpy(zero_copy_only=False)
                x = np.zeros((len(t), len(NAMES)))
                for k in np.unique(fold):
                    x[fold == k] = features(t, folds[k])[fold == k]
                yield pa.record_batch([pa.array(list(x)), part.column(1)], ["x", "y"])

    table = sample.mapInArrow(measure, "x array<double>, y int").toPandas()
    x = np.array(table["x"].tolist()).reshape(len(table), len(NAMES))
    y = table["y"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the sample's order is Spark's; the fit mustn't depend on it
    x, y = x[order], y[order]
    if len(y) == 0 or y.min() == y.max():
        return {"lexicon": lexicon, "constant": float(y.mean()) if len(y) else 0.0}
    check = np.arange(len(y)) % 5 == 4
    if y[check].min() == y[check].max() or y[~check].min() == y[~check].max():
        check = np.zeros(len(y), bool)
    trees = fit_trees(x[~check], y[~check])
    held = check if check.any() else np.ones(len(y), bool)
    return {"lexicon": lexicon, "trees": trees, "isotonic": fit_isotonic(predict_trees(trees, x[held]), y[held])}


def score(model: dict, t: Texts) -> np.ndarray:
    if "constant" in model:
        return np.full(len(t), model["constant"])
    return predict_isotonic(model["isotonic"], predict_trees(model["trees"], features(t, model["lexicon"])))


def with_score(docs: DataFrame, model: dict, column: str = "toxicity") -> DataFrame:
    """``docs`` plus the calibrated score in [0, 1] of each whole text; null and empty texts are scored as a text without words."""
    docs = docs.drop(column)
    names = docs.columns
    at = names.index("text")
    schema = docs.withColumn(column, F.lit(0.0)).schema

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, batch.schema.field(at).name):
                s = score(model, Texts(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*names, column])

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``.

    A score is a function of the text alone: null and empty texts are scored as a text without
    words, long ones whole, repeated rows and rows with one id one by one. A null id is not held
    out, but is in no fit. Other columns are ignored; an empty table gives an empty result.
    """
    docs = documents(spark, sf_dir)
    model = train(docs, labels(spark, sf_dir), rows)
    scored = with_score(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, marks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score below the threshold, with the columns of ``docs``.

    Each row is judged by its own text: rows that share an id, have none or are repeated stay or
    go one by one; null and empty texts are scored as a text without words.
    """
    return with_score(docs, train(docs, marks), "__sw_toxicity").where(F.col("__sw_toxicity") < threshold).drop("__sw_toxicity")

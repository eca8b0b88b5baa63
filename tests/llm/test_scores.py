"""Scores and fingerprints depend on the text alone, and are what plain Python makes of it."""

import base64
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.llm import _trees, fingerprints, language, quality, toxicity
from strandweave.llm._arrow import Texts
from tests.llm.test_operators import corpus, grams, vocabulary

MORE = ["elephants are fine", "see", "aaa bbb", "ee", "e", "you idiot!!! sooo bad", "IDIOT", "a b c d e f", "x", "", "Ünï cödé wörds", "we " * 900]


def texts():
    return [t or "" for _, t, *_ in corpus()] + MORE


def orders(rows):
    """All together, reversed, shuffled, and one by one: the places of the rows in each batch."""
    every = list(range(len(rows)))
    mixed = every[:]
    random.Random(3).shuffle(mixed)
    return [[every], [every[::-1]], [mixed], [[i] for i in every]]


def alike(rows, work):
    """What ``work`` gives for every row must not depend on the batch around it."""
    seen = []
    for batches in orders(rows):
        out = {}
        for batch in batches:
            out |= dict(zip(batch, work([rows[i] for i in batch]), strict=True))
        seen.append([out[i] for i in range(len(rows))])
    for other in seen[1:]:
        assert other == seen[0]
    return seen[0]


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(1)
    x = toxicity.features(Texts(pa.array(texts())), np.zeros(0, np.uint64))
    x = np.concatenate([x + rng.normal(0, 0.02, x.shape) for _ in range(6)])
    y = (x[:, 0] + x[:, 11] + 0.2 * x[:, 6] + rng.normal(0, 0.05, len(x)) > 0.1).astype(float)
    trees = _trees.fit_trees(x, y)
    return {"lexicon": np.zeros(0, np.uint64), "trees": trees, "isotonic": _trees.fit_isotonic(_trees.predict_trees(trees, x), y)}


@pytest.fixture(scope="module")
def quality_model():
    x, per = quality.describe(Texts(pa.array(texts())))
    y = np.array([float(len(t) % 3 == 0) for t in texts()])
    return quality.learn(x.astype(float), per, y, epochs=5)


@pytest.fixture(scope="module")
def language_model(spark):
    rows = [(i, t, "en" if i % 2 else "xx") for i, t in enumerate(texts())]
    return language.fit(language.training(spark.createDataFrame(rows, "doc_id long, text string, lang string")))


def test_language_scores_are_alone(language_model):
    def work(rows):
        best, share = language.predict(language_model, Texts(pa.array(rows)))
        return list(zip(best.tolist(), share.tolist(), strict=True))

    alike(texts(), work)


def test_toxicity_scores_are_alone(toxic_model):
    got = alike(texts(), lambda rows: [tuple(x) for x in toxicity.features(Texts(pa.array(rows)), toxic_model["lexicon"]).tolist()])
    assert got[texts().index("elephants are fine")][11] == 0.0 and got[texts().index("aaa bbb")][11] == 2 / 7
    alike(texts(), lambda rows: toxicity.score(toxic_model, Texts(pa.array(rows))).tolist())


def test_quality_scores_are_alone(quality_model):
    alike(texts(), lambda rows: quality.score(quality_model, Texts(pa.array(rows))).tolist())


def test_sketches_are_alone():
    alike(texts(), lambda rows: [tuple(s.tolist()) for s in fingerprints.sketches(Texts(pa.array(rows)), 32)])


# --- against plain Python ---------------------------------------------------------------------


def test_kernel_is_the_cosine_of_ngram_sets():
    rows = ["the cat sat on the mat", "THE CAT, sat!", "zzz", "", "dog days", "ñandú 日本"]
    x = language.presence(Texts(pa.array(rows)))

    def ngrams(t):
        b = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in t.encode())
        out = set()
        for n in language.GRAMS:
            for i in range(len(b) - n + 1):
                h = 0
                for c in b[i : i + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                h = ((h ^ (n * 0x3C6EF372 & 0xFFFFFFFF)) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
                out.add(((h * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - language.BITS))
        return out

    sets = [ngrams(t) for t in rows]
    assert [set(np.flatnonzero(r)) for r in x] == sets
    want = [[len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1)) for b in sets] for a in sets]
    assert language.kernel(x, x) == pytest.approx(np.array(want), abs=1e-6)


def test_language_scores_are_those_of_the_regression(language_model):
    rows = texts()[:40]
    x, m = language.presence(Texts(pa.array(rows))), language_model["marks"]
    best, share = language.predict(language_model, Texts(pa.array(rows)))
    for i in range(len(rows)):
        k = [float(x[i] @ m[j]) / math.sqrt(max(x[i].sum(), 1) * max(m[j].sum(), 1)) for j in range(len(m))]
        f = [sum(a * float(w) for a, w in zip(k, language_model["project"][:, c], strict=True)) + language_model["bias"][c] for c in range(2)]
        e = [math.exp(language.SHARP * v) for v in f]
        assert share[i] == pytest.approx(max(e) / sum(e), rel=1e-4) and (abs(f[0] - f[1]) < 1e-4 or best[i] == f.index(max(f)))


def test_trees_and_calibration_walk(toxic_model):
    x = toxicity.features(Texts(pa.array(texts())), toxic_model["lexicon"])
    got = toxicity.score(toxic_model, Texts(pa.array(texts())))
    xs, ys = (v.tolist() for v in toxic_model["isotonic"])
    assert ys == sorted(ys)
    for i, row in enumerate(x.tolist()):
        f = toxic_model["trees"]["base"]
        for splits, leaf in toxic_model["trees"]["trees"]:
            node = 0
            for col, cut in splits:
                node = 2 * node + (row[col[node]] > cut[node])
            f += leaf[node]
        k = next((k for k, v in enumerate(xs) if v >= f), len(xs))
        want = ys[0] if k == 0 else ys[-1] if k == len(xs) else ys[k] if xs[k] == f else ys[k - 1] + (ys[k] - ys[k - 1]) * (f - xs[k - 1]) / (xs[k] - xs[k - 1])
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(2)
    f, y = rng.normal(size=40), rng.integers(0, 2, 40).astype(float)
    got = _trees.predict_isotonic(_trees.fit_isotonic(f, y), np.sort(f))
    y = y[np.argsort(f)]
    want = [max(min(y[a : b + 1].mean() for b in range(k, 40)) for a in range(k + 1)) for k in range(40)]  # the min-max formula
    assert got == pytest.approx(want)


def test_attention_pass(quality_model):
    m, rows = quality_model, texts()
    x, per = quality.describe(Texts(pa.array(rows)))
    got = quality.score(m, Texts(pa.array(rows)))
    at = 0
    for i, n in enumerate(per.tolist()):
        assert n == max(1, -(-len(rows[i].encode()) // quality.PASSAGE))
        h = [[math.tanh(sum((float(x[at + p, j]) - m["mean"][j]) / m["scale"][j] * m["W"][j, k] for j in range(x.shape[1])) + m["b"][k]) for k in range(quality.HIDDEN)] for p in range(n)]
        s = [sum(math.tanh(sum(h[p][k] * m["V"][k, g] for k in range(quality.HIDDEN))) / (1 + math.exp(-sum(h[p][k] * m["G"][k, g] for k in range(quality.HIDDEN)))) * m["w"][g] for g in range(quality.GATE)) for p in range(n)]
        e = [math.exp(v - max(s)) for v in s]
        z = [sum(e[p] * h[p][k] for p in range(n)) / sum(e) for k in range(quality.HIDDEN)]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(z, m["c"], strict=True)) - float(m["d"]))), abs=1e-9)
        at += n


def test_near_edited_and_near_next(spark):
    rows = [(i, t) for i, t in enumerate(texts()) if "\0" not in t][:60]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()}

    def sketch(t):
        return np.sort(np.array([fingerprints.sketches(Texts(pa.array([t])), 10**6)[0]], np.uint64).ravel())[:16].tolist()

    def near(a, b):
        if not a and not b:
            return 1.0
        union = sorted({*a, *b})
        if max(len(a), len(b)) >= 16:
            union = union[:16]
        return len({*a} & {*b} & {*union}) / len(union)

    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, e, b = sketch(t), sketch(edited), sketch(nxt)
        assert len(a) == min(16, len(grams(t)))
        assert [struct.unpack(f">{len(s)}Q", base64.b64decode(x)) for s, x in ((a, got[i].fingerprint), (e, got[i].edited_fingerprint))] == [tuple(a), tuple(e)]
        assert got[i].near_edited == pytest.approx(near(a, e)) and got[i].near_next == pytest.approx(near(a, b))


def test_sketches_of_groups_merge_in_shares(spark):
    rows = [(i % 3, t) for i, t in enumerate(texts())] + [(7, ""), (7, None), (None, "a b c d e f g")]
    frame = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(rows)], "doc_id long, g int, text string")
    parts = fingerprints.fingerprint(frame, 16).join(frame.select("doc_id", "g"), "doc_id")
    got = {r.g: r.sketch for r in fingerprints.merge_groups(parts, ["g"], 16, 4).collect()}
    every = {g: set() for g, _ in rows}
    for r in parts.collect():
        every[r.g] |= set(r.sketch)
    assert got == {g: sorted(x)[:16] for g, x in every.items()} and got[7] == [] and len(got[0]) == 16


# --- awkward rows -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op7", "op8", "op10"])
def test_awkward_rows(spark, tmp_path, name):
    """Null and repeated ids, repeated rows, a very long text, columns with the operators' names."""
    rng = random.Random(7)
    words = vocabulary(300, 7)
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, ("idiot you " if i % 3 == 0 else "") + make(rng.randint(3, 60)), ("en", "de")[i % 2]) for i in range(120)]
    rows += [(None, "idiot you fool", "en"), (None, None, None), (5, rows[5][1], "en"), (5, rows[5][1], "en"), (5, make(9), "de"), (300, make(60_000), "en"), (301, "", "en")]
    extra = "score double, predicted int, bits binary, x string, y int, fold int, lettered boolean, _h long, _many long, passages long, toxicity double"
    spark.createDataFrame([(*r, 0.5, 1, b"", "", 2, 3, True, 4, 5, 6, 0.1) for r in rows], f"doc_id long, text string, lang string, {extra}").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, int(i % 4 > 0), int(i % 3 == 0), 1) for i in range(120)] + [(None, 1, 1, 1), (7, None, None, 1), (8, 1, 0, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int, y int").write.parquet(str(tmp_path / "labels.parquet"))
    query = {"op7": language.op7_language, "op8": toxicity.op8_toxicity, "op10": quality.op10_quality}[name]
    out = query(spark, str(tmp_path)).collect()
    mod, rest = {"op7": (4, 2), "op8": (4, 2), "op10": (5, 0)}[name]
    assert sorted(map(str, [r.doc_id for r in out])) == sorted(str(r[0]) for r in rows)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in out)
    again = query(spark, str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    fives = [r.score for r in out if r.doc_id == 5]
    assert len(fives) == 4 and len(set(fives)) <= 2
    spark.read.parquet(str(tmp_path / "documents.parquet")).where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).where("false").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert query(spark, str(tmp_path / "none")).count() == 0
    if name == "op8":
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        kept = toxicity.reject_toxic(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
        assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.3 for r in out) and kept.where(F.col("toxicity") != 0.1).count() == 0

"""Decontamination: the SVD against numpy's, candidates and decisions against all pairs, awkward rows."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandweave.llm import decontaminate
from tests.llm.test_operators import SCHEMA, vocabulary


def all_pairs(docs, items):
    """Every (document, item) pair that both checks accept in some window, without any filter."""
    texts = [re.findall("[a-z0-9]+", (t or "").lower()) for t in docs]
    found = collections.Counter(w for t in texts for i in range(0, len(t), 64) for w in set(t[i : i + 64]))
    lengths = sorted(decontaminate.WINDOWS)
    out = set()
    for i, item in enumerate(items):
        item = re.findall("[a-z0-9]+", (item or "").lower())
        for piece in np.array_split(np.array(item, object), max(1, -(-len(item) // 64))):
            piece = piece.tolist()
            if not piece:
                continue
            length = min(lengths, key=lambda x: abs(np.log(x / len(piece))))
            keys = set(sorted(piece, key=lambda w: found[w])[: max(1, -(-4 * len(piece) // 10))])
            code = {w: k for k, w in enumerate(piece)}
            target = np.array([code[w] for w in piece])
            for d, t in enumerate(texts):
                for lo in range(0, len(t), decontaminate.WINDOWS[length]):
                    near = t[max(0, lo - len(piece)) : lo + length + len(piece)]
                    if 2 * len(keys & set(near)) >= len(keys) and 10 * decontaminate.common_subsequence(target, np.array([code.get(w, -1) for w in near])) >= 6 * len(piece):
                        out.add((d, i))
                        break
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def prose():
    """Items of 10 to 130 words; documents that hold none, or one with words changed, dropped and added."""
    rng = random.Random(21)
    common, words = vocabulary(40, 21), vocabulary(3000, 22)
    make = lambda k: " ".join(rng.choice(common if rng.random() < 0.5 else words) for _ in range(k))
    items = [make(k) for k in [10, 12, 15, 18, 20, 25, 30, 35, 40, 50, 60, 64, 80, 100, 130] * 2]
    docs, planted = [make(rng.randint(1, 300)) for _ in range(100)], {}
    for i, item in enumerate(items):
        for keep in (1.0, 0.9, 0.8, 0.75, 0.7):
            text = []
            for w in item.split():
                if rng.random() < keep:
                    text.append(w)
                elif (how := rng.random()) < 0.5:
                    text.append(make(1))
                elif how < 0.75:
                    text += [w, make(1)]
            planted[len(docs)] = (i, keep)
            docs.append(f"{make(rng.randint(0, 150))} {' '.join(text)} {make(rng.randint(0, 150))}")
    return docs, items, planted


def test_contamination(spark):
    rng = random.Random(6)
    words = vocabulary(4000, 6)
    common = vocabulary(30, 7)
    make = lambda k: " ".join(rng.choice(common if rng.random() < 0.5 else words) for _ in range(k))
    items = [make(k) for k in (40, 24, 60, 18, 130, 3)] + [None, ""]
    changed = items[0].split()
    for i in range(0, 40, 5):
        changed[i] = "zz"
    docs = [make(200) for _ in range(30)]
    docs += [make(100) + " " + items[0].upper() + ". " + make(90), make(70) + "\n" + " ".join(changed) + "\n" + make(40), items[1], make(300) + " " + items[2], items[3] + " " + make(500), make(90) + " " + items[4], None, "", "a"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(100 + i, t, 2) for i, t in enumerate(items)], "item_id long, text string, piece int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got - {(d, 105) for d in range(99)} == {(30, 100), (31, 100), (32, 101), (33, 102), (34, 103), (35, 104)}
    kept = decontaminate.drop_contaminated(frame, bench.where("item_id < 105"))
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(len(docs))) - set(range(30, 36))


def test_empty_tables(spark):
    docs, bench = frames(spark, ["a b c d e f"], ["a b c d e f"])
    none = spark.createDataFrame([], SCHEMA)
    assert decontaminate.contaminated(docs, bench).count() == 1
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.drop_contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0 and decontaminate.drop_contaminated(docs, bench.where("false")).count() == 1


def test_hot_and_short_items_match_all_pairs(spark):
    """A hot item and short items whose words are frequent, beside rarer words of other items."""
    rng = random.Random(11)
    common, words, other = vocabulary(25, 12), vocabulary(300, 13), vocabulary(3000, 14)
    hot = " ".join(rng.choice(common) for _ in range(12))
    items = [hot, *(" ".join(rng.choice(common if rng.random() < 0.5 else words) for _ in range(k)) for k in (4, 5, 6, 8, 10, 12, 15, 20, 30, 50, 64))]
    rare = " ".join(items[8:]).split()
    make = lambda k: " ".join(rng.choice(rare if rng.random() < 0.5 else other) for _ in range(k))
    docs = [f"{hot} {make(20)}" for _ in range(30)] + [make(150) for _ in range(20)]
    for item in items:
        w = item.split()
        dropped = [x for k, x in enumerate(w) if k % 5 != 2]
        spread = [y for x in w for y in (x, rng.choice(other), rng.choice(other))]
        docs += [f"{make(rng.randint(40, 90))} {' '.join(x)} {make(rng.randint(40, 90))}" for x in (w, w, dropped, spread)]
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(*frames(spark, docs, items)).collect()]
    want = all_pairs(docs, items)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.95 * len(want)
    assert {(50 + 4 * i + k, i) for i in range(len(items)) for k in ((0, 1, 2) if len(items[i].split()) >= 8 else (0, 1))} | {(d, 0) for d in range(30)} <= set(got)


def test_paraphrases_are_found_as_all_pairs_would(spark, monkeypatch):
    docs, items, planted = prose()
    docs_, bench = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_, bench).collect()}
    want = all_pairs(docs, items)
    assert got <= want and len(got) >= 0.95 * len(want)
    changed = {(d, i) for d, (i, keep) in planted.items() if keep < 1} & want
    assert len(changed) > 80 and len(changed & got) >= 0.9 * len(changed) and {(d, i) for d, (i, keep) in planted.items() if keep == 1} <= got
    # the decomposition picks the candidates: other vectors find others
    fit = decontaminate.randomised_svd
    few = lambda rows, b: tuple(x[..., :1] for x in fit(rows, b))
    none = lambda rows, b: (np.ones(4), np.linalg.qr(np.random.default_rng(0).normal(size=(len(b.vocabulary), 4)))[0])
    pairs = []
    for decompose in (fit, few, none):
        monkeypatch.setattr(decontaminate, "randomised_svd", decompose)
        model = next(decontaminate.models(docs_, bench))[0]
        words, first = decontaminate.tokens(decontaminate.Texts(pa.array(docs)))
        d, _, p, _ = decontaminate.retrieve(model, decontaminate.look_up(words, model.vocabulary), first)
        pairs.append({*zip(d.tolist(), p.tolist(), strict=True)})
    assert len(pairs[0]) < 0.5 * len(docs) * len(items) and all(len(pairs[0] ^ x) > 0.2 * len(pairs[0]) for x in pairs[1:])


def test_singular_values_are_those_of_the_matrix(spark):
    docs, items, _ = prose()
    docs_, bench = frames(spark, docs, items)
    model = decontaminate.Benchmark(list(range(len(items))), items)
    numbers = decontaminate.keep(decontaminate.numbered(docs_, model))
    found, tiles = decontaminate.count_words(numbers, model)
    model.weigh(found, tiles)
    s, u = decontaminate.randomised_svd(numbers, model, 24)
    code = {decontaminate.tokens(decontaminate.Texts(pa.array([w])))[0][0]: w for t in items for w in t.split()}
    column = {code[h]: k for k, h in enumerate(model.vocabulary)}
    texts = [t.split() for t in docs]
    rows = [x[i : i + 64] for x in texts for i in range(0, len(x), 64)] + [p.tolist() for x in items for p in np.array_split(np.array(x.split(), object), -(-len(x.split()) // 64))]
    a = np.zeros((len(rows), len(column)))
    for k, row in enumerate(rows):
        for w in row:
            if w in column:
                a[k, column[w]] += model.idf[column[w]]
    assert tiles + len(model.pieces) == len(rows) and [sum(w in set(r) for r in rows[:tiles]) for w in list(column)[:20]] == found[[column[w] for w in list(column)[:20]]].tolist()
    exact = np.linalg.svd(a, compute_uv=False)[:24]
    # the spectrum is flat after the first value, where one power step leaves a few per cent
    assert s[0] == pytest.approx(exact[0], rel=1e-3) and s[:12] == pytest.approx(exact[:12], rel=0.1) and (s <= exact * (1 + 1e-6)).all()
    assert u.T @ u == pytest.approx(np.eye(24), abs=1e-6)
    assert (np.linalg.norm(a @ u, axis=0) >= 0.9 * s).all()


def test_rows_are_judged_one_by_one(spark):
    """Null and repeated ids, repeated rows, a very long text, clashing columns."""
    rng = random.Random(31)
    words = vocabulary(2000, 31)
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    item = make(30)
    bad, long = f"{make(20)} {item} {make(9)}", f"{make(40_000)} {item} {make(30_000)}"
    rows = [(1, bad), (1, make(50)), (None, bad), (None, make(40)), (None, None), (2, ""), (2, long), (3, make(50_000)), (4, bad), (4, bad)]
    frame = spark.createDataFrame([(*r, 7, 8.0) for r in rows], "doc_id long, text string, v int, cosine double")
    bench = spark.createDataFrame([(5, item), (6, item)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr(r) for r in rows if not (r[1] and item in r[1]))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == {(d, i) for d in (1, None, 2, 4) for i in (5, 6)}
    parts = [decontaminate.contaminated(frame.repartition(n), bench).collect() for n in (1, 7)]
    assert sorted(map(repr, parts[0])) == sorted(map(repr, parts[1]))


def test_common_subsequence():
    rng = random.Random(8)
    for _ in range(40):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a, np.int64), np.array(b, np.int64)) == table[-1][-1]


def test_a_turn_of_speech_is_no_passage(spark):
    docs = [f"the model data of {w} is what the people of the town saw" for w in vocabulary(40, 3)] + ["some four rare words stand here"]
    items = ["the", "model data", "the town", "of the town", "four rare words stand", "", None]
    docs_, bench = frames(spark, docs, items)
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_, bench).collect()] == [(40, 4)]
    assert decontaminate.drop_contaminated(docs_, bench).count() == 40
    assert decontaminate.drop_contaminated(docs_, bench.where("item_id < 4")).count() == 41


def test_vectors_lie_by_rows():
    """Columns taken from the SVD lie by columns; each take of rows would copy the whole matrix first."""
    bench = decontaminate.Benchmark([1], ["red green blue yellow black"])
    vectors = np.random.default_rng(4).normal(size=(5, 9))[:, np.array([3, 0, 7])]
    assert not vectors.flags.c_contiguous
    bench.rotate(vectors)
    assert bench.vectors.flags.c_contiguous and bench.vectors.dtype == np.float32
    assert np.array_equal(bench.vectors, np.vstack([vectors, np.zeros((1, 3))]).astype(np.float32))
    at, sizes = np.array([4, 0, 0, 2, 1, 3, 4, 2, 1]), np.array([2, 0, 1, 6])
    want = [bench.vectors[x].sum(0) for x in np.split(at, np.cumsum(sizes)[:-1])]
    assert np.allclose(decontaminate.run_sums(bench.vectors, at, sizes), want, atol=1e-6)

"""Operators 11 to 13 against brute force and SQL, awkward rows included."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from strandweave.llm import exact, periodic, whitening
from strandweave.llm._quotient import QuotientFilter, counted, merge

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, extra string"


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("module, query", [(exact, exact.op11_exact), (periodic, periodic.op13_periodic_runs)])
def test_query_equals_sql(spark, module, query):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    frame = query(spark, SF)
    columns = sorted(frame.columns)
    assert plain(frame.select(*columns).collect()) == plain(con.sql(f"SELECT {', '.join(columns)} FROM ({module.ORACLE})").fetchall())


# --- counting quotient filters


@pytest.mark.parametrize("bits", [12, 20, 40, 52])
def test_a_filter_keeps_all_and_merges_without_loss(bits):
    rng = np.random.default_rng(bits)
    parts = []
    for size in (0, 1, 3, 500, 3000):
        values, counts = counted(rng.integers(0, 1 << min(bits, 11), size).astype(np.uint64) << np.uint64(bits - min(bits, 11)), rng.integers(1, 4, size))
        f = QuotientFilter.build(values, counts, bits)
        got = f.items()
        assert got[0].tolist() == values.tolist() and got[1].tolist() == counts.tolist()
        parts.append((f, dict(zip(values.tolist(), counts.tolist(), strict=True))))
    want = {}
    for _, items in parts:
        for v, c in items.items():
            want[v] = want.get(v, 0) + c
    values, counts = merge([f for f, _ in parts])
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == want and (np.diff(values.astype(np.int64)) > 0).all()


def test_filters_of_tasks_count_every_fingerprint(spark):
    rng = random.Random(2)
    prints = [rng.choice([rng.getrandbits(63), -rng.getrandbits(63), 5, -7]) for _ in range(4000)]
    frame = spark.createDataFrame([(p,) for p in prints], "print long").repartition(5)
    bits, block = 44, 5
    got = {r["print"]: r["n"] for r in exact.repeated(exact.filters(frame, bits, block, most=300), bits).collect()}
    want = {}
    for p in prints:
        key = (p & (2**64 - 1)) >> (64 - bits)
        want[key] = want.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n > 1}


# --- exact duplicates

ROWS = [
    (1, "Same TEXT", "a"), (9, "same text", "b"), (4, "SAME text", None), (9, "same text", "b"), (None, "same text", "c"),
    (2, None, None), (3, "", "x"), (None, None, "y"), (5, "ÄÖ", "z"), (6, "äö", "z"), (7, "İ", "z"), (8, "i̇", "z"),
    (10, "word " * 60_000, ""), (11, "WORD " * 60_000, ""), (12, "word " * 60_000 + "x", ""), (None, "alone", ""), (None, "nobody", ""), (None, "nobody", ""),
]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_classes(rows):
    groups, out = {}, []
    for i, (d, t, *_) in enumerate(rows):
        groups.setdefault(lowered(t), []).append((d if d is not None else -math.inf, i, d))
    for text, members in groups.items():
        top = max(members)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, top[2], len(members), i == top[1], sha) for _, i, d in members]
    return sorted(map(repr, out))


def answers(frame):
    return sorted(repr(tuple(r)) for r in frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("prints", [exact.fingerprint, lambda b: (len(b) % 3) << 60], ids=["blake", "colliding"])
def test_exact_duplicates_are_brute_force(spark, prints):
    rng = random.Random(4)
    rows = ROWS + [(rng.randrange(60), f"copy {rng.randrange(25)}", None) for _ in range(300)] + [(1000 + i, "hot", None) for i in range(250)]
    got = answers(exact.exact_duplicates(spark.createDataFrame(rows, DOCS).repartition(6), prints))
    assert got == brute_classes(rows)


def test_exact_duplicates_without_heavy_classes(spark, monkeypatch):
    monkeypatch.setattr(exact, "HEAVY", 1)
    assert answers(exact.exact_duplicates(spark.createDataFrame(ROWS, DOCS))) == brute_classes(ROWS)


def test_exact_duplicates_of_nothing_and_of_string_ids(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    got = exact.exact_duplicates(spark.createDataFrame([("b", "x"), ("a", "X"), (None, "x")], "doc_id string, text string")).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in got) == [("None", "b", 3, False), ("a", "b", 3, False), ("b", "b", 3, True)]


def test_layout_grows_with_the_table():
    assert exact.layout(0, 8) == (33, 4) and exact.layout(10**6, 8)[1] == 4
    bits, block = exact.layout(10**11, 200)
    assert bits == 64 and 10**11 / 2**block < 2 * exact.BLOCK


# --- whitening


def expected(vectors):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors], np.int64)
    n = len(x)
    s = x.sum(0)
    c = x - s / n
    values, u = np.linalg.eigh(c.T @ c / n)
    return x, c, values[::-1], u[:, ::-1], ((n * x - s) ** 2).sum(1)


def test_whitening_is_eigh(spark):
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(300, 12)) * np.geomspace(5, 0.1, 12) @ rng.normal(size=(12, 12))).tolist()
    awkward = [(None, v[0], "x"), (3, v[1], "y"), (3, v[1], "y"), (4, None, "n"), (5, [*v[2][:-1], None], ""), (6, [*v[2][:-1], math.nan], ""), (7, [*v[2][:-1], math.inf], ""), (8, [], ""), (9, v[3][:5], "")]
    rows = [(i + 100, x, "") for i, x in enumerate(v)] + awkward
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(5)).toPandas()
    kept = v + [v[0], v[1], v[1]]
    x, c, values, u, deviation = expected(kept)
    assert len(got) == 8 * len(kept) and set(got["n"]) == {len(kept)} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    assert sorted(got["deviation"].astype(object).map(int)) == sorted(np.repeat(deviation, 8).tolist())
    want = c @ u[:, :8] / np.sqrt(values[:8])
    for k in range(8):
        mine = got[got["component"] == k + 1]
        assert np.allclose(mine["explained"], values[k] / values.sum(), rtol=1e-9)
        a = mine[mine["vec_id"] >= 100].sort_values("vec_id")["whitened"].to_numpy()
        b = want[: len(v), k]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_without_variance(spark):
    shape = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        assert whitening.whiten(spark.createDataFrame(rows, shape)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0, float(i)]) for i in range(4)], shape)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12


@pytest.mark.parametrize("scale", [10, 2**19, 2**30, 2**45])
def test_sums_are_exact_at_every_size(scale):
    y = np.random.default_rng(1).integers(-scale, scale, (50, 4))
    want = y.astype(object).T @ y.astype(object)
    assert whitening.multiplied(y).tolist() == want.tolist() and whitening.added(y) == y.astype(object).sum(0).tolist()


def test_deviation_beyond_a_long_is_exact(spark):
    rows = [(i, [float(i % 2) * 3e6, float(i % 3)]) for i in range(40)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in rows], object)
    s = x.sum(0)
    assert got == {i: sum((40 * a - b) ** 2 for a, b in zip(x[i], s, strict=True)) for i in range(40)} and max(got.values()) > 2**63


def test_factor_and_rotations():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (5, 5), (9, 4), (24, 24)):
        a = rng.normal(size=(d, rank)) * np.geomspace(1, 1e-3, rank)
        v = a @ a.T
        factor, order = whitening.pivoted_cholesky(v)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-12) and not np.triu(factor, 1).any()
        values, u = whitening.eigen(v)
        assert np.allclose(u.T @ u, np.eye(rank), atol=1e-12) and np.allclose(v @ u, u * values, atol=1e-12) and (np.diff(values) <= 0).all()
    assert sorted((int(p), int(q)) for a, b in whitening.rounds(7) for p, q in zip(a, b, strict=True)) == [(i, j) for i in range(7) for j in range(i + 1, 7)]


# --- periodic runs


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        j = 0
        while j < n - q:
            s = j
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - s + q >= max(24, 3 * q):
                out.setdefault((s, j - s + q), q)
            j += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    k = rng.choice([1, 2, 3, 5, 50])
    w = [rng.randrange(k) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 3)):
        root = [rng.randrange(k) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.4:
            root = [0] * (len(root) - 1) + [1]
        n = len(root) * rng.randint(2, 9) + rng.randint(0, len(root))
        at = rng.randrange(len(w) + 1)
        w[at:at] = [root[i % len(root)] for i in range(n)]
    return w


def test_runs_are_brute_force():
    rng = random.Random(11)
    seen = 0
    for _ in range(120):
        docs = [some_words(rng) for _ in range(rng.randint(0, 5))]
        got = periodic.runs([np.array(d, np.int64) for d in docs])
        want = [brute_runs(d) for d in docs]
        assert [[tuple(r) for r in g.tolist()] for g in got] == want
        seen += sum(map(len, want))
    assert seen > 500


def test_range_successor():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 200):
        values = rng.permutation(n)
        tree = periodic.Wavelet(values)
        lo = rng.integers(0, n, 300)
        hi = lo + rng.integers(0, n, 300) % (n - lo + 1)
        least = rng.integers(0, n + 3, 300)
        want = [min((int(x) for x in values[a:b] if x >= c), default=-1) for a, b, c in zip(lo, hi, least, strict=True)]
        assert tree.successor(lo, hi, least).tolist() == want


def brute_digest(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tail = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(found), *tail, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_of_awkward_rows(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "a " * 24, "a " * 23, "a b " * 30, "Ä\x0bö\x0c" * 40, "x " * 3000 + "y " * 3000, " ".join(str(i % 400) for i in range(1500)), "a b " * 12 + "a", "one"]
    texts += [" ".join(map(str, some_words(rng))) for _ in range(60)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "a " * 40, "x"), (3, texts[3], "y"), (3, texts[3], "y")]
    frame = spark.createDataFrame(rows, DOCS).withColumnRenamed("extra", "start").repartition(3)
    got = periodic.periodic_runs(frame, plant=True).collect()
    assert plain(got) == sorted(repr(brute_digest(d, t)) for d, t, _ in rows)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, t, _ in rows if d is not None and t)
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_words_have_numbers():
    a, b = periodic.numbered([[b"x", b"y", b"x"], [b"y"]])
    assert a[0] == a[2] != a[1] == b[0] and periodic.numbered([]) == []

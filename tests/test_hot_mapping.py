"""Hot seeds, long buckets and names with very many records."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from strandweave.operators import anchors as A
from strandweave.operators import chain
from strandweave.operators import evaluate as E
from strandweave.operators import index
from strandweave.operators.chain import NEAR, scored, scores
from strandweave.params import Params


def test_a_seed_of_every_read_is_spread(spark):
    rng = random.Random(3)
    rows = [(i, j, j % 2, 7 if j == 0 else rng.randrange(10**6)) for i in range(4000) for j in range(3)]
    seeds = spark.createDataFrame(rows, "read_id long, q_pos long, q_strand int, hash long").repartition(8)
    hits = [(7, c, c * 10, c % 2) for c in range(40)] + [(h, 0, h, 0) for _, _, _, h in rows[1:3000:5]]
    index = spark.createDataFrame(hits, "hash long, contig_id long, pos long, strand int")
    heavy = A.heavy_seeds(seeds, len(rows))
    assert [r.hash for r in heavy.collect()] == [7] and A.heavy_seeds(seeds, 900) is None and A.heavy_seeds(seeds, len(rows), least=4000).count() == 0
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plain, spread = A.seed_anchors(seeds, index), A.seed_anchors(seeds, index, heavy)
        most = lambda f: f.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        n = plain.count()
        assert most(plain) > 0.9 * n and most(spread) < 0.2 * n
        assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def bucket(rng, n, step):
    r = np.sort(rng.integers(0, n * step, n))
    return r + rng.integers(-30, 30, n), r


def test_the_band_changes_nothing():
    rng = np.random.default_rng(6)
    for n, many, gap in ((NEAR + 1, 3, 40), (40, 9, 60), (300, 5, 400), (NEAR * 2 + 20, 5, 2000)):
        p = Params(max_gap=gap)
        parts = [bucket(rng, n, 4) for _ in range(many)]
        q, r = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
        joint = np.repeat(np.arange(many) % 2, n)
        f, back = scored(q, r, joint, np.arange(many + 1) * n, p)
        for b in range(many):
            lo, hi = b * n, (b + 1) * n
            s = -q[lo:hi] if b % 2 else q[lo:hi]
            want, came = np.full(n, float(p.k)), np.full(n, -1)
            for i in range(n):  # all pairs
                for j in range(i):
                    gr, gq = r[lo + i] - r[lo + j], s[i] - s[j]
                    d = abs(int(gq - gr))
                    if 0 < gr <= gap and 0 < gq <= gap and d <= p.max_drift:
                        value = want[j] + (min(gq, gr, p.k) - (0.01 * p.k * d + (0.5 * np.log2(d) if d > 1 else 0.0)))
                        if value > p.k and value >= want[i]:
                            want[i], came[i] = value, j
            assert np.allclose(f[lo:hi], want, rtol=0, atol=1e-12) and back[lo:hi].tolist() == came.tolist()


def test_long_buckets_take_time_in_proportion():
    rng = np.random.default_rng(1)
    took = []
    for n in (4000, 16000):
        parts = [bucket(rng, n, 50) for _ in range(4)]
        q, r = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
        start = time.perf_counter()
        f, back = scored(q, r, np.zeros(4 * n, int), np.arange(5) * n, Params())
        took.append(time.perf_counter() - start)
        one = scores(q[:n], r[:n], 0, Params())
        assert f[:n].tolist() == one[0].tolist() and back[:n].tolist() == one[1].tolist()
    assert took[1] < 8 * took[0]


def greedy(ours, golden):
    free, out = list(range(len(golden))), []
    for x in ours:
        if not free:
            out.append(-1)
            continue
        best = min(free, key=lambda k: abs(int(golden[k]) - int(x)))
        free.remove(best)
        out.append(best)
    return out


def test_nearest_free_is_greedy():
    rng = np.random.default_rng(2)
    for _ in range(400):
        a, b = (rng.integers(0, rng.choice([3, 20, 200]), rng.integers(0, 25)) for _ in range(2))
        assert E.nearest_free(a, b).tolist() == greedy(a, b)


def test_many_records_of_one_name_are_paired_fast():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 10**6, 10_000), rng.integers(0, 10**6, 10_000)
    start = time.perf_counter()
    got = E.nearest_free(a, b)
    assert time.perf_counter() - start < 1 and sorted(got.tolist()) == list(range(10_000))


def test_repeated_places_are_scored_once(monkeypatch):
    """A repeat looks the same from place to place, and so do those of copies; scores and predecessors are those of the plain recurrence."""
    q, r = np.meshgrid(np.arange(0, 200, 7), np.arange(0, 4200, 7))
    same = (q // 7) % 3 == (r // 7) % 3
    q, r = q[same], r[same]
    calls = []
    monkeypatch.setattr(chain, "_score_place", lambda *x, real=chain._score_place: calls.append(1) or real(*x))
    for joint in (0, 1):
        order = np.lexsort((q, r))
        a, b = (200 - q if joint else q)[order], r[order]
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        calls.clear()
        f, back = scored(np.tile(a, 3), np.tile(b, 3) + np.repeat([0, 50, 10**6], len(a)), np.full(3 * len(a), joint), np.arange(4) * len(a), Params())
        want = scores(a, b, joint, Params())
        for k in range(3):
            part = slice(k * len(a), (k + 1) * len(a))
            assert np.array_equal(f[part], want[0]) and np.array_equal(back[part], want[1])
        assert 0 < len(calls) < 600 / 3  # of 3 x 600 places
        monkeypatch.setattr(chain, "KEPT", 50_000)  # much is forgotten on the way
        again = chain.scored(np.tile(a, 3), np.tile(b, 3), np.full(3 * len(a), joint), np.arange(4) * len(a), Params())
        assert np.array_equal(again[0], f) and np.array_equal(again[1], back)
        monkeypatch.setattr(chain, "KEPT", 32 << 20)


def test_index_of_the_seeds_asked_for(spark, monkeypatch):
    """The hits of some seeds are those that the whole index has of them, the cap included, and no others are stored."""
    rng = random.Random(12)
    piece = "".join(rng.choice("ACGT") for _ in range(60))
    seqs = ["".join(rng.choice("ACGT") for _ in range(200)) + piece * (1 + i % 3) for i in range(6)]
    contigs = spark.createDataFrame(list(enumerate(seqs)), "contig_id long, seq string")
    reads = spark.createDataFrame([(0, seqs[0][50:260]), (1, seqs[1][:150]), (2, None)], "read_id long, seq string")
    p = Params(freq_cap=7)
    seeds, kept = A.query_seeds(reads, p), []
    whole = index.build_index(contigs, p)
    monkeypatch.setattr(index, "stored", lambda f, real=index.stored: kept.append(real(f)) or kept[-1])
    some = index.build_index(contigs, p, seeds=seeds)
    want = whole.join(seeds.select("hash").distinct(), "hash", "left_semi").select(*some.columns)
    assert sorted(some.collect()) == sorted(want.collect()) and 0 < want.count() < whole.count()
    asked = {r.hash for r in seeds.collect()}
    assert all({r.hash for r in f.collect()} <= asked for f in kept) and kept[-1].count() > 0  # some of them are over the cap

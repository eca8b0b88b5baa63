"""The ten operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.llm import fingerprints, language, mixing, neardup, quality, sharding, substrings, suffixes, toxicity
from strandweave.llm._arrow import Texts, sliced
from strandweave.llm._components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus(seed=0, n=60):
    """Documents with copies, near copies, shared passages, nulls, blanks, other scripts, a long one, equal ids and repeated rows."""
    rng = random.Random(seed)
    words = vocabulary(900, seed)
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = make(60)
    texts = [make(rng.randint(1, 200)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[3], make(30) + "\n" + shared + " " + make(20), shared + "\t" + make(5), make(9) + " " + shared]
    near = make(150).split()
    texts += [" ".join(near), " ".join([*near[:70], "changed", *near[71:]]), " ".join([*near[:20], "other", *near[21:]])]
    texts += [None, None, "", " \n\t ", "a", "é" * 70 + " ñandú", "日本語 テキスト " * 9, make(40) * 3, make(4000), "x " * 120, "no\x00null \x1f sep arated words"]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s0", 1), (5, texts[6], "en", "s0", 1), (None, texts[7], None, None, None), (None, make(50), None, "s1", None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    # extra columns with names that operators use inside
    clashes = "shard int, batch string, k1 long, _id long, _a string, _k1 long, _slot int, _toxicity double, size int"
    return spark.createDataFrame([(*r, 1, "z", 2, 3, "a", 4, 5, 0.5, 6) for r in rows], f"{SCHEMA}, {clashes}").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return WORD.findall(t or "")


def grams(t, n=5):
    w = words_of(t)
    return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or collections.Counter([tuple(w)] if w else [])


# --- 1: near-duplicates ---------------------------------------------------------------------


def similarity(a, b):
    keys = a.keys() | b.keys()
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in keys) for d in a.keys() & b.keys())


def test_probability_jaccard_is_exact():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ({rng.randrange(30): rng.randint(1, 4) for _ in range(rng.randint(1, 20))} for _ in range(2))
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)], float)) for x in (a, b)]
        assert neardup.probability_jaccard(*arrays) == pytest.approx(similarity(collections.Counter(a), collections.Counter(b)))


def test_registers_agree_as_often_as_the_similarity_says():
    t = Texts(pa.array([" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(40, 340)), "a b", "", "a a a a a a b"]))
    h, w, bounds = neardup.weighted(t)
    s = neardup.prob_minhash(h, w, bounds, 2048)
    truth = neardup.probability_jaccard(*[(h[bounds[i] : bounds[i + 1]], w[bounds[i] : bounds[i + 1]]) for i in (0, 1)])
    assert abs((s[0] == s[1]).mean() - truth) < 0.05
    assert (s[3] == 0).all() and (s[:3] != 0).all()


def test_classes_match_all_pairs(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    texts = list({r.text or "" for r in rows})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    sets = {t: grams(t) for t in texts}
    for a, b in itertools.combinations(texts, 2):
        if sets[a] and sets[b] and similarity(sets[a], sets[b]) >= 0.8 - 1e-9:
            parent[root(a)] = root(b)
    ids = collections.defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            ids[root(r.text or "")].add(r.doc_id)
    want = sorted(repr((r.doc_id, min(ids[root(r.text or "")], default=None))) for r in rows)
    got = neardup.classes(docs).collect()
    assert sorted(repr((r.doc_id, r.class_id)) for r in got) == want
    assert neardup.classes(docs, 0.8).columns == ["doc_id", "class_id", "copies"]


def test_large_bucket_in_blocks_finds_the_same_classes(spark, monkeypatch):
    """Blocks by count and by bytes give the classes of all pairs."""
    rng = random.Random(4)
    rows = []
    for family in range(3):
        base = [f"w{family}x{i}" for i in range(150)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(150)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for p, q in itertools.combinations(range(len(rows)), 2):
        if similarity(sets[p], sets[q]) >= 0.8 - 1e-9:
            low, high = sorted((label[p], label[q]))
            label = [low if x == high else x for x in label]
    assert 3 < len(set(label)) < len(rows) * 2 / 3
    frame, first = spark.createDataFrame(rows, "doc_id long, text string"), {}
    for d, t in rows:
        first.setdefault(t, d)  # equal texts are one node

    def found(block):
        nodes, links = neardup.similar(frame, block=block)
        own = {r.node.first_id: r.label.first_id for r in components(links).collect()}
        assert links.count() < 4 * len(rows)
        return [own.get(first[t], first[t]) for _, t in rows]

    assert found(1024) == label and found(7) == label
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 5_000)
    assert found(1024) == label
    assert [r.class_id for r in neardup.classes(frame).orderBy("doc_id").collect()] == label


def test_keep_first_and_empty(spark, docs, empty):
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    classes = {(r.doc_id, r.class_id) for r in neardup.classes(docs).collect()}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {*ids} == {c for d, c in classes if d == c} and ids.count(None) == 1 and ids.count(5) == 2
    two = docs.where("doc_id = 1").unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 1").withColumn("text", F.lit("quite another text than that one")))
    assert neardup.keep_first(two).count() == 2
    assert neardup.classes(empty).count() == 0 and neardup.keep_first(empty).count() == 0


@pytest.mark.parametrize("heavy", [False, True])
def test_components(spark, monkeypatch, heavy):
    if heavy:  # centres go by broadcast
        monkeypatch.setattr("strandweave.llm._components.LEAST", 3)
        monkeypatch.setattr("strandweave.llm._components.SHARE", 1000)
    rng = random.Random(2)
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [(f"m{rng.randrange(9)}", f"m{rng.randrange(9)}") for _ in range(6)] + [("s5", f"s{i:03}") for i in range(100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and {got[f"s{i:03}"] for i in range(100)} == {"s000"}
    assert all(got[a] == got[b] for a, b in links if a != b)


# --- 2: sharding -----------------------------------------------------------------------------


def test_slot_sharding(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.op2_virtual_slots(spark, str(tmp_path)).collect()
    want = sorted(repr((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))) for r in docs.collect())
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in rows) == want
    load = collections.Counter()
    for r in rows:
        load[r.shard] += r["size"]
    biggest = max(r["size"] for r in rows)
    assert max(load.values()) - min(load.values()) <= biggest
    for s in load:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.law == "bytes" and r.grown_shard is None and r.rebalanced_shard in (r.shard, 8) for r in rows)
    assert sharding.shard_documents(empty).count() == 0
    out = sharding.shard_documents(docs)
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "virtual_slot", "shard"}


def test_growing_moves_slots_only_into_the_new_shard():
    sizes = {s: (100 + s % 17, 1) for s in range(4096)}
    first = sharding.pack(sizes, 4096, 8)
    after = sharding.grow(first, sizes, 8)
    assert all(after[s] in (first[s], 8) for s in first)
    load = collections.Counter()
    for s, shard in after.items():
        load[shard] += sizes[s][0]
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values())


def test_a_stored_map_grows_version_by_version(spark, tmp_path):
    records = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(64)).cast("int").alias("virtual_slot"), (F.col("id") % 90 + 1).alias("size"))
    path = str(tmp_path / "map")
    sharding.create_map(records, path, 3, 64)
    assert [sharding.grow_map(spark, path), sharding.grow_map(spark, path, records.where("size > 20"))] == [1, 2]
    table = sharding.read_map(spark, path)
    maps = [{r.slot: r.shard for r in table.where(F.col("version") == v).collect()} for v in range(3)]
    assert [sorted(set(m.values())) for m in maps] == [[0, 1, 2], [0, 1, 2, 3], [0, 1, 2, 3, 4]] and all(len(m) == 64 for m in maps)
    for old, new, shard in ((maps[0], maps[1], 3), (maps[1], maps[2], 4)):
        assert all(new[s] in (old[s], shard) for s in old)
    for version in range(3):  # records are found under any version
        rows = sharding.assign(records, table, version).collect()
        assert len(rows) == 5000 and all(r.shard == maps[version][r.virtual_slot] for r in rows)


# --- 4: mixing -------------------------------------------------------------------------------


def test_mix_reaches_its_targets(spark, docs, empty):
    plan = mixing.curriculum(mixing.sized_documents(docs)).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(words_of(r.text))
    assert sum(r["size"] for r in plan) == sum(sizes.values()) and len(plan) == docs.count()
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        level = (left - sum(2 * sizes[s] for s in full)) / (sum(weight[s] for s in order if s not in full) or 1)
        new = {s for s in order if s not in full and 2 * sizes[s] < weight[s] * level}
        if not new:
            break
        full |= new
    target = {s: 2 * sizes[s] if s in full else weight[s] * level for s in order}
    taken, most = collections.Counter(), collections.Counter()
    for r in plan:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r["size"] and (r.first_position is None) == (r.copies == 0 or r.copies == 1 and r.second_position is not None)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in order)
    again = mixing.curriculum(mixing.sized_documents(docs.repartition(7))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, plan))
    assert mixing.curriculum(mixing.sized_documents(empty)).count() == 0


def test_mix_gives_whole_documents(spark, docs):
    out = mixing.mix_documents(docs)
    plan = mixing.curriculum(mixing.sized_documents(docs))
    assert out.columns == docs.columns and out.count() == plan.agg(F.sum("copies")).first()[0]
    assert {r.text for r in out.collect()} <= {r.text for r in docs.collect()}


# --- 5: fingerprints -------------------------------------------------------------------------


def test_fingerprints(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect()]
    want, prints = [], collections.defaultdict(set)
    for (i, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        want.append(repr((i, len(t), hashlib.sha256(e.encode()).hexdigest())))
    got = fingerprints.fingerprint_edits(docs).collect()
    assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(want)
    by_id = {i: t for i, t in rows}
    for r in got:
        if r.doc_id not in (5, None):
            prints[by_id[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in prints.values())
    assert fingerprints.fingerprint_edits(empty).count() == 0
    lone = fingerprints.fingerprint_edits(docs.where("doc_id = 0").limit(1)).first()
    assert lone.near_next == 1.0


def test_fingerprint_counts_distinct_shingles(spark):
    texts = [t for _, t, *_ in corpus()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fingerprints.fingerprint(frame, 16)
    assert got.columns == ["doc_id", "sketch", "shingles"]
    for r in got.collect():
        assert r.shingles == len(grams(texts[r.doc_id])) and len(r.sketch) == min(16, r.shingles)


def test_sketch_algebra(spark):
    a, b = (" ".join(f"w{i}" for i in range(lo, hi)) for lo, hi in ((0, 3000), (1000, 4000)))
    frame = spark.createDataFrame([(0, a), (1, b), (2, a + " " + b), (3, ""), (4, None)], "doc_id long, text string")
    s = {r.doc_id: r.sketch for r in fingerprints.fingerprint(frame, 512).collect()}
    assert s[3] == [] and s[4] == [] and len(s[0]) == 512 and s[0] == sorted(set(s[0]))
    one = spark.createDataFrame([(s[0], s[1], [], s[2])], "a array<long>, b array<long>, z array<long>, u array<long>")
    c = lambda f, *x: f(*[F.col(v) for v in x], 512)
    r = one.select(c(fingerprints.resemblance, "a", "b").alias("j"), c(fingerprints.containment, "a", "b").alias("c"), c(fingerprints.distinct_shingles, "a").alias("n"), c(fingerprints.resemblance, "z", "z").alias("e"), c(fingerprints.merge, "a", "b").alias("m")).first()
    assert abs(r.j - 1996 / 3996) < 0.08 and abs(r.c - 1996 / 2996) < 0.1 and abs(r.n / 2996 - 1) < 0.15 and r.e == 1.0
    assert len(set(r.m) & set(s[2])) > 500
    merged = fingerprints.fingerprint(frame.where("doc_id < 2"), 512).agg(fingerprints.merged(F.col("sketch"), 512).alias("m")).first().m
    assert merged == r.m


# --- 6 and 9: repeats ------------------------------------------------------------------------


@pytest.mark.parametrize(("window", "seed"), [(35, 10), (6, 3), (4, 4)])
def test_repeated_words(docs, window, seed):
    rows = docs.collect()
    count = collections.Counter(tuple(w[i : i + window]) for r in rows for w in [words_of(r.text)] for i in range(len(w) - window + 1))
    want = []
    for r in rows:
        w = words_of(r.text)
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        want.append(repr((r.doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))))
    got = substrings.find_repeats(docs, window, seed).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got) == sorted(want)
    assert all(sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize(("window", "gram"), [(50, 24), (12, 5)])
def test_repeated_bytes(docs, window, gram):
    rows = docs.collect()
    low = lambda i: -1 if i is None else i
    first = {}
    for r in sorted(rows, key=lambda r: low(r.doc_id)):
        b = (r.text or "").encode()
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], low(r.doc_id))
    want = []
    for r in rows:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < low(r.doc_id):
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want.append(repr((r.doc_id, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    got = suffixes.find_repeats(docs, window, gram).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))) for r in got) == sorted(want)


def test_repeats_of_nothing(empty):
    assert substrings.find_repeats(empty).count() == 0 and suffixes.find_repeats(empty).count() == 0
    with pytest.raises(ValueError, match="seed"):
        substrings.find_repeats(empty, 5, 6)


def test_suffix_order_is_lexicographic():
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab\xff") for _ in range(400))
    starts = np.arange(350)
    order, new = suffixes.suffix_order(np.frombuffer(data, np.uint8), starts, 50)
    cut = [data[i : i + 50] for i in order]
    assert cut == sorted(cut) and [a != b for a, b in itertools.pairwise(cut)] == new[1:].tolist() and new[0]


# --- 7, 8, 10: classifiers -------------------------------------------------------------------


def in_two(rng, kinds, n):
    return [(i, (k := i % len(kinds)), kinds[k](rng)) for i in range(n)]


def test_language(spark, empty):
    rng = random.Random(9)
    parts = {"aa": ["tha", "ing", "wor", "the"], "bb": ["lü", "sch", "eit", "ung"], "cc": ["que", "ción", "ado", "las"]}
    say = lambda p: " ".join("".join(rng.choice(p) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
    rows = [(i, say(parts[x]), x) for i in range(300) for x in [list(parts)[i % 3]]] + [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, "the thing", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(language.training(frame, 60))
    got = {r.doc_id: r for r in language.with_language(frame.select("doc_id", "text"), model).collect()}
    assert sum(got[i].lang_pred == x for i, _, x in rows[:300]) >= 297
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0.0 and got[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.with_language(empty, language.fit(language.training(empty))).count() == 0
    assert {r.lang_pred for r in language.with_language(frame.select("doc_id", "text"), {"langs": []}).collect()} == {"und"}


def test_toxicity(spark, empty):
    rng = random.Random(10)
    words = vocabulary(500, 10)
    clean = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(5, 80)))

    def rude():
        w = clean().split()
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "vexal" + rng.choice(words), "you moron"])
        return " ".join(w)

    rows = [(i, rude() if i % 6 == 0 else clean()) for i in range(600)] + [(700, None), (701, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(frame, marks)
    got = {r.doc_id: r.toxicity for r in toxicity.with_score(frame, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= v <= 1 for v in got.values()) and got[700] == got[701] and len(got) == 602
    kept = toxicity.reject_toxic(frame, marks)
    assert kept.columns == frame.columns and 480 <= kept.count() <= 520
    assert toxicity.with_score(empty, toxicity.train(empty, marks)).count() == 0
    assert toxicity.train(frame, marks.where("toxic = 0"))["constant"] == 0.0


def test_quality(spark, empty):
    rng = random.Random(11)
    words = vocabulary(500, 11)
    good = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(rng.randint(1, 30)))
    bad = lambda: " | ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randint(4, 200)))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(500)] + [(700, None), (701, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(500)] + [(3, None)], "doc_id long, quality int")
    model = quality.train(frame, marks)
    got = {r.doc_id: r for r in quality.with_score(frame, model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.3) == (i % 5 != 0) for i in held) >= 0.98 * len(held)
    assert got[700].score == got[701].score and got[700].passages == 1
    assert quality.with_score(empty, quality.train(empty, marks)).count() == 0


def test_gradient_of_the_attention_model():
    """Learning lowers the loss of bags whose label hangs on one passage."""
    rng = np.random.default_rng(0)
    per = rng.integers(1, 6, 300)
    x = rng.normal(size=(per.sum(), quality.WIDTH))
    first = np.cumsum(per) - per
    y = (np.maximum.reduceat(x[:, 0], first) > 0.8).astype(float)
    f = quality.forward(quality.learn(x, per, y, epochs=60), x, per)
    assert (((f["logit"] > 0) == (y > 0)).mean()) > 0.9
    assert np.add.reduceat(f["p"], first) == pytest.approx(np.ones(300))


# --- shared pieces ---------------------------------------------------------------------------


def test_words_and_slices():
    texts = ["a  b\tc", None, "", "é ü", " x", "tail "] * 3
    batch = pa.record_batch([pa.array(texts)], ["text"])
    seen = []
    for part in sliced(batch, "text", 8):
        t = Texts(part.column(0))
        start, end, first = t.words()
        for i in range(len(t)):
            seen.append([t.data[start[k] : end[k]].tobytes().decode() for k in range(first[i], first[i + 1])])
    assert seen == [words_of(t) for t in texts]

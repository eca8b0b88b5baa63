"""Short strings in a third of all documents: results stay exact, and no bucket gets a row per document."""

import collections
import random

import numpy as np
import pytest

from strandweave.llm import _repeats, substrings, suffixes
from strandweave.llm._arrow import U
from tests.llm.test_operators import vocabulary, words_of


@pytest.fixture(scope="module")
def hot(spark):
    """A line shorter than the windows in most documents, a longer one in some, copies with changes."""
    rng = random.Random(41)
    words = vocabulary(2000, 41)
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    line, longer = make(24), make(50)
    texts = [f"{make(rng.randint(0, 30))} {line if i % 3 else longer} {make(rng.randint(0, 30))}" for i in range(240)]
    texts += [texts[4].replace(line.split()[3], "changed"), texts[4], texts[7] + " " + texts[8], line, None]
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


def test_words(hot):
    frame, rows = hot
    count = collections.Counter(tuple(w[i : i + 35]) for _, t in rows for w in [words_of(t)] for i in range(len(w) - 34))
    want = []
    for d, t in rows:
        w = words_of(t)
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((d, len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in substrings.find_repeats(frame).collect()) == want


def test_bytes(hot):
    frame, rows = hot
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want.append((d, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    assert sorted((r.doc_id, bytes(r.kept)) for r in suffixes.find_repeats(frame).collect()) == want


def test_a_crowded_anchor_is_one_entry():
    anchor = np.array([3] + [7] * 1000 + [9, 9], U) << U(40)
    content = np.arange(1003, dtype=U)
    entries = _repeats.Entries(anchor, content, 4)
    assert len(entries.at) == 4 and entries.hot.tolist() == [False, True, False, False]
    assert sum(n for _, n, _ in entries.sends()) == 4
    # two batches: the crowded anchor is hot for both, though the second holds one content only
    judged = _repeats.judge(np.array([0, 0, 1, 1]), np.array([1, 2, 1, 2], U), np.array([0, 5, 8, 5], U), np.array([True, False, False, False]), np.zeros(4, bool))
    assert judged[3].tolist() == [True, False, True, False] and judged[0].tolist()[1::2] == [True, False] and judged[1].tolist()[1::2] == [True, True]
    many = _repeats.judge(np.arange(300), np.ones(300, U), np.arange(300, dtype=U), np.zeros(300, bool), np.zeros(300, bool))
    assert many[3].all()


def test_hot_windows_spread_over_buckets():
    """1,000 texts that share 24 words send their windows to all buckets, not to one."""
    import pyarrow as pa

    rng = random.Random(42)
    words = vocabulary(2000, 42)
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    line = make(24)
    group = pa.table({"doc_id": pa.array(range(1000)), "text": [f"{make(20)} {line} {make(20)}" for _ in range(1000)], "batch": pa.array([0] * 1000, pa.int32())})
    batch = substrings._Batch(group, 35, 10, 64)
    sent = [n for _, n, _ in batch.sends()]
    bits = np.where(batch.entries.hot[batch.entries.of_pair], _repeats.HOT, 1).astype(np.uint8)
    *_, hashes, _, edges = batch.second(bits, 35)
    assert (bits == _repeats.HOT).sum() > 900 and max(sent) < 3 * sum(sent) / 64
    assert len(hashes) > 5000 and np.diff(edges).max() < 3 * len(hashes) / 64

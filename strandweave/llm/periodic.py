"""Periodic runs of words by internal pattern matching.

A run of period q in [m, 2m), m a power of two, holds an aligned (dyadic) block of m words and its
copy q words on. So every dyadic block asks where it occurs in the neighbouring window of 2m words.
Blocks of a level are ranges of one suffix array, and a wavelet tree over that array answers "the
next occurrence from here" (range successor). Occurrences of a block of m words in a window of 2m
are at most two or else a progression; its step is then the block's own period, and the ends of
the two stretches of that period tell the only two candidates. Candidates are extended both ways
by comparing blocks of falling sizes, and those long enough are runs.

Documents don't meet, so a task works on slices of some megabytes, all documents of a slice at
once; a longer text is a slice by itself. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm._arrow import mix, sliced
from strandweave.llm._shared import documents

#: A run has at least so many words and at least so many periods (fixed by the query's contract).
LEAST, TIMES = 24, 3
#: Words of the smallest dyadic block; a third of ``LEAST``, so that it answers for all shorter periods too.
BASE = 8
SLICE = 2 << 20

U = np.uint64


class Wavelet:
    """A wavelet tree (in matrix form) over numbers below their count: a row of prefix sums for each bit."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, (len(values) - 1).bit_length()) if len(values) else 1
        self.zeros, self.middle = [], []
        for b in range(self.bits - 1, -1, -1):
            low = (values >> b) & 1 == 0
            self.zeros.append(np.append(0, np.cumsum(low)).astype(np.int32))
            self.middle.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[low], values[~low]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The least value >= ``least`` among places lo..hi-1, or -1: how many are smaller, then the one of that rank."""
        l, r, below = lo.astype(np.int64), hi.astype(np.int64), np.zeros(len(lo), np.int64)
        for k, (zeros, middle) in enumerate(zip(self.zeros, self.middle, strict=True)):
            one = (least >> (self.bits - 1 - k)) & 1 == 1
            zl, zr = zeros[l], zeros[r]
            below += np.where(one, zr - zl, 0)
            l, r = np.where(one, middle + l - zl, zl), np.where(one, middle + r - zr, zr)
        below = np.where(least >> self.bits > 0, hi - lo, below)
        found, out = below < hi - lo, np.zeros(len(lo), np.int64)
        l, r, rank = lo.astype(np.int64), hi.astype(np.int64), np.where(found, below, 0)
        for zeros, middle in zip(self.zeros, self.middle, strict=True):
            zl, zr = zeros[l], zeros[r]
            one = rank >= zr - zl
            rank = np.where(one, rank - (zr - zl), rank)
            out = 2 * out + one
            l, r = np.where(one, middle + l - zl, zl), np.where(one, middle + r - zr, zr)
        return np.where(found, out, -1)


class Factors:
    """Equal factors of BASE, 2 BASE, 4 BASE, ... words in some documents, and the suffix array they end in.

    ``w`` are the words' numbers with a number of its own between documents. Only places whose
    first BASE words occur twice in their document have equal factors; the others are left out.
    ``rank[k]`` is the first place in the suffix array of factors like the one at a member, ``size[k]`` their number.
    """

    def __init__(self, w: np.ndarray, owner: np.ndarray) -> None:
        self.w = w
        n = len(w) - BASE + 1
        code, span = mix(w.view(U)), 1
        while span < BASE:
            code = mix(code[:-span] * U(0x9E3779B97F4A7C15) + code[span:])
            span *= 2
        code = code ^ mix(owner[:n].astype(U))
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        self.at = np.flatnonzero(twice)  # the hash only proposes; the words themselves are sorted
        self.member = np.full(len(w), -1, np.int64)
        self.member[self.at] = np.arange(len(self.at))
        self.rank, self.size = [], []
        if not len(self.at):
            return
        keys = [w[self.at + i] for i in range(BASE - 1, -1, -1)] + [owner[self.at]]
        order = np.lexsort(keys)
        new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)) if len(order) > 1 else np.ones(len(order), bool)
        self._level(np.arange(len(order)), order, new)
        m = BASE
        while (active := np.flatnonzero(self.size[-1] > 1)).size:
            after = self.at[active] + m
            nxt = np.where(after < len(w), self.member[np.minimum(after, len(w) - 1)], -1)
            second = np.where(nxt >= 0, self.rank[-1][nxt], -1 - self.at[active])
            first = self.rank[-1][active]
            order = np.lexsort((second, first))
            f, s = first[order], second[order]
            begins = np.append(True, f[1:] != f[:-1])
            place = f + np.arange(len(f)) - np.maximum.accumulate(np.where(begins, np.arange(len(f)), 0))
            self._level(place, active[order], begins | np.append(True, s[1:] != s[:-1]))
            m *= 2

    def _level(self, place: np.ndarray, members: np.ndarray, new: np.ndarray) -> None:
        """Members in suffix order at ``place``, with the starts of their groups; all others keep what they had."""
        rank = self.rank[-1].copy() if self.rank else np.zeros(len(self.at), np.int64)
        size = np.ones(len(self.at), np.int64)
        starts = np.flatnonzero(new)
        many = np.diff(np.append(starts, len(new)))
        rank[members] = np.repeat(place[starts], many)
        size[members] = np.repeat(many, many)
        self.rank.append(rank)
        self.size.append(size)

    def wavelet(self) -> Wavelet:
        order = np.empty(len(self.at), np.int64)
        order[self.rank[-1]] = np.arange(len(self.at))
        return Wavelet(order)

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words agree from a and b on (or up to a and b and before, with ``back``)."""
        done = np.zeros(len(a), np.int64)
        step = -1 if back else 1
        for k in range(len(self.rank) - 1, -1, -1):
            m = BASE << k
            x, y = (a - done - m + 1, b - done - m + 1) if back else (a + done, b + done)
            inside = (x >= 0) & (y >= 0)
            x, y = self.member[np.where(inside, x, 0)], self.member[np.where(inside, y, 0)]
            done += np.where(inside & (x >= 0) & (y >= 0) & (self.rank[k][x] == self.rank[k][y]), m, 0)
        going = np.ones(len(a), bool)
        for _ in range(BASE):
            going &= self.w[a + step * done] == self.w[b + step * done]  # numbers of their own end every document
            done += going
        return done


def runs(words: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, length, period), ascending, of the runs of each document; ``words`` are numbers >= 0, equal for equal words."""
    lengths = np.array([len(x) for x in words], np.int64)
    starts = np.cumsum(lengths + 1) - lengths  # a border before each document
    w = -1 - np.arange(int(lengths.sum()) + len(words) + BASE, dtype=np.int64)
    owner = np.repeat(np.arange(len(words) + 1), np.append(lengths + 1, BASE))
    for s, x in zip(starts.tolist(), words, strict=True):
        w[s : s + len(x)] = x
    f = Factors(w, owner)
    if not len(f.at):
        return [np.zeros((0, 3), np.int64) for _ in words]
    tree = f.wavelet()
    relative = f.at - np.append(starts, 0)[owner[f.at]]
    at, period = [], []

    def occurrence(block: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
        """The first place >= ``least`` where the block's words stand, or a number beyond all."""
        got = tree.successor(f.rank[k][block], f.rank[k][block] + f.size[k][block], np.searchsorted(f.at, least))
        return np.where(got >= 0, f.at[got], 1 << 60)

    for k in range(len(f.rank)):
        m = BASE << k
        block = np.flatnonzero((relative % m == 0) & (f.size[k] > 1))
        if not len(block):
            continue
        i = f.at[block]
        if k == 0:
            near = occurrence(block, 0, i + 1)
            at.append(i[near < i + m])
            period.append((near - i)[near < i + m])
        one = occurrence(block, k, i + m)
        some = one < i + 2 * m
        block, i, one = block[some], i[some], one[some]
        two = occurrence(block, k, one + 1)
        three = occurrence(block, k, np.where(two < i + 2 * m, two, 0) + 1)
        many = (two < i + 2 * m) & (three < i + 2 * m)
        for p, ok in ((one, ~many), (two, ~many & (two < i + 2 * m))):
            at.append(i[ok])
            period.append((p - i)[ok])
        i, one, step = i[many], one[many], (two - one)[many]
        left, right = [x - f.common(x - 1, x + step - 1, back=True) for x in (i, one)]
        at.append(i)
        period.append(right - left)
        left, right = [x + step + f.common(x, x + step) for x in (i, one)]
        at.append(i)
        period.append(right - left)
    i, q = np.concatenate(at), np.concatenate(period)
    i, q = i[q > 0], q[q > 0]
    i, q = i[i + q < len(w) - BASE], q[i + q < len(w) - BASE]
    start = i - f.common(i - 1, i + q - 1, back=True)
    end = i + q + f.common(i, i + q)
    good = end - start >= np.maximum(LEAST, TIMES * q)
    found = np.unique(np.stack([start, end - start, q], 1)[good], axis=0)  # of one stretch the least period comes first
    if len(found):
        found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))]
    doc = owner[found[:, 0]]
    found[:, 0] -= np.append(starts, 0)[doc]
    edges = np.searchsorted(doc, np.arange(len(words) + 1))
    return [found[a:b][np.lexsort((found[a:b, 2], found[a:b, 0]))] for a, b in zip(edges, edges[1:])]


def planted(n: int, h: int | None) -> np.ndarray | None:
    """Places of the words that a document shows instead of its own n words, or None; fixed by the query's contract."""
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (TIMES + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def digest(words: list[bytes], found: np.ndarray) -> dict:
    """What the query says of a document with these words and runs."""
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
    best = max(found.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    if len(found):
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 0] + found[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
    start, length, period = best or (None, None, None)
    return {
        "n_runs": len(found), "start": start, "length": length, "period": period, "exponent_milli": best and 1000 * length // period,
        "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join(words)).hexdigest(),
    }


def numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Each document's words as numbers, equal for equal words of all of them."""
    flat = pa.array([x for t in texts for x in t], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(flat, np.cumsum([len(t) for t in texts])[:-1]) if texts else []


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row of ``docs(doc_id, text)``.

    The four numbers are those of the run of greatest length / period (ties: smallest start, then
    period), null without one. ``collapsed_sha256`` is of the words that no run repeats. Null and
    empty texts have no words; repeated rows are worked out one by one; other columns are ignored;
    an empty table gives an empty result. With ``plant`` the tenth of the documents that the
    query's contract names is read with a periodic tail; a null id is never among them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[x.split()[0] for x in RESULT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", SLICE):
                words = [(t or b"").split() for t in part.column(1).cast(pa.large_binary()).to_pylist()]  # bytes split at ASCII white space
                for k, h in enumerate(part.column(2).to_pylist()):
                    if (places := planted(len(words[k]), h)) is not None:
                        words[k] = [words[k][i] for i in places.tolist()]
                rows = [digest(x, f) for x, f in zip(words, runs(numbered(words)), strict=True)]
                types = [pa.string() if x.endswith("sha256") else pa.int64() for x in names[1:]]
                yield pa.record_batch([part.column(0), *[pa.array([r[x] for r in rows], t) for x, t in zip(names[1:], types, strict=True)]], names)

    h = F.crc32(F.col("doc_id").cast("string")) if plant else F.lit(None).cast("long")
    return docs.select("doc_id", "text", h.alias("h")).mapInArrow(run, f"doc_id {kind}, {RESULT}")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``periodic_runs`` of all ``documents`` with the contract's planted tails; nulls, repeated rows, long texts and empty tables as it says."""
    return periodic_runs(documents(spark, sf_dir).select("doc_id", "text"), plant=True)


#: The same from all pairs of equal groups of eight words of a document; crc32 by its table.
ORACLE = r"""
WITH c AS (SELECT list(x ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS x FROM (SELECT unnest(range(256)) AS i))),
t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT r, doc_id, ws, len(ws)::BIGINT AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda v, b: xor(v >> 8, tab[1 + xor(v & 255, b)])), 4294967295::BIGINT) AS h FROM t, c),
v AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM u),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE ws END AS ws FROM v),
g AS (SELECT r, n, i, array_to_string(ws[i + 1:i + 8], ' ') AS k FROM (SELECT r, n, ws, unnest(range(n - 7)) AS i FROM d WHERE n >= 24)),
m AS (SELECT r, k FROM g GROUP BY ALL HAVING count(*) > 1),
b AS (SELECT g.* FROM g SEMI JOIN m ON g.r = m.r AND g.k = m.k),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM b x JOIN b y ON x.r = y.r AND x.k = y.k AND y.i > x.i WHERE 3 * (y.i - x.i) <= x.n),
f AS (SELECT r, q, min(i) AS s, max(i) - min(i) + 8 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS o FROM e) GROUP BY r, q, o),
z AS (SELECT r, s, l, min(q) AS q FROM f WHERE l >= greatest(24, 3 * q) GROUP BY r, s, l),
y AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, first(struct_pack(s := s, l := l, q := q) ORDER BY l::DOUBLE / q DESC, s, q) AS best FROM z GROUP BY r),
x AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM z),
w AS (SELECT r, unnest(ws) AS word, unnest(range(n)) AS i FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN x ON w.r = x.r AND w.i = x.i GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN y ON d.r = y.r LEFT JOIN k ON d.r = k.r"""

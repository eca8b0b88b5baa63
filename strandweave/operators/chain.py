"""Collinear chains of anchors: ordered dynamic programming and greedy extraction.

The recurrence depends on earlier results of the same bucket, which no window function can
express, so buckets (read, contig, joint strand) are worked on in Arrow streams, those of equal
size together, in numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.seeds import check
from strandweave.operators._groups import per_group
from strandweave.params import Params

CHAIN_SCHEMA = (
    "read_id long, contig_id long, joint int, chain_rank int, q_start long, q_end long, ref_start long, ref_end long, score double, "
    "anchor_count int, unique_anchors int, anchors array<struct<q_pos:long,ref_pos:long>>"
)
#: Chains without their anchors.
SHORT_SCHEMA = CHAIN_SCHEMA[: CHAIN_SCHEMA.index(", anchors ")]


def reach(s: np.ndarray, p: Params) -> int:
    """How far back a predecessor can be: a gap on the reference is no longer than ``max_gap``, nor than one on the read and ``max_drift`` together."""
    return min(p.max_gap, int(s.max() - s.min()) + p.max_drift) if len(s) else 0


def scores(q: np.ndarray, r: np.ndarray, joint: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Best score of a chain that ends in each anchor, and its predecessor (-1: none). Anchors are sorted by (r, q)."""
    s = -q if joint else q
    n = len(r)
    f, back = np.full(n, float(p.k)), np.full(n, -1)
    lows = np.searchsorted(r, r - reach(s, p), "left")
    for i in range(1, n):
        lo = lows[i]
        gap_r, gap_q = r[i] - r[lo:i], s[i] - s[lo:i]
        d = np.abs(gap_q - gap_r)
        ok = np.flatnonzero((gap_r > 0) & (gap_q > 0) & (gap_q <= p.max_gap) & (d <= p.max_drift))
        if not len(ok):
            continue
        d = d[ok].astype(float)
        cost = 0.01 * p.k * d + np.where(d > 1, 0.5 * np.log2(np.maximum(d, 1.0)), 0.0)
        value = f[lo:i][ok] + (np.minimum(np.minimum(gap_q[ok], gap_r[ok]), p.k) - cost)
        best = value.max()
        if best > p.k:
            f[i], back[i] = best, lo + ok[np.flatnonzero(value == best)[-1]]
    return f, back


#: Anchors just before one that are looked at first; what they reach rules out most of the others.
NEAR = 256
#: Places of a group of buckets that are worked on together.
TOGETHER = 1 << 19
#: Buckets of more anchors than ``LARGE``, and of ``DENSE`` for each of their places on the contig, are worked on by places.
LARGE, DENSE = 1000, 4


def scored(q: np.ndarray, r: np.ndarray, joint: np.ndarray, edges: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """``scores`` of many buckets [edges[i], edges[i + 1]), largest first, many of about one size together, an anchor of each at a time.

    An anchor is compared with the ``NEAR`` ones before it, and then only with those of its band
    (``reach``) whose score could still win: a step adds k at most. In a large bucket with many
    anchors at each place of the contig (a repeat) those of a place are worked on together.
    """
    f, back = np.full(len(q), float(p.k)), np.full(len(q), -1)
    size = np.diff(edges)
    left, seen = size > 1, _Seen()
    for b in np.flatnonzero(size > LARGE).tolist():
        at = slice(int(edges[b]), int(edges[b + 1]))
        if size[b] >= DENSE * (1 + np.count_nonzero(np.diff(r[at]))):
            f[at], back[at] = _by_place(r[at], -q[at] if joint[edges[b]] else q[at], p, seen)
            left[b] = False
    order = np.argsort(-size, kind="stable")
    order = order[left[order]]
    done = 0
    while done < len(order):
        n = int(size[order[done]])
        part = order[done : done + max(1, TOGETHER // n)]
        done += len(part)
        many = size[part]
        row = np.repeat(np.arange(len(part)), many)
        column = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(edges[part], many) + column
        rr, ss, lows = (np.zeros((len(part), n), np.int64) for _ in range(3))
        sign = np.where(joint[at] != 0, -q[at], q[at])
        rr[row, column], ss[row, column] = r[at], sign - np.repeat(np.minimum.reduceat(sign, np.cumsum(many) - many), many)  # from 0, as the places left over have it
        for k, m in enumerate(many.tolist() if n > NEAR else ()):
            lows[k, :m] = np.searchsorted(rr[k, :m], rr[k, :m] - reach(ss[k, :m], p), "left")
        ff, bb = _lockstep(rr, ss, lows, many, p)
        f[at], back[at] = ff[row, column], bb[row, column]
    return f, back


def _gain(gap_q: np.ndarray, gap_r: np.ndarray, p: Params) -> np.ndarray:
    """What a step adds, or -inf for one that isn't allowed."""
    d = np.abs(gap_q - gap_r)
    ok = (gap_r > 0) & (gap_r <= p.max_gap) & (gap_q > 0) & (gap_q <= p.max_gap) & (d <= p.max_drift)
    d = d.astype(float)
    cost = 0.01 * p.k * d + np.where(d > 1, 0.5 * np.log2(np.maximum(d, 1.0)), 0.0)
    return np.where(ok, np.minimum(np.minimum(gap_q, gap_r), p.k) - cost, -np.inf)


#: Drifts that a table of gains may have.
TABLE = 1 << 12


@lru_cache(maxsize=8)
def _gains(p: Params) -> np.ndarray:
    """``_gain`` by lesser gap (0: none, k: k or more) and drift (the last one: too much)."""
    least, drift = np.arange(p.k + 1)[:, None], np.arange(p.max_drift + 1)[None]
    table = np.full((p.k + 1, p.max_drift + 2), -np.inf)
    far = replace(p, max_gap=p.k + p.max_drift)
    table[:, :-1] = _gain(least + 0 * drift, least + drift, far)
    return table.ravel()


def _steps(s: np.ndarray, p: Params) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``_gain`` for buckets whose places on the read are in ``s``: a table, where no gap of the allowed drift can be too wide. Changes its first argument."""
    if p.max_drift > TABLE or int(s.max() - s.min()) + p.max_drift > p.max_gap:
        return lambda gap_q, gap_r: _gain(gap_q, gap_r, p)
    table = _gains(p)

    def gain(gap_q: np.ndarray, gap_r: np.ndarray) -> np.ndarray:
        least = np.minimum(gap_q, gap_r)
        gap_q -= gap_r
        np.abs(gap_q, out=gap_q)
        np.minimum(gap_q, p.max_drift + 1, out=gap_q)
        least.clip(0, p.k, out=least)
        least *= p.max_drift + 2
        least += gap_q
        return table.take(least)

    return gain


def _lockstep(rr: np.ndarray, ss: np.ndarray, lows: np.ndarray, many: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Scores and predecessors of buckets as rows, the longest first; ``many`` anchors each."""
    ff, bb = np.full(rr.shape, float(p.k)), np.full(rr.shape, -1)
    live = np.searchsorted(-many, -np.arange(rr.shape[1]), "left")  # rows that are longer than a column's number
    gain = _steps(ss, p)
    gap = ss - rr
    for i in range(1, rr.shape[1]):
        n, x = int(live[i]), max(0, i - NEAR)
        value = gain(ss[:n, i, None] - ss[:n, x:i], rr[:n, i, None] - rr[:n, x:i])
        value += ff[:n, x:i]
        which = i - 1 - value[:, ::-1].argmax(1)  # of equal values the nearest
        best = value[np.arange(n), which - x]
        better = best > p.k
        ff[:n, i][better], bb[:n, i][better] = best[better], which[better]
        if not x:
            continue
        low = int(lows[:n, i].min())
        if low >= x:
            continue
        could = ff[:n, low:x] > ff[:n, i, None] - (p.k + 1e-6)
        could &= ss[:n, low:x] < ss[:n, i, None]
        could &= np.abs(gap[:n, low:x] - gap[:n, i, None]) <= p.max_drift
        k, j = np.nonzero(could)
        j += low
        k, j = k[j >= lows[k, i]], j[j >= lows[k, i]]
        if len(k):
            value = ff[k, j] + _gain(ss[k, i] - ss[k, j], rr[k, i] - rr[k, j], p)
            win = value > ff[k, i]
            k, j, value = k[win], j[win], value[win]
            last = np.lexsort((j, value, k))
            last = last[np.append(k[last][1:] != k[last][:-1], True)] if len(k) else last
            ff[k[last], i], bb[k[last], i] = value[last], j[last]
    return ff, bb


#: Bytes that scores of places may take, kept for others that look the same.
KEPT = 32 << 20


class _Seen:
    """Scores of places by what decides them: their own places on the read and the anchors of their band, with scores, as seen from them.

    A repeat shows the same again and again, in one bucket and in those of copies. Places and
    their scores are numbered, so that a band is a short list of numbers and distances. Keys are
    whole, not hashed. Scores may be forgotten at any time, numbers only between buckets; those
    of one bucket take no more than its anchors.
    """

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.scores: dict[tuple[bytes, bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}
        self.named = self.held = 0

    def room(self) -> None:
        """Forget all, between buckets, if the numbers take much."""
        if self.named > KEPT:
            self.number, self.scores = {}, {}
            self.named = self.held = 0

    def name(self, s: np.ndarray, f: np.ndarray) -> int:
        key = s.tobytes() + f.tobytes()
        if key not in self.number:
            self.number[key] = len(self.number)
            self.named += len(key)
        return self.number[key]

    def keep(self, key: tuple[bytes, bytes, bytes], f: np.ndarray, before: np.ndarray) -> None:
        self.held += sum(map(len, key)) + f.nbytes + before.nbytes
        if self.held > KEPT:
            self.scores, self.held = {}, 0
        self.scores[key] = f, before


def _by_place(r: np.ndarray, s: np.ndarray, p: Params, seen: _Seen | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and predecessors of one bucket: anchors of one place of the contig can't precede each other, so they are compared with those before them at once.

    ``seen`` is for buckets of the same parameters.
    """
    f, back = np.full(len(r), float(p.k)), np.full(len(r), -1)
    seen = seen or _Seen()
    seen.room()
    s = s - s.min()
    gap, gain = s - r, _steps(s, p)
    places = np.append(np.flatnonzero(np.append(True, r[1:] != r[:-1])), len(r))
    lows = np.searchsorted(r, r[places[:-1]] - reach(s, p), "left")
    names, heads = np.zeros(len(places) - 1, np.int64), r[places[:-1]]
    names[0] = seen.name(s[: places[1]], f[: places[1]])
    band = np.searchsorted(places, lows)  # the first place of each band
    for t, (first, stop, low) in enumerate(zip(places[1:-1].tolist(), places[2:].tolist(), lows[1:].tolist(), strict=True), 1):
        key = s[first:stop].tobytes(), names[band[t] : t].tobytes(), (heads[t] - heads[band[t] : t]).tobytes()
        known = seen.scores.get(key)
        if known is None:
            _score_place(r, s, gap, f, back, first, stop, low, gain, p)
            seen.keep(key, f[first:stop].copy(), np.where(back[first:stop] >= 0, first - back[first:stop], 0))
        else:
            f[first:stop] = known[0]
            back[first:stop] = np.where(known[1] > 0, first - known[1], -1)
        names[t] = seen.name(s[first:stop], f[first:stop])
    return f, back


def _score_place(r: np.ndarray, s: np.ndarray, gap: np.ndarray, f: np.ndarray, back: np.ndarray, first: int, stop: int, low: int, gain: Callable[[np.ndarray, np.ndarray], np.ndarray], p: Params) -> None:
    """Fill in ``f`` and ``back`` of the anchors [first, stop) of one place from those of [low, first)."""
    x = max(low, first - NEAR)
    many = max(1, TOGETHER // max(NEAR, first - low))
    for a in range(first, stop, many):
        b = min(stop, a + many)
        value = f[x:first] + gain(s[a:b, None] - s[x:first], r[a] - r[x:first])
        which = value.shape[1] - 1 - value[:, ::-1].argmax(1) if first > x else None  # of equal values the nearest
        if which is not None:
            best = value[np.arange(b - a), which]
            better = best > p.k
            f[a:b][better], back[a:b][better] = best[better], x + which[better]
        if low == x:
            continue
        must = f[a:b] - (p.k + 1e-6)
        c = low + np.flatnonzero((f[low:x] > must.min()) & (s[low:x] < s[a:b].max()) & (gap[low:x] >= gap[a:b].min() - p.max_drift) & (gap[low:x] <= gap[a:b].max() + p.max_drift))
        could = f[c] > must[:, None]
        could &= s[c] < s[a:b, None]
        could &= np.abs(gap[c] - gap[a:b, None]) <= p.max_drift
        k, j = np.nonzero(could)
        if not len(k):
            continue
        j = c[j]
        value = f[j] + _gain(s[a + k] - s[j], r[a] - r[j], p)
        win = value > f[a + k]
        k, j, value = k[win], j[win], value[win]
        if len(k):
            last = np.lexsort((j, value, k))
            last = last[np.append(k[last][1:] != k[last][:-1], True)]
            f[a + k[last]], back[a + k[last]] = value[last], j[last]


def extract(f: np.ndarray, back: np.ndarray, edges: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``top_k`` chains of each bucket [edges[i], edges[i + 1]), best end first: rank, score and size of each, and the anchors of all.

    A walk that meets a used anchor stops there but keeps its full score; single anchors give no
    chain, though the attempt counts. All buckets make their first attempt together, then their
    second, and so on; buckets don't share anchors.
    """
    bucket = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    before = np.where(back >= 0, back + edges[:-1][bucket], -1)
    ends = np.flatnonzero(f > p.k)
    ends = ends[np.lexsort((ends, -f[ends], bucket[ends]))]  # equal scores by place
    used = np.zeros(len(f), bool)
    none = np.zeros(0, np.int64)
    heads, sizes, parts = [none], [none], [none]
    for attempt in range(p.top_k):
        ends = ends[~used[ends]]
        if not len(ends):
            break
        head = ends[np.append(True, bucket[ends][1:] != bucket[ends][:-1])]
        step, who, at = head, np.arange(len(head)), []
        while len(step):
            used[step] = True
            at.append((who, step))
            step = before[step]
            on = step >= 0
            on[on] = ~used[step[on]]
            step, who = step[on], who[on]
        who, found = (np.concatenate(x) for x in zip(*at[::-1]))  # first anchors first
        order = np.argsort(who, kind="stable")
        size = np.bincount(who, minlength=len(head))
        real = size > 1 if attempt else np.ones(len(head), bool)
        heads.append(head[real])
        sizes.append(size[real])
        parts.append(found[order][real[who[order]]])
    head, size, member = (np.concatenate(x) for x in (heads, sizes, parts))
    order = np.argsort(bucket[head], kind="stable")  # by bucket, then by attempt
    first = np.cumsum(size) - size
    own = bucket[head][order]
    rank = np.arange(len(own)) - np.searchsorted(own, own, "left")
    at = np.repeat(first[order] - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(len(member))
    return rank, f[head][order], size[order], member[at]


def _edges(read: np.ndarray, contig: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Bounds of the buckets of sorted anchors."""
    new = np.flatnonzero((contig[1:] != contig[:-1]) | (joint[1:] != joint[:-1]) | (read[1:] != read[:-1])) + 1
    return np.concatenate([[0], new, [len(read)]]) if len(read) else np.zeros(1, np.int64)


#: Rows that a task chains together; more where one read has more.
ROWS = 1 << 20


def least_anchors(p: Params) -> int:
    """Buckets and chains of fewer anchors decide no placement.

    A chain needs ``min_anchors`` for a fragment or an alternate. A shorter one could still be a
    read's best and set the score floor, but n anchors score n * k at most and every chain scores
    more than k, so that floor is no bar if the share it is of n * k is k or less. A chain that is
    short because it stopped at a used anchor may score more, but no more than the first of its
    bucket, which is whole.
    """
    return max(2, p.min_anchors) if p.min_score_ratio * (p.min_anchors - 1) <= 1 else 2


def chain_rows(read: np.ndarray, contig: np.ndarray, joint: np.ndarray, r: np.ndarray, q: np.ndarray, hashes: np.ndarray, known: np.ndarray | None, edges: np.ndarray, p: Params, least: int, members: bool) -> pa.RecordBatch | None:
    """Chains of the sorted buckets [edges[i], edges[i + 1]), see ``chain_anchors``; ``known`` marks hashes that aren't null."""
    rank, score, size, at = extract(*scored(q, r, joint, edges, p), edges, p)
    enough = size >= least
    if not enough.all():
        rank, score, size, at = rank[enough], score[enough], size[enough], at[np.repeat(enough, size)]
    if not len(rank):
        return None
    first = np.cumsum(size) - size
    lead = at[first]
    low = lambda x: np.minimum.reduceat(x[at], first)
    high = lambda x: np.maximum.reduceat(x[at], first) + 1 + p.window_ext
    q0, r0 = np.maximum(0, low(q) - p.k + 1), np.maximum(0, low(r) - p.k + 1)
    e = np.minimum(p.window_ext, np.minimum(q0, r0))
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((hashes[at], owner))
    new = np.append(True, (owner[order][1:] != owner[order][:-1]) | (hashes[at][order][1:] != hashes[at][order][:-1]))
    unique = np.bincount(owner, new, len(size)).astype(int)
    if known is not None:
        unique = np.where(np.minimum.reduceat(known[at].astype(int), first) > 0, unique, size)
    i4 = lambda x: pa.array(np.asarray(x, np.int32))
    out = [pa.array(read[lead]), pa.array(contig[lead]), i4(joint[lead]), i4(rank), pa.array(q0 - e), pa.array(high(q)), pa.array(r0 - e), pa.array(high(r)), pa.array(score), i4(size), i4(unique)]
    if members:
        out.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(q[at]), pa.array(r[at])], ["q_pos", "ref_pos"])))
    return pa.record_batch(out, [x.split()[0] for x in (CHAIN_SCHEMA if members else SHORT_SCHEMA).split(", ")])


def chain_anchors(anchors: DataFrame, params: Params | None = None, least: int = 2, members: bool = True) -> DataFrame:
    """Chains of ``anchors(read_id, q_pos, contig_id, ref_pos, joint, hash)``; see CHAIN_SCHEMA.

    The span starts k - 1 before the first anchors' last bases and is widened by ``window_ext``;
    like the method it follows, it isn't clamped to the read or contig unless ``clamp`` is set
    later. Rows with a null key or position are left out; a null hash counts as distinct. Buckets
    and chains of fewer than ``least`` anchors are left out; without ``members`` there is no column ``anchors``.
    Spark sorts by read only; inside many reads together numpy sorts.
    """
    p = check(params)
    columns = ["read_id", "contig_id", "joint", "ref_pos", "q_pos", "hash"]
    keyed = anchors.select(*[F.col(c).cast("int" if c == "joint" else "long").alias(c) for c in columns]).dropna(subset=columns[:5])
    schema = CHAIN_SCHEMA if members else SHORT_SCHEMA

    def work(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        read, contig, joint, r, q = (rows.column(c).to_numpy() for c in columns[:5])
        order = np.lexsort((joint, contig, read))
        size = np.diff(_edges(read[order], contig[order], joint[order]))
        order = order[np.repeat(size >= max(2, least), size)]  # one anchor makes no chain
        if not len(order):
            return None
        order = order[np.lexsort([x[order] for x in (q, r, joint, contig, read)])]
        read, contig, joint, r, q = (x[order] for x in (read, contig, joint, r, q))
        hashes, known = rows.column("hash").fill_null(0).to_numpy()[order], rows.column("hash").is_valid().to_numpy()[order]
        return chain_rows(read, contig, joint, r, q, hashes, known, _edges(read, contig, joint), p, least, members)

    return per_group(keyed, "read_id", ["read_id"], work, schema, ROWS)


def chain_scores(anchors: DataFrame, params: Params | None = None) -> DataFrame:
    """The table behind the chains: (read_id, contig_id, joint, ref_pos, q_pos, f, back) with f and back of every anchor; back is its predecessor's rank in the bucket or -1."""
    p = check(params)
    columns = ["read_id", "contig_id", "joint", "ref_pos", "q_pos"]
    keyed = anchors.select(*[F.col(c).cast("int" if c == "joint" else "long").alias(c) for c in columns]).dropna()

    def work(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        read, contig, joint, r, q = (rows.column(c).to_numpy() for c in columns)
        f, back = scored(q, r, joint, _edges(read, contig, joint), p)
        return pa.record_batch([*[rows.column(c).combine_chunks() for c in columns], pa.array(f), pa.array(back)], [*columns, "f", "back"])

    return per_group(keyed, "read_id", columns, work, "read_id long, contig_id long, joint int, ref_pos long, q_pos long, f double, back long")

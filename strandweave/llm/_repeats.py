"""Finding every repeated window of a corpus without pairing documents.

A sequence (words or bytes) is cut at *anchors*: the gram with the least hash of a window,
rightmost on ties. The choice depends on the window's content alone, so equal windows have equal
anchors at equal offsets, wherever they stand. All windows of one anchor are consecutive; they
and the symbols they cover are a *unit*. Two facts follow:

* units with equal content agree in every window;
* equal windows in different units have the same anchor, so units are only compared by anchor.

Documents are dealt to batches. A batch sends the distinct units it holds, as hashes, to buckets
keyed by the anchor; a bucket answers with a few bits for each unit. Only units whose anchor has
several contents go on to a second round that compares window by window. A unit is sent once by
a batch however often it occurs there, so a passage in a third of all documents costs no more
than any other. Messages are packed arrays, one row for each batch and bucket.

A short string in a third of all documents would be one anchor with as many contents. Anchors
with more than ``FEW`` contents in a batch are sent as one entry, and anchors with more than
``MANY`` in all are *hot*: their windows are compared one by one in buckets keyed by the window,
where equal ones meet and others don't. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from strandweave.llm._arrow import U, mix, prefix_hash, spans

_LOW = (1 << 24) - 1
BATCH_BYTES = 8 << 20
MOST_BATCHES = 1 << 22
FEW, MANY = 4, 256
HOT = 8


def batches_for(total_bytes: int, partitions: int, size: int = BATCH_BYTES) -> int:
    """Batches (and buckets) for so much text: one per shuffle partition at least, 4 Mi at most, about ``size`` bytes each between."""
    return int(min(MOST_BATCHES, max(partitions, -(-total_bytes // size), 1)))


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the least key of every ``width`` consecutive ones, rightmost on ties (40 bits of the key count)."""
    n = len(keys)
    if n < width:
        return np.zeros(0, np.int64)
    at = np.arange(n, dtype=U)
    m = (keys & U(~_LOW & (2**64 - 1))) | (U(_LOW) - (at & U(_LOW)))
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    start = np.arange(len(m))
    low = _LOW - (m & U(_LOW)).astype(np.int64)
    return start + ((low - start) & _LOW)


@dataclass
class Units:
    """Units of some texts: anchor hash, content hash, text, first window, number of windows."""

    anchor: np.ndarray
    content: np.ndarray
    text: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @staticmethod
    def joined(parts: list[Units]) -> Units:
        return Units(*[np.concatenate([getattr(p, k) for p in parts]) if parts else np.zeros(0, t) for k, t in (("anchor", U), ("content", U), ("text", np.int64), ("first", np.int64), ("count", np.int64))])


def units(values: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[Units, np.ndarray]:
    """Units of the sequences values[bounds[i]:bounds[i+1]], and the running hash of ``values``."""
    running = prefix_hash(values)
    n = len(values)
    if n < window:
        return Units.joined([]), running
    at = np.arange(n - gram + 1)
    grams = spans(running, at, at + gram)
    anchor = least(grams, window - gram + 1)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    first, at = start[head], anchor[head]
    count = np.diff(np.append(head, len(start)))
    content = spans(running, first, first + count - 1 + window) ^ mix((at - first).astype(U))
    # least hashes are small numbers: mixed again they fill all buckets alike
    return Units(mix(grams[at]), content, owner[first], first, count), running


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the anchor hash."""
    return (((anchor >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def distinct(anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (anchor, content), the start of each distinct pair in that order, and the pair of each unit."""
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


class Entries:
    """What a batch says about its distinct (anchor, content) pairs, in order: a row each, or one hot row for an anchor with more than ``FEW`` contents."""

    def __init__(self, anchor: np.ndarray, content: np.ndarray, buckets: int) -> None:
        heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(anchor)))
        crowded = np.repeat(size > FEW, size)
        lead = np.ones(len(anchor), bool)
        lead[crowded] = False
        lead[heads] = True
        self.at = np.flatnonzero(lead)
        self.of_pair = np.cumsum(lead) - 1
        self.hot = crowded[self.at]
        self.anchor, self.content = anchor[self.at], np.where(self.hot, U(0), content[self.at])
        self.edges = np.searchsorted(bucket_of(self.anchor, buckets), np.arange(buckets + 1))

    def sends(self, many: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, entries, body) for each bucket; ``many`` marks pairs that occur more than once in the batch."""
        for b in np.flatnonzero(np.diff(self.edges)).tolist():
            at = slice(self.edges[b], self.edges[b + 1])
            marks = [self.hot[at], *([] if many is None else [many[self.at[at]]])]
            yield b, self.edges[b + 1] - self.edges[b], pack(self.anchor[at], self.content[at], marks)

    def answered(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        """The buckets' bits of each pair."""
        out = np.zeros(len(self.at), np.uint8)
        for b, bits in answers.items():
            out[self.edges[b] : self.edges[b + 1]] = bits
        return out[self.of_pair]


def pack(anchor: np.ndarray, content: np.ndarray, marks: list[np.ndarray]) -> bytes:
    """Ten bytes for each pair (40 bits of either hash; buckets add to the anchor's), and a bit each for every mark."""
    out = np.empty((len(anchor), 10), np.uint8)
    out[:, :5] = anchor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 5:] = content.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return out.tobytes() + b"".join(np.packbits(m).tobytes() for m in marks)


def unpack(body: bytes, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, contents and the marks ``hot`` and ``many`` of a message of so many pairs."""
    raw = np.frombuffer(body, np.uint8)
    own = raw[: pairs * 10].reshape(-1, 10)
    out = []
    for part in (own[:, :5], own[:, 5:]):
        wide = np.zeros((len(own), 8), np.uint8)
        wide[:, :5] = part
        out.append(wide.reshape(-1).view("<u8").astype(U))
    width = -(-pairs // 8)
    for k in range(2):
        rest = raw[pairs * 10 + k * width : pairs * 10 + (k + 1) * width]
        out.append(np.unpackbits(rest)[:pairs].astype(bool) if len(rest) else np.zeros(pairs, bool))
    return tuple(out)


def judge(batch: np.ndarray, anchor: np.ndarray, content: np.ndarray, hot: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every entry in a bucket: whether no batch of a lower number holds it, whether it occurs more than once at all, whether its anchor has other contents, and whether the anchor is hot."""
    order = np.lexsort((batch, content, anchor))
    a, c = anchor[order], content[order]
    new_a, new = np.ones(len(a), bool), np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new[1:] = new_a[1:] | (c[1:] != c[:-1])
    heads, heads_a = np.flatnonzero(new), np.flatnonzero(new_a)
    size, size_a = np.diff(np.append(heads, len(a))), np.diff(np.append(heads_a, len(a)))
    more = np.add.reduceat(many[order].astype(np.int64), heads) if len(a) else size
    contents = np.add.reduceat(new.astype(np.int64), heads_a) if len(a) else size
    crowded = np.add.reduceat(hot[order].astype(np.int64), heads_a) if len(a) else size
    first, often, several, boils = (np.empty(len(a), bool) for _ in range(4))
    first[order] = batch[order] == np.repeat(batch[order][heads], size)
    often[order] = np.repeat(size + more > 1, size)
    several[order] = np.repeat(contents > 1, size_a)
    boils[order] = np.repeat((crowded > 0) | (contents > MANY), size_a)
    return first, often, several, boils


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of units: their starts, and the unit of each."""
    which = np.repeat(np.arange(len(first)), count)
    return np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which], which


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n symbols lie in one of the spans."""
    edge = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def runs_of(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a mask inside each sequence: starts and ends."""
    n = len(mask)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none
    inner = bounds[(bounds > 0) & (bounds < n)]
    begin, stop = np.empty(n, bool), np.empty(n + 1, bool)
    begin[0], stop[0], stop[n] = mask[0], False, mask[-1]
    np.logical_and(mask[1:], ~mask[:-1], out=begin[1:])
    np.logical_and(mask[:-1], ~mask[1:], out=stop[1:n])
    begin[inner] = mask[inner]
    stop[inner] = mask[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop)

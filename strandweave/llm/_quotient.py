"""Counting quotient filters: fingerprints as quotients that place them and remainders that are kept.

A filter holds the fingerprints of one block (a common prefix, which isn't kept). Of the other
``bits`` bits of a fingerprint the upper ``q`` are its quotient, the lower ones its remainder.
Equal quotients form a run of slots with ascending remainders; two bit vectors say which
quotients have a run and which slots end one, a third one which slots have a counter above one.
How many bits are quotient is the filter's own choice, made by its load, so filters of any size
split alike after decoding and merge without loss: sorted remainders are merged, equal ones add
their counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64


def _packed(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(body: bytes, width: int) -> np.ndarray:
    if not width:
        raise ValueError("a remainder has at least a byte")
    out = np.zeros((len(body) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8").astype(U)


@dataclass(frozen=True)
class QuotientFilter:
    """``q`` quotient bits, bit vectors, remainders (whole bytes) and the counters above one, in slot order."""

    bits: int
    q: int
    slots: int
    occupied: bytes
    run_ends: bytes
    counted: bytes
    remainders: bytes
    counts: np.ndarray

    @staticmethod
    def build(values: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """A filter of ascending distinct ``values`` (below 2^bits) and how often each occurs."""
        n = len(values)
        q = max(0, min(bits - 8, max(n, 1).bit_length()))  # about one slot for each quotient
        r = U(bits - q)
        quotients = (values >> r).astype(np.int64)
        ends = np.append(quotients[1:] != quotients[:-1], True) if n else np.zeros(0, bool)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        more = counts > 1
        rest = values & ((U(1) << r) - U(1))
        return QuotientFilter(bits, q, n, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(more).tobytes(), _packed(rest, (bits - q + 7) // 8), counts[more].astype(np.int64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Values ascending, and their counts: what ``build`` was given, to the bit."""
        bit = lambda b, n: np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
        ends = bit(self.run_ends, self.slots)
        run = np.cumsum(ends) - ends  # runs that ended before a slot
        quotients = np.flatnonzero(bit(self.occupied, 1 << self.q))[run].astype(U)
        values = (quotients << U(self.bits - self.q)) | _unpacked(self.remainders, (self.bits - self.q + 7) // 8)
        counts = np.ones(self.slots, np.int64)
        counts[bit(self.counted, self.slots)] = self.counts
        return values, counts


def counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values ascending with the sums of their counts. The stable sort merges what is sorted already."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def merge(filters: list[QuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of all filters and their total counts."""
    parts = [f.items() for f in filters]
    return counted(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]))

"""Vectorised text primitives for Arrow batches: byte buffers, words, span hashes.

Everything here works on one slice of a batch (about a megabyte of text), so the memory of a
task does not depend on how much text a partition holds; a longer text is a slice by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from strandweave.operators._groups import BATCH, frugal, small_batches  # noqa: F401

SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64
#: Odd multiplier of the rolling polynomial and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def table(seed: int) -> np.ndarray:
    """256 random 64-bit words of a seed."""
    return mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03) + U(seed * 0x2545F4914F6CDD1D & (2**64 - 1)))


_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n at least."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(max(n, 2 * len(_powers[0])), b, U)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``spans`` turns them into hashes of any span."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def spans(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal for equal contents wherever they stand."""
    return mix((running[end] - running[start]) * powers(len(running))[1][start])


class Texts:
    """Some texts as one byte buffer: ``data`` and the offsets ``off`` (one more than texts). Nulls are empty."""

    def __init__(self, array: pa.Array) -> None:
        if array.null_count:
            array = array.fill_null("")
        kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
        n = len(array)
        offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        body = array.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        self.off = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.off) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes with ``inside[byte]`` that stay in one text: starts, ends, and the first run of each text."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.off), np.int64)
        solid = inside[self.data]
        inner = self.off[(self.off > 0) & (self.off < n)]
        begin, stop = np.empty(n, bool), np.empty(n + 1, bool)
        begin[0], stop[0], stop[n] = solid[0], False, solid[-1]
        np.logical_and(solid[1:], ~solid[:-1], out=begin[1:])
        np.logical_and(solid[:-1], ~solid[1:], out=stop[1:n])
        begin[inner] = solid[inner]
        stop[inner] = solid[inner - 1]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(stop), np.searchsorted(starts, self.off)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~SPACE)


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, ``rows`` at most, whose texts have ``most`` bytes together, or one longer text."""
    array = batch.column(batch.schema.get_field_index(column))
    n = len(array)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + n + 1].astype(np.int64)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, lo + (rows or n))
        yield batch.slice(lo, hi - lo)
        lo = hi


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each run, from the first run of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and the text of each; a text with fewer words has one shingle of all its words, an empty text none.

    ``words`` are word hashes, ``first`` the first word of each text.
    """
    counts = np.diff(first)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), per)
    where = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first[:-1], per)
    running = prefix_hash(words)
    return spans(running, where, np.minimum(where + size, np.repeat(first[1:], per))), owner

"""Chains from blocks: a block of the reads' seeds meets a block of the contigs' hits, each pair of blocks in a task.

Reads and contigs are whole in their blocks, and so are the buckets (read, contig, joint strand) of
a pair. Anchors, by far the most rows of a mapping of many reads, are made and chained in memory,
some reads at a time; they are neither stored, shuffled nor sorted by Spark. The price is that
every block of seeds is read once for each block of hits: pairs grow with the square of the input,
at some 0.1 us for each seed of a pair (chaining takes some 2 us for each anchor).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.seeds import check
from strandweave.operators._groups import frugal
from strandweave.operators._store import stored
from strandweave.operators.chain import SHORT_SCHEMA, chain_rows
from strandweave.operators.minimizers import slices
from strandweave.params import Params

#: Hits and seeds that a block has at least, unless its partition ends; it ends with a contig or a read.
HITS, SEEDS = 3 << 20, 1 << 21
#: Anchors that are chained together; more where one read has more.
TOGETHER = 1 << 19
#: Hashes with their counts that leave a task at a time.
SENT = 1 << 16
#: Candidates of the cap that are sent to all tasks.
FEW = 1 << 22


def pack(x: np.ndarray) -> bytes:
    """An array as bytes: all first bytes of its numbers, then all second ones, and so on, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(data: pa.Buffer, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8].to_pybytes(), "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], most: int) -> Iterator[list[np.ndarray]]:
    """Columns in blocks of ``most`` rows or more, each of which ends with an owner, the first column."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for part in parts:
        if not len(part[0]):
            continue
        if n >= most:
            other = np.flatnonzero(part[0] != held[-1][0][-1])
            cut = int(other[0]) if len(other) else len(part[0])
            held.append(tuple(x[:cut] for x in part))
            if not len(other):
                continue
            yield _whole(held)
            n, part = 0, tuple(x[cut:] for x in part)
        held.append(part)
        n += len(part[0])
    if held:
        yield _whole(held)


def _whole(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Columns of the parts, which are given up."""
    columns = [list(x) for x in zip(*held, strict=True)]
    held.clear()
    return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]


def _owners(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each owner begins, its rows, and its number for each row."""
    new = np.append(True, owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(owner))), np.cumsum(new) - 1


def _kind(p: Params) -> type:
    """What holds a hash."""
    return np.uint32 if p.mask < 1 << 32 else np.uint64


def _steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, that pack well."""
    return np.diff(x, prepend=x.dtype.type(0))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def _packed(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    """A block as one row."""
    return pa.record_batch([pa.array([pack(x)], pa.binary()) for x in columns], [x.split()[0] for x in schema.split(", ")])


HIT_BLOCK = "hash binary, n binary, contig binary, place binary, contigs binary"


def hit_blocks(contigs: DataFrame, params: Params | None = None) -> DataFrame:
    """Blocks of the hits of ``contigs(contig_id, seq)``: hashes ascending, the number of each one's hits, and of these contig and place; contigs of one id must follow each other in one partition."""
    p = check(params)
    kind = _kind(p)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, h, pos, strand in slices(batch.column(1), p):
                yield ids[row], h.astype(kind), (pos << 1 | strand).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, h, place in _gathered(hits(batches), HITS):
            order = _sorted(h)
            h = h[order]
            at, n, _ = _owners(h)
            columns = [_steps(h[at]), n.astype(np.uint32), place[order]]
            del h, at, n, place
            first, _, number = _owners(owner)
            columns[2:2] = [number.astype(np.uint32)[order]]
            columns.append(owner[first])
            del owner, number, order
            yield _packed(columns, HIT_BLOCK)

    return contigs.select(F.col("contig_id").cast("long").alias("contig_id"), "seq").mapInArrow(frugal(run), HIT_BLOCK)


def over_cap(blocks: DataFrame, params: Params | None = None) -> DataFrame:
    """(hash) of the seeds with more than ``freq_cap`` hits in all ``blocks``.

    Such a seed has more than ``freq_cap`` / blocks of them in some block. Only seeds that do are
    counted in all blocks, and so few counts are shuffled.
    """
    p = check(params)
    kind = _kind(p)

    def counts(least: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for h, n in zip(batch.column(0), batch.column(1), strict=True):
                    many = unpack(n.as_buffer(), np.uint32)
                    on = many >= least
                    rows = pa.record_batch([pa.array(_sums(unpack(h.as_buffer(), kind))[on].astype(np.int64)), pa.array(many[on].astype(np.int64))], ["hash", "n"])
                    yield from (rows.slice(k, SENT) for k in range(0, rows.num_rows, SENT))

        return blocks.select("hash", "n").mapInArrow(run, "hash long, n long")

    rows, least = counts(1), p.freq_cap // max(1, blocks.count()) + 1
    if least > 1:
        some = stored(counts(least).select("hash").distinct().coalesce(8))
        if some.count() <= FEW:
            rows = rows.join(F.broadcast(some), "hash", "left_semi")
    return rows.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") > p.freq_cap).select("hash")


SEED_BLOCK = "s_hash binary, s_which binary, s_place binary, s_n binary, s_reads binary"


def seed_blocks(seeds: DataFrame, total: int, params: Params | None = None) -> DataFrame:
    """Blocks of ``seeds(read_id, q_pos, q_strand, hash)``, of which there are ``total``: distinct hashes ascending, and of each seed, by read and place, which one it has."""
    columns = ["read_id", "q_pos", "q_strand", "hash"]
    kind = _kind(check(params))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            read, pos, strand, h = (batch.column(k).to_numpy() for k in range(4))
            yield read, h.astype(kind), (pos << 1 | strand).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, h, place in _gathered(parts(batches), SEEDS):
            first, n, _ = _owners(owner)
            hashes, which = np.unique(h, return_inverse=True)
            yield _packed([_steps(hashes), which.astype(np.uint32), place, n.astype(np.uint32), owner[first]], SEED_BLOCK)

    rows = seeds.select(F.col("read_id").cast("long").alias("read_id"), *columns[1:]).where(F.col("read_id").isNotNull())
    return rows.repartition(max(1, -(-total // SEEDS)), "read_id").sortWithinPartitions("read_id", "q_pos").mapInArrow(frugal(run), SEED_BLOCK)


def _sorted(high: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """The order by ``high``, then ``low`` (whole numbers, none negative), then place."""
    at, l = (len(high) - 1).bit_length(), 0 if low is None else int(low.max()).bit_length()
    if int(high.max()).bit_length() + l + at > 63:
        return np.argsort(high, kind="stable") if low is None else np.lexsort((low, high))
    key = high.astype(np.int64)
    if low is not None:
        key <<= l
        key |= low
    key <<= at
    key |= np.arange(len(key))
    key.sort()
    key &= (1 << at) - 1
    return key


def _pair(hits: tuple[np.ndarray, ...], seeds: tuple[np.ndarray, ...], p: Params, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """Chains of a pair of blocks, of whole reads with at most ``most`` anchors at a time, or of one read."""
    hashes, many, contig, place, contigs = hits
    asked, which, s_place, s_n, reads = seeds
    if not len(hashes) or not len(asked):
        return
    at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
    n = np.where(hashes[at] == asked, many[at], 0)
    if not n.any():
        return
    on = np.flatnonzero(n[which])
    at = at[which[on]]
    each, first, read = many[at].astype(np.int64), (np.cumsum(many, dtype=np.int64) - many)[at], np.repeat(np.arange(len(reads)), s_n)[on]
    del at, n
    begin, _, _ = _owners(read)
    done = np.append(0, np.cumsum(each))
    cuts, bounds = [0], done[np.append(begin, len(on))]
    while cuts[-1] < len(begin):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + most, "right")) - 1))
    begin = np.append(begin, len(on))
    for lo, hi in zip(begin[cuts[:-1]].tolist(), begin[cuts[1:]].tolist(), strict=True):
        rows, total = each[lo:hi], int(done[hi] - done[lo])
        if total < least:
            continue
        seed = np.repeat(on[lo:hi], rows)
        hit = np.repeat(first[lo:hi] - (done[lo:hi] - done[lo]), rows) + np.arange(total)
        joint = (place[hit] ^ s_place[seed]) & 1
        bucket = (np.repeat(read[lo:hi] - read[lo], rows) * len(contigs) + contig[hit]) * 2 + joint
        order = _sorted(bucket)
        _, size, _ = _owners(bucket[order])
        order = order[np.repeat(size >= least, size)]
        if not len(order):
            continue
        edges, _, number = _owners(bucket[order])
        r = (place[hit[order]] >> 1).astype(np.int64)
        last = _sorted(number, r)  # anchors of one bucket and place come by their place on the read, as seeds do
        order, r = order[last], r[last]
        seed = seed[order]
        who = bucket[order] // 2
        out = chain_rows(reads[who // len(contigs) + read[lo]], contigs[who % len(contigs)], joint[order].astype(np.int64), r, (s_place[seed] >> 1).astype(np.int64), which[seed], None, np.append(edges, len(order)), p, least, False)
        if out is not None:
            yield out


def block_chains(hits: DataFrame, seeds: DataFrame, params: Params | None = None, least: int = 2) -> DataFrame:
    """Chains of ``least`` anchors or more, without their anchors, of all pairs of blocks; a bucket must lie in one pair."""
    p = check(params)
    kind = _kind(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = right = (None, None)  # one of the two stays for several pairs

        def block(row: list[pa.Buffer], kinds: tuple[type, ...]) -> tuple[pa.Buffer, tuple[np.ndarray, ...]]:
            hashes, *rest = (unpack(x, k) for x, k in zip(row, kinds, strict=True))
            return pa.py_buffer(row[-1].to_pybytes()), (_sums(hashes), *rest)

        for batch in batches:
            for k in range(batch.num_rows):
                x = [batch.column(c)[k].as_buffer() for c in range(10)]
                if left[0] is None or not left[0].equals(x[4]):  # the names tell which block it is
                    left = (None, None)
                    left = block(x[:5], (kind, np.uint32, np.uint32, np.uint32, np.int64))
                if right[0] is None or not right[0].equals(x[9]):
                    right = (None, None)
                    right = block(x[5:], (kind, np.uint32, np.uint32, np.uint32, np.int64))
                yield from _pair(left[1], right[1], p, max(2, least), TOGETHER)

    return hits.crossJoin(seeds).mapInArrow(frugal(run), SHORT_SCHEMA)

"""Packed binary interchange: shards, contig table, 2-bit sequences and bundles.

The engine itself keeps everything in Parquet; these are for exchanging files. Layouts are
little-endian. A shard: 64-byte header (magic, version, shard, seeds, 0, hits, directory at,
hits at, 0, 0), 16 bytes per seed (hash, first hit, count | flags << 24), 6 bytes per hit
(contig, position | strand << 28 | flags << 29).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = b"SEEDSHRD", 2
HEADER = struct.Struct("<8sIIIIQQQQQ")
ENTRY = np.dtype([("hash", "<u8"), ("offset", "<u4"), ("count", "<u4")])
HIT = np.dtype([("contig", "<u2"), ("word", "<u4")])
BUNDLE_MAGIC = b"SEEDBNDL"


def encode_shard(shard: int, hash_: np.ndarray, contig: np.ndarray, pos: np.ndarray, strand: np.ndarray, flags: np.ndarray | None = None, magic: bytes = MAGIC) -> bytes:
    """One shard file; hits are sorted by (hash, contig, pos). Contigs above 16 and positions above 28 bits are errors."""
    if len(contig) and (contig.max() >= 1 << 16 or pos.max() >= 1 << 28):
        raise ValueError("contig or position does not fit the packed hit")
    order = np.lexsort((pos, contig, hash_))
    seeds, first, count = np.unique(hash_[order], return_index=True, return_counts=True)
    entries = np.zeros(len(seeds), ENTRY)
    entries["hash"], entries["offset"], entries["count"] = seeds, first, count
    hits = np.zeros(len(order), HIT)
    hits["contig"] = contig[order]
    extra = np.zeros(len(order), np.int64) if flags is None else flags[order]
    hits["word"] = pos[order] | (strand[order] & 1) << 28 | (extra & 7) << 29
    head = HEADER.pack(magic, VERSION, shard, len(seeds), 0, len(hits), HEADER.size, HEADER.size + entries.nbytes, 0, 0)
    return head + entries.tobytes() + hits.tobytes()


def decode_shard(body: bytes, magic: bytes = MAGIC) -> tuple[int, dict[str, np.ndarray]]:
    """Shard number and its hits as columns; a wrong magic, version or count is an error."""
    if len(body) < HEADER.size:
        raise ValueError("shard is shorter than its header")
    got, version, shard, seeds, _, n, at, hits_at, _, _ = HEADER.unpack_from(body)
    if got != magic or version != VERSION:
        raise ValueError("not a shard of this magic and version")
    entries, hits = np.frombuffer(body, ENTRY, seeds, at), np.frombuffer(body, HIT, n, hits_at)
    count = entries["count"] & 0xFFFFFF
    if int(count.sum()) != n:
        raise ValueError("directory counts do not add up to the hits")
    word = hits["word"].astype(np.int64)
    return shard, {"hash": np.repeat(entries["hash"], count).astype(np.int64), "contig_id": hits["contig"].astype(np.int64), "pos": word & 0xFFFFFFF, "strand": (word >> 28) & 1, "flags": (word >> 29) & 7}


def shards(index: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """(shard_id, content, size, sha256): the index as one binary file per shard."""

    def pack(group: pa.Table) -> pa.Table:
        shard = group.column("shard_id")[0].as_py()
        body = encode_shard(shard, *[group.column(c).to_numpy() for c in ("hash", "contig_id", "pos", "strand")], magic=magic)
        return pa.table({"shard_id": pa.array([shard], pa.int32()), "content": pa.array([body], pa.binary())})

    out = index.select("shard_id", "hash", F.col("contig_id").cast("long"), "pos", F.col("strand").cast("long")).groupBy("shard_id").applyInArrow(pack, "shard_id int, content binary")
    return out.select("shard_id", "content", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_shards(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """(shard_id, hash, contig_id, pos, strand, flags) from shard files of any file system."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body in batch["content"]:
                shard, columns = decode_shard(bytes(body), magic)
                yield pd.DataFrame({"shard_id": np.full(len(columns["hash"]), shard), **columns})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "shard_id int, hash long, contig_id long, pos long, strand long, flags long")


def encode_contigs(names: list[str], lengths: list[int]) -> bytes:
    """Count and 0, a record (name at, name size, 0, length) per contig, then all names."""
    raw = [n.encode() for n in names]
    out, at = [struct.pack("<II", len(raw), 0)], 0
    for n, size in zip(raw, lengths, strict=True):
        out.append(struct.pack("<IHHQ", at, len(n), 0, size))
        at += len(n)
    return b"".join(out) + b"".join(raw)


def decode_contigs(body: bytes) -> list[tuple[int, str, int]]:
    """(contig_id, name, length) in order."""
    (n, _), names = struct.unpack_from("<II", body), 8 + 16 * struct.unpack_from("<I", body)[0]
    rows = [struct.unpack_from("<IHHQ", body, 8 + 16 * k) for k in range(n)]
    return [(k, body[names + a : names + a + m].decode(), size) for k, (a, m, _, size) in enumerate(rows)]


def pack_bases(seq: str) -> bytes:
    """Four bases a byte, the first in the low bits; other letters count as A."""
    code = np.zeros(256, np.uint8)
    for k, b in enumerate(b"ACGT"):
        code[b] = code[b + 32] = k
    x = code[np.frombuffer(seq.encode(), np.uint8)]
    x = np.pad(x, (0, -len(x) % 4)).reshape(-1, 4)
    return (x << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes()


def unpack_bases(body: bytes, start: int, end: int, length: int) -> str:
    """Bases [start, end) clamped to the sequence."""
    start, end = max(0, start), min(end, length)
    if end <= start:
        return ""
    raw = np.frombuffer(body, np.uint8)[start // 4 : -(-end // 4)]
    x = ((raw[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()[start % 4 :][: end - start]
    return np.frombuffer(b"ACGT", np.uint8)[x].tobytes().decode()


def contig_offsets(lengths: list[int]) -> list[int]:
    """Where each contig's bytes start in the joined 2-bit file."""
    return [int(x) for x in np.cumsum([0, *[-(-n // 4) for n in lengths]])[:-1]]


def encode_bundle(files: dict[str, bytes], magic: bytes = BUNDLE_MAGIC) -> bytes:
    """Files by name in one: header of 32 bytes, table (name size, 0, size, offset, sha256, name), contents."""
    table, data = b"", b""
    for name in sorted(files):
        raw = name.encode()
        table += struct.pack("<HHQQ", len(raw), 0, len(files[name]), len(data)) + hashlib.sha256(files[name]).digest() + raw
        data += files[name]
    return struct.pack("<8sIIIQ", magic, 1, 0, len(files), 32 + len(table)).ljust(32, b"\0") + table + data


def decode_bundle(body: bytes, magic: bytes = BUNDLE_MAGIC) -> dict[str, bytes]:
    """Names and contents; a wrong magic, version, bound or checksum is an error."""
    if len(body) < 32:
        raise ValueError("bundle is shorter than its header")
    got, version, _, n, data = struct.unpack_from("<8sIIIQ", body)
    if got != magic or version != 1 or data > len(body):
        raise ValueError("not a bundle of this magic and version")
    out, at = {}, 32
    for _ in range(n):
        size_of_name, _, size, offset = struct.unpack_from("<HHQQ", body, at)
        digest, name = body[at + 20 : at + 52], body[at + 52 : at + 52 + size_of_name].decode()
        at += 52 + size_of_name
        out[name] = body[data + offset : data + offset + size]
        if at > data or hashlib.sha256(out[name]).digest() != digest:
            raise ValueError(f"{name} is damaged")
    return out

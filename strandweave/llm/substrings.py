"""Substring dedup, seed and extend: repeated runs of words.

Seeds are winnowed anchors (``SEED`` words; any run of ``WINDOW`` words holds one). Documents
are joined on them: seeds meet in buckets keyed by the seed's hash. A match is extended both
ways, first to everything the seed's windows cover (equal units), then, where contexts differ,
to the exact number of words that agree; consecutive matches fuse into maximal repeats of at
least ``WINDOW`` words. See ``_repeats`` for why no pair of documents is ever listed.

Windows count wherever they start, in the same document too; nothing is judged on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import _repeats as R
from strandweave.llm._arrow import Texts, U, prefix_hash, sliced, spans, sums, table
from strandweave.llm._shared import documents

WINDOW = 35
SEED = 10
_T = table(6)


class _Slice:
    """The words of a slice, their units and running hash."""

    def __init__(self, rows: pa.RecordBatch, window: int, seed: int) -> None:
        self.texts = Texts(rows.column(1))
        self.ids = rows.column(0)
        self.start, self.end, self.bounds = self.texts.words()
        self.units, self.running = R.units(spans(prefix_hash(_T[self.texts.data]), self.start, self.end), self.bounds, window, seed)


def _slices(group: pa.Table, window: int, seed: int) -> list[_Slice]:
    batches = group.select(["doc_id", "text"]).combine_chunks().to_batches()
    return [_Slice(rows, window, seed) for b in batches for rows in sliced(b)]


def _bits(answers: pa.Table, round_: int) -> dict[int, np.ndarray]:
    return {b: np.frombuffer(x, np.uint8) for b, r, x in zip(*[answers.column(c).to_pylist() for c in ("bucket", "round", "bits")], strict=True) if r == round_}


class _Batch:
    """A batch's units, its distinct (anchor, content) pairs in message order, and their bounds by bucket."""

    def __init__(self, group: pa.Table, window: int, seed: int, buckets: int) -> None:
        self.slices = _slices(group, window, seed)
        u = [s.units for s in self.slices]
        self.anchor = np.concatenate([x.anchor for x in u]) if u else np.zeros(0, U)
        self.content = np.concatenate([x.content for x in u]) if u else np.zeros(0, U)
        order, heads, self.which = R.distinct(self.anchor, self.content)
        self.lead = order[heads]  # one unit of each pair
        self.times = np.diff(np.append(heads, len(order)))
        self.entries = R.Entries(self.anchor[self.lead], self.content[self.lead], buckets)
        self.buckets = buckets

    def sends(self) -> Iterator[tuple[int, int, bytes]]:
        return self.entries.sends(self.times > 1)

    def answered(self, answers: pa.Table) -> np.ndarray:
        """The first round's bits (1 first, 2 repeated, 4 several contexts, or 8 hot) of each pair."""
        return self.entries.answered(_bits(answers, 1))

    def second(self, bits: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """Pairs of the second round, all their windows as (pair among them, index of the window's hash), the distinct hashes in bucket order, which of them the batch has more than once, and bounds by bucket."""
        chosen = np.flatnonzero(((bits & 5) == 5) | ((bits & R.HOT) > 0))
        hashes, which = self.windows(chosen, window)
        distinct, index, count = np.unique(hashes, return_inverse=True, return_counts=True)
        again = count > 1
        again[index[((bits[chosen] & R.HOT) > 0)[which] & (self.times[chosen] > 1)[which]]] = True
        return chosen, which, index, distinct, again, np.searchsorted(R.bucket_of(distinct, self.buckets), np.arange(self.buckets + 1))

    def windows(self, pairs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of one unit of each pair, and the pair's index among ``pairs``."""
        base = np.cumsum([0, *[len(s.units.anchor) for s in self.slices]])
        unit = self.lead[pairs]
        home = np.searchsorted(base, unit, "right") - 1
        hashes, which = [], []
        for k, s in enumerate(self.slices):
            mine = np.flatnonzero(home == k)
            if len(mine):
                u = unit[mine] - base[k]
                at, of = R.expand(s.units.first[u], s.units.count[u])
                hashes.append(spans(s.running, at, at + window))
                which.append(mine[of])
        if not hashes:
            return np.zeros(0, U), np.zeros(0, np.int64)
        hashes, which = np.concatenate(hashes), np.concatenate(which)
        order = np.argsort(which, kind="stable")
        return hashes[order], which[order]


def find_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, n_words, n_removed, spans array<struct<first, last>>, kept string), a row per row.

    ``spans`` are the maximal repeats by word number (both ends in); ``kept`` is the other words
    joined by one space. Null and empty texts have no words. Rows with one id are judged like
    different documents; a text with several rows repeats as a whole if it has ``window`` words.
    Other columns are ignored; an empty table gives an empty result.
    """
    if not 1 <= seed <= window:
        raise ValueError("seed must be between 1 and window")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = R.batches_for(int(total), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("batch"))

    def send(group: pa.Table) -> pa.Table:
        rows = list(_Batch(group, window, seed, n).sends())
        me = group.column("batch")[0].as_py()
        return pa.table({"batch": pa.array([me] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "pairs": pa.array([r[1] for r in rows], pa.int32()), "body": pa.array([r[2] for r in rows], pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        sizes = group.column("pairs").to_numpy()
        parts = [R.unpack(b.as_buffer(), p) for b, p in zip(group.column("body"), sizes, strict=True)]
        first, often, several, hot = R.judge(np.repeat(group.column("batch").to_numpy(), sizes), *[np.concatenate(x) for x in zip(*parts, strict=True)])
        bits = np.where(hot, R.HOT, first + 2 * often.astype(np.uint8) + 4 * several.astype(np.uint8)).astype(np.uint8)
        bits = np.split(bits, np.cumsum(sizes)[:-1])
        return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"), "round": pa.array(np.ones(len(bits), np.int32)), "bits": pa.array([b.tobytes() for b in bits], pa.binary())})

    def extend(group: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if group.num_rows:
            own = _Batch(group, window, seed, n)
            *_, hashes, again, edges = own.second(own.answered(answers), window)
            me = group.column("batch")[0].as_py()
            rows = [(me, b, hashes[edges[b] : edges[b + 1]].astype("<u8").tobytes() + np.packbits(again[edges[b] : edges[b + 1]]).tobytes(), int(edges[b + 1] - edges[b])) for b in np.flatnonzero(np.diff(edges)).tolist()]
        return pa.table({"batch": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "body": pa.array([r[2] for r in rows], pa.binary()), "pairs": pa.array([r[3] for r in rows], pa.int32())})

    def agree(group: pa.Table) -> pa.Table:
        sizes = group.column("pairs").to_pylist()
        parts = [np.frombuffer(b.as_buffer()[: 8 * k], "<u8") for b, k in zip(group.column("body"), sizes, strict=True)]
        again = np.concatenate([np.unpackbits(np.frombuffer(b.as_buffer()[8 * k :], np.uint8))[:k].astype(bool) for b, k in zip(group.column("body"), sizes, strict=True)])
        all_ = np.concatenate(parts)
        order = np.argsort(all_)
        x = all_[order]
        same = np.zeros(len(x), bool)
        same[1:] |= x[1:] == x[:-1]
        same[:-1] |= x[1:] == x[:-1]
        out = np.empty(len(x), np.uint8)
        out[order] = same
        out |= again  # equal windows of one batch are one entry
        bits = np.split(out, np.cumsum([len(p) for p in parts])[:-1])
        return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"), "round": pa.array(np.full(len(bits), 2, np.int32)), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    schema = f"doc_id {kind}, n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept string"

    def cut(group: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Batch(group, window, seed, n)
        bits = own.answered(answers)
        chosen, which, index, distinct, _, edges = own.second(bits, window)
        repeated = np.zeros(len(distinct), bool)
        for b, x in _bits(answers, 2).items():
            repeated[edges[b] : edges[b + 1]] = np.unpackbits(x)[: edges[b + 1] - edges[b]].astype(bool)
        hit = repeated[index]
        begins = np.searchsorted(which, np.arange(len(chosen) + 1))
        slot = np.full(len(own.lead), -1)
        slot[chosen] = np.arange(len(chosen))
        out, base = [], 0
        for s in own.slices:
            pair = own.which[base : base + len(s.units.first)]
            base += len(s.units.first)
            whole = (bits[pair] & 2) > 0
            first, last = s.units.first[whole], s.units.first[whole] + s.units.count[whole] - 1 + window
            some = np.flatnonzero(~whole & (slot[pair] >= 0))
            if len(some):
                at, of = R.expand(s.units.first[some], s.units.count[some])
                from_ = begins[slot[pair[some]]]
                step = at - s.units.first[some][of]
                good = hit[from_[of] + step]
                first, last = np.concatenate([first, at[good]]), np.concatenate([last, at[good] + window])
            gone = R.covered(len(s.start), first, last)
            out.append(_rows(s, gone, names))
        return pa.concat_tables([pa.Table.from_batches([x]) for x in out]) if out else pa.table({f.name: pa.array([], f.type) for f in empty})

    names = [x.split()[0] for x in schema.split(", ")]
    empty = pa.schema([])
    message = "batch int, bucket int, pairs int, body binary"
    reply = "batch int, bucket int, round int, bits binary"
    by_batch = dealt.groupBy("batch")
    one = by_batch.applyInArrow(send, message).groupBy("bucket").applyInArrow(answer, reply)
    two = by_batch.cogroup(one.groupBy("batch")).applyInArrow(extend, "batch int, bucket int, body binary, pairs int").groupBy("bucket").applyInArrow(agree, reply)
    return by_batch.cogroup(one.unionByName(two).groupBy("batch")).applyInArrow(cut, schema)


def _rows(s: _Slice, gone: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Result rows of a slice, given which words go."""
    t = s.texts
    first, last = R.runs_of(gone, s.bounds)
    per = np.searchsorted(first, s.bounds)
    offset = s.bounds[np.searchsorted(s.bounds, first, "right") - 1]
    ranges = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.StructArray.from_arrays([pa.array((first - offset).astype(np.int32)), pa.array((last - offset - 1).astype(np.int32))], ["first", "last"]))
    keep = np.flatnonzero(~gone)
    n = len(t.data)
    mask = R.covered(n, s.start[keep], s.end[keep])
    # one blank after each kept word that isn't its text's last
    owner = np.searchsorted(s.bounds, keep, "right") - 1
    follow = np.zeros(len(keep), bool)
    follow[:-1] = owner[1:] == owner[:-1]
    blank = s.end[keep[follow]]
    data = t.data.copy()
    data[blank] = 32
    mask[blank] = True
    off = np.zeros(n + 1, np.int64)
    np.cumsum(mask, out=off[1:])
    kept = pa.Array.from_buffers(pa.string(), len(t), [None, pa.py_buffer(off[t.off].astype(np.int32)), pa.py_buffer(data[mask])])
    return pa.record_batch([s.ids, pa.array(np.diff(s.bounds)), pa.array(sums(gone, s.bounds)), ranges, kept], names)


def op6_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and n_repeats (maximal repeats) for every document."""
    found = find_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_repeats"))

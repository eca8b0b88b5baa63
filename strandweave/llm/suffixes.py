"""Suffix-array dedup by prefix-free parsing, for byte strings that repeat across documents.

Rolling-hash triggers (the least ``GRAM``-byte hash of each ``WINDOW`` bytes) cut every text
into phrases that overlap by ``WINDOW - 1`` bytes, so each string of ``WINDOW`` bytes starts in
exactly one phrase and equal strings start at equal places after equal triggers. Highly
repetitive text collapses: the *parse* (which document uses which phrase, documents in order of
doc_id) is all that grows with the number of copies, while the *dictionary* holds each distinct
phrase once.

Dictionary and parse are spread over buckets by trigger hash, so that all strings that could be
equal are in one bucket. There the suffixes of the dictionary's phrases are sorted to ``WINDOW``
bytes; neighbours that agree are one string, and the parse gives the corpus order of its
occurrences: batches hold ascending ranges of doc_id, so the earliest document of a string is
in the earliest batch that uses it. A batch learns for each of its phrases (or, where phrases
with the same trigger differ, for each suffix) whether an earlier batch has it; inside the batch
the documents are compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import _repeats as R
from strandweave.llm._arrow import Texts, U, sliced, spans, sums, table
from strandweave.llm._ranges import cut_ranges, part_of, text_bytes
from strandweave.llm._shared import documents

WINDOW = 50
GRAM = 24
#: Bytes of text in a batch; its phrases, hashes and answers take about forty times that in a task.
BATCH_BYTES = 3 << 20
_T = table(9)


class _Slice:
    """The bytes of a slice, its phrases and running hash."""

    def __init__(self, rows: pa.RecordBatch, window: int, gram: int) -> None:
        self.texts = Texts(rows.column(1))
        self.ids = rows.column(0)
        self.units, self.running = R.units(_T[self.texts.data], self.texts.off, window, gram)


def _rank(ids: pa.ChunkedArray) -> np.ndarray:
    """Dense ranks of doc_ids; null comes first, equal ids are equal."""
    return pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


class _Batch:
    """A batch's phrases and its distinct (trigger, phrase) pairs in message order."""

    def __init__(self, group: pa.Table, window: int, gram: int, buckets: int) -> None:
        group = group.select(["doc_id", "text"]).combine_chunks()
        self.window, self.buckets = window, buckets
        self.slices = [_Slice(rows, window, gram) for b in group.to_batches() for rows in sliced(b)]
        rank, docs = _rank(group.column(0)), np.cumsum([0, *[len(s.texts) for s in self.slices]])
        u = [s.units for s in self.slices]
        self.base = np.cumsum([0, *[len(x.anchor) for x in u]])
        self.anchor = np.concatenate([x.anchor for x in u]) if u else np.zeros(0, U)
        content = np.concatenate([x.content for x in u]) if u else np.zeros(0, U)
        self.content = content
        self.rank = np.concatenate([rank[d + x.text] for d, x in zip(docs, u, strict=False)]) if u else np.zeros(0, np.int64)
        order, heads, self.which = R.distinct(self.anchor, content)
        self.lead = order[heads]
        self.early = np.minimum.reduceat(self.rank[order], heads) if len(heads) else np.zeros(0, np.int64)
        self.entries = R.Entries(self.anchor[self.lead], self.content[self.lead], buckets)

    def answered(self, answers: pa.Table) -> np.ndarray:
        """The first round's bits (1 an earlier batch has it, 4 its trigger has other phrases, or 8 hot) of each pair."""
        return self.entries.answered(_answers(answers, 1))

    def open(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose suffixes must be looked up one by one: those of ordinary triggers, then those of hot ones."""
        return np.flatnonzero((bits & 5) == 4), np.flatnonzero((bits & R.HOT) > 0)

    def suffixes(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all suffixes (windows) of each pair's phrase, in order, and their bounds by pair."""
        begins = np.append(0, np.cumsum(self.counts(pairs)))
        hashes = np.zeros(begins[-1], U)
        unit = self.lead[pairs]
        home = np.searchsorted(self.base, unit, "right") - 1
        for k, s in enumerate(self.slices):
            mine = np.flatnonzero(home == k)
            if len(mine):
                u = unit[mine] - self.base[k]
                at, of = R.expand(s.units.first[u], s.units.count[u])
                hashes[begins[mine][of] + at - s.units.first[u][of]] = spans(s.running, at, at + self.window)
        return hashes, begins

    def hot_strings(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct suffixes of hot triggers: index of each suffix, a suffix (pair's place x 2^20 + offset) that shows each string, and bounds by bucket."""
        hashes, begins = self.suffixes(pairs)
        distinct, shown, index = np.unique(hashes, return_index=True, return_inverse=True)
        of = np.searchsorted(begins, shown, "right") - 1
        return index, (of << 20) + shown - begins[of], np.searchsorted(R.bucket_of(distinct, self.buckets), np.arange(self.buckets + 1))

    def phrase(self, pair: int) -> bytes:
        """The bytes of a pair's phrase."""
        unit = self.lead[pair]
        k = int(np.searchsorted(self.base, unit, "right")) - 1
        s = self.slices[k]
        first, count = s.units.first[unit - self.base[k]], s.units.count[unit - self.base[k]]
        return s.texts.data[first : first + count + self.window - 1].tobytes()

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """Suffixes (windows) of each pair's phrase."""
        every = np.concatenate([s.units.count for s in self.slices]) if self.slices else np.zeros(0, np.int64)
        return every[self.lead[pairs]]

    def inside(self, pairs: np.ndarray) -> np.ndarray:
        """The earliest rank in this batch of each suffix of the pairs, over all these pairs."""
        x, begins = self.suffixes(pairs)
        early = np.repeat(self.early[pairs], np.diff(begins))
        order = np.argsort(x)
        x = x[order]
        heads = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
        out = np.empty(len(x), np.int64)
        if len(x):
            out[order] = np.repeat(np.minimum.reduceat(early[order], heads), np.diff(np.append(heads, len(x))))
        return out


def _answers(table_: pa.Table, round_: int) -> dict[int, np.ndarray]:
    return {b: np.frombuffer(x, np.uint8) for b, r, x in zip(*[table_.column(c).to_pylist() for c in ("bucket", "round", "bits")], strict=True) if r == round_}


def suffix_order(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a dictionary to ``window`` bytes: suffixes in lexicographic order, and where a string differs from the one before.

    The first eight bytes sort at once; only runs that still agree are sorted by the next eight.
    """
    padded = np.concatenate([data, np.zeros(window + 8, np.uint8)])
    order = np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    if len(new):
        new[0] = True
    todo = np.ones(len(starts), bool)
    for depth in range(0, window, 8):
        width = min(8, window - depth)
        at = np.flatnonzero(todo)
        if not len(at):
            break
        where = starts[order[at]] + depth
        key = np.zeros(len(at), U)
        for k in range(width):
            key = (key << U(8)) | padded[where + k].astype(U)
        group = np.cumsum(new)[at]
        by = np.lexsort((key, group))
        order[at] = order[at][by]
        key = key[by]
        differs = np.zeros(len(at), bool)
        differs[1:] = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        new[at] |= differs
        last = np.append(new[1:], True)
        todo = ~(new & last)  # runs of one are settled
    return order, new


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, n_bytes, n_removed, spans array<struct<first, last>>, kept binary), a row per row.

    A byte goes if a string of ``window`` bytes that covers it also starts in a document with a
    smaller doc_id; ``spans`` are the maximal runs that go (byte numbers, both ends in) and
    ``kept`` is the rest. Null and empty texts have no bytes. Rows with one doc_id don't count
    against each other; a null doc_id is smaller than all others. Ids are whole numbers (others
    raise a ``TypeError``). Other columns are ignored; an empty table gives an empty result.

    Batches are even in bytes. An id with more than a batch of text has batches of its own: they
    are level, so none of them is earlier than another.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = R.batches_for(text_bytes(docs), partitions, BATCH_BYTES)
    ranges = cut_ranges(docs, size, max(10_000, 10 * size))
    n, level = ranges.parts, ranges.level()
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("batch", part_of(ranges))

    def send(group: pa.Table) -> pa.Table:
        rows = list(_Batch(group, window, gram, n).entries.sends())
        me = group.column("batch")[0].as_py()
        return pa.table({"batch": pa.array([me] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "pairs": pa.array([r[1] for r in rows], pa.int32()), "body": pa.array([r[2] for r in rows], pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        sizes = group.column("pairs").to_numpy()
        parts = [R.unpack(b.as_buffer(), p) for b, p in zip(group.column("body"), sizes, strict=True)]
        first, _, several, hot = R.judge(np.repeat(level[group.column("batch").to_numpy()], sizes), *[np.concatenate(x) for x in zip(*parts, strict=True)])
        bits = np.split(np.where(hot, R.HOT, ~first + 4 * several.astype(np.uint8)).astype(np.uint8), np.cumsum(sizes)[:-1])
        return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"), "round": pa.array(np.ones(len(bits), np.int32)), "bits": pa.array([b.tobytes() for b in bits], pa.binary())})

    def phrases(group: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if group.num_rows:
            own = _Batch(group, window, gram, n)
            cold, hot = own.open(own.answered(answers))
            me = group.column("batch")[0].as_py()
            edges = np.searchsorted(R.bucket_of(own.anchor[own.lead[cold]], n), np.arange(n + 1))
            for b in np.flatnonzero(np.diff(edges)):
                own_phrases = [own.phrase(p) for p in cold[edges[b] : edges[b + 1]]]
                rows.append((me, int(b), np.array([len(p) for p in own_phrases], "<i4").tobytes(), b"".join(own_phrases), 2))
            # strings of hot triggers go one by one, to the bucket of the string
            _, shown, edges = own.hot_strings(hot)
            for b in np.flatnonzero(np.diff(edges)):
                strings = [own.phrase(hot[x >> 20])[x & 0xFFFFF :][:window] for x in shown[edges[b] : edges[b + 1]].tolist()]
                rows.append((me, int(b), np.full(len(strings), window, "<i4").tobytes(), b"".join(strings), 3))
        return pa.table({"batch": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "sizes": pa.array([r[2] for r in rows], pa.binary()), "body": pa.array([r[3] for r in rows], pa.binary()), "round": pa.array([r[4] for r in rows], pa.int32())})

    def look_up(group: pa.Table) -> pa.Table:
        """Sort the suffixes of this bucket's part of the dictionary; a bit for each: an earlier batch has this string."""
        batch = level[group.column("batch").to_numpy()]
        sizes = [np.frombuffer(s.as_buffer(), "<i4").astype(np.int64) for s in group.column("sizes")]
        data = np.concatenate([np.frombuffer(b.as_buffer(), np.uint8) for b in group.column("body")])
        length = np.concatenate(sizes)
        begin = np.cumsum(length) - length
        starts, which = R.expand(begin, length - window + 1)
        user = np.repeat(batch, [len(s) for s in sizes])[which]
        order, new = suffix_order(data, starts, window)
        heads = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(user[order], heads), np.diff(np.append(heads, len(order))))
        earlier = np.empty(len(order), bool)
        earlier[order] = least < user[order]
        windows = np.cumsum([int((s - window + 1).sum()) for s in sizes])[:-1]
        bits = [np.packbits(b).tobytes() for b in np.split(earlier, windows)]
        return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"), "round": group.column("round"), "bits": pa.array(bits, pa.binary())})

    schema = f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<first:int,last:int>>, kept binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(group: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Batch(group, window, gram, n)
        bits = own.answered(answers)
        cold, hot = own.open(bits)
        chosen = np.concatenate([cold, hot])
        begins = np.append(0, np.cumsum(own.counts(chosen)))
        edges = begins[np.searchsorted(R.bucket_of(own.anchor[own.lead[cold]], n), np.arange(n + 1))]
        hit = np.zeros(begins[-1], bool)
        for b, x in _answers(answers, 2).items():
            hit[edges[b] : edges[b + 1]] = np.unpackbits(x)[: edges[b + 1] - edges[b]].astype(bool)
        index, shown, edges = own.hot_strings(hot)
        strings = np.zeros(len(shown), bool)
        for b, x in _answers(answers, 3).items():
            strings[edges[b] : edges[b + 1]] = np.unpackbits(x)[: edges[b + 1] - edges[b]].astype(bool)
        hit[begins[len(cold)] :] = strings[index]
        early = own.inside(chosen)
        slot = np.full(len(own.lead), -1)
        slot[chosen] = np.arange(len(chosen))
        out = []
        for k, s in enumerate(own.slices):
            pair, rank = own.which[own.base[k] : own.base[k + 1]], own.rank[own.base[k] : own.base[k + 1]]
            single = slot[pair] < 0
            whole = single & (((bits[pair] & 1) > 0) | (rank > own.early[pair]))
            first, last = s.units.first[whole], s.units.first[whole] + s.units.count[whole] - 1 + window
            some = np.flatnonzero(~single)
            if len(some):
                at, of = R.expand(s.units.first[some], s.units.count[some])
                i = begins[slot[pair[some]]][of] + at - s.units.first[some][of]
                good = hit[i] | (early[i] < rank[some][of])
                first, last = np.concatenate([first, at[good]]), np.concatenate([last, at[good] + window])
            t = s.texts
            gone = R.covered(len(t.data), first, last)
            a, b = R.runs_of(gone, t.off)
            per = np.searchsorted(a, t.off)
            offset = t.off[np.searchsorted(t.off, a, "right") - 1]
            runs = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.StructArray.from_arrays([pa.array((a - offset).astype(np.int32)), pa.array((b - offset - 1).astype(np.int32))], ["first", "last"]))
            size, removed = np.diff(t.off), sums(gone, t.off)
            end = np.append(0, np.cumsum(size - removed)).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer(end), pa.py_buffer(t.data[~gone])])
            out.append(pa.record_batch([s.ids, pa.array(size), pa.array(removed), runs, kept], names))
        return pa.Table.from_batches(out)

    message = "batch int, bucket int, pairs int, body binary"
    reply = "batch int, bucket int, round int, bits binary"
    by_batch = dealt.groupBy("batch")
    one = by_batch.applyInArrow(send, message).groupBy("bucket").applyInArrow(answer, reply)
    two = by_batch.cogroup(one.groupBy("batch")).applyInArrow(phrases, "batch int, bucket int, sizes binary, body binary, round int").groupBy("bucket").applyInArrow(look_up, reply)
    return by_batch.cogroup(one.unionByName(two).groupBy("batch")).applyInArrow(cut, schema)


def op9_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    found = find_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

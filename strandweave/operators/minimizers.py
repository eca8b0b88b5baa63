"""(w, k) canonical minimizers in forms that agree row for row.

``minimizers`` and ``chunk_minimizers`` hand Arrow batches to numpy (the forms for scale: whole
sequences, or chunks of long ones), ``minimizers_sql`` is plain DataFrame algebra that Catalyst
sees through. All emit, for every run of ACGT with at least
k + w - 1 bases, the k-mer of least hash in each window of w k-mers, rightmost on ties, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.seeds import check, hash_steps, with_seed_hash
from strandweave.operators.chunks import cut, slice_of
from strandweave.params import Params

_CODE = np.full(256, 4, np.uint8)
for _k, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _k
SLICE = 1 << 19
PIECE = 256


def mix_seed(x: np.ndarray, k: int) -> np.ndarray:
    """``seed_hash`` on unsigned arrays, which wrap like the definition (32 bits are enough up to k = 16)."""
    u = x.dtype.type
    m = u((1 << 2 * k) - 1)
    left = lambda x, s: x << u(s) if s < x.dtype.itemsize * 8 else u(0)
    x = (~x + left(x, 21)) & m
    x = x ^ (x >> u(24))
    x = (x + left(x, 3) + left(x, 8)) & m
    x = x ^ (x >> u(14))
    x = (x + left(x, 2) + left(x, 4)) & m
    x = x ^ (x >> u(28))
    return (x + left(x, 31)) & m


def codes(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """2-bit numbers of all k-mers and of their reverse complements, put together from pieces of 1, 2, 4, ... bases."""
    u, n = code.dtype.type, len(code)
    fwd_piece, rev_piece, size = code, u(3) - code, 1
    fwd = rev = None
    done = 0
    while True:
        if k & size:
            m = n - done - size + 1
            if fwd is None:
                fwd, rev = fwd_piece, rev_piece
            else:
                fwd = (fwd[:m] << u(2 * size)) | fwd_piece[done : done + m]
                rev = rev[:m] | (rev_piece[done : done + m] << u(2 * done))
            done += size
        if 2 * size > k:
            return fwd, rev
        m = n - 2 * size + 1
        fwd_piece = (fwd_piece[:m] << u(2 * size)) | fwd_piece[size : size + m]
        rev_piece = rev_piece[:m] | (rev_piece[size : size + m] << u(2 * size))
        size *= 2


def rightmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of every ``w`` consecutive values, rightmost on ties."""
    at, least, span = np.arange(len(h), dtype=np.int32 if len(h) < 1 << 31 else np.int64), h, 1
    while span < w:
        shift = min(span, w - span)
        take = least[shift:] <= least[:-shift]
        at = np.where(take, at[shift:], at[:-shift])
        least = np.where(take, least[shift:], least[:-shift])
        span += shift
    return at


def extract(data: np.ndarray, off: np.ndarray, k: int, w: int, lead: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Minimizers of the sequences data[off[i]:off[i+1]]: sequence, hash, position of the last base, strand.

    With ``lead`` and ``own`` a sequence is a chunk: only windows that start in the ``own`` places
    after the first ``lead`` ones count, and a k-mer that the window before them chose isn't theirs.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    need = k + w - 1
    if n < need:
        return none, none, none, none
    code = _CODE[data]
    fwd, rev = codes((code & 3).astype(np.uint32 if k <= 16 else np.uint64), k)
    h = mix_seed(np.minimum(fwd, rev), k)
    # a window is whole if its k + w - 1 bases are bases of one sequence
    stop = np.append(0, np.cumsum(code > 3, dtype=np.int32))
    whole = stop[need:] == stop[:-need]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    inside = np.bincount(np.maximum(edge - need + 1, 0), minlength=n + 1)[: n + 1] - np.bincount(edge, minlength=n + 1)[: n + 1]
    window = np.flatnonzero(whole & (np.cumsum(inside[: n - need + 1]) == 0))
    if not len(window):
        return none, none, none, none
    best = rightmost_least(h, w)[window]
    first = np.append(True, best[1:] != best[:-1])  # positions never go back
    window, best = window[first], best[first].astype(np.int64)
    seq = np.searchsorted(off, best, "right") - 1
    if lead is not None:
        at = window - off[seq]
        mine = (at >= lead[seq]) & (at < lead[seq] + own[seq])
        best, seq = best[mine], seq[mine]
    return seq, h[best].astype(np.int64), best + k - 1 - off[seq], (rev[best] < fwd[best]).astype(np.int64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8), off


def chunked(lengths: np.ndarray, size: int, halo: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Sequences as rows of slices of at most ``size`` bases with a base before and ``halo`` after: (sequence, start of its own bases, lead, own). Slices of about ``size`` bases come together."""
    each = -(-np.maximum(lengths, 1) // size)
    seq = np.repeat(np.arange(len(lengths)), each)
    start = (np.arange(len(seq)) - np.repeat(np.cumsum(each) - each, each)) * size
    own = np.minimum(size, lengths[seq] - start)
    groups = np.cumsum(own) // size
    for at in np.split(np.arange(len(seq)), np.flatnonzero(np.diff(groups)) + 1):
        yield seq[at], start[at], np.minimum(start[at], 1), own[at]


def slices(column: pa.Array, p: Params) -> Iterator[tuple[np.ndarray, ...]]:
    """Minimizers of a column of sequences, by slices: row, hash, position, strand; rows and positions never go back."""
    if not len(column):
        return
    data, off = buffers(column)
    for row, start, lead, own in chunked(np.diff(off), SLICE, p.k + p.w - 2):
        lo, hi = off[row] + start - lead, np.minimum(off[row] + start + own + p.k + p.w - 2, off[row + 1])
        whole = len(row) == 1 or (lo[1:] == hi[:-1]).all()
        part = data[lo[0] : hi[-1]] if whole else np.concatenate([data[a:b] for a, b in zip(lo, hi)])
        seq, h, pos, strand = extract(part, np.append(0, np.cumsum(hi - lo)), p.k, p.w, lead, own)
        yield row[seq], h, pos + (start - lead)[seq], strand


def minimizers(seqs: DataFrame, params: Params | None = None, id_col: str = "seq_id", seq_col: str = "seq", piece: int | None = None) -> DataFrame:
    """(id, hash, pos, strand) of every sequence; null or short sequences give no rows.

    A sequence is worked on in its own task, in slices of half a million bases. With ``piece``
    sequences are cut into chunks of so many bases first, and dealt over all tasks.
    """
    p = check(params)
    if piece is not None:
        return chunk_minimizers(cut(seqs, id_col, seq_col, piece, p.k + p.w - 2).repartition(id_col, "chunk"), p, id_col)
    kind = seqs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h, pos, strand in slices(batch.column(1), p):
                yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(h), pa.array(pos), pa.array(strand.astype(np.int32))], [id_col, "hash", "pos", "strand"])

    return seqs.select(id_col, seq_col).mapInArrow(run, f"`{id_col}` {kind}, hash long, pos long, strand int")


def chunk_minimizers(chunks: DataFrame, params: Params | None = None, id_col: str = "contig_id") -> DataFrame:
    """``minimizers`` of a chunk table (see ``chunks``), whose halo is k + w - 2 at least: each k-mer comes from the chunk in which the first window that chooses it starts."""
    p = check(params)
    kind = chunks.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, lead, own = (batch.column(c).to_numpy().astype(np.int64) for c in (1, 2, 3))
            data, off = buffers(batch.column(4))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, "right")) - 1)
                seq, h, pos, strand = extract(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], p.k, p.w, lead[lo:hi], own[lo:hi])
                yield pa.record_batch([batch.column(0).take(pa.array(seq + lo)), pa.array(h), pa.array(pos + (start - lead)[lo:hi][seq]), pa.array(strand.astype(np.int32))], [id_col, "hash", "pos", "strand"])
                lo = hi

    return chunks.select(id_col, "start", "lead", "own", "text").mapInArrow(run, f"`{id_col}` {kind}, hash long, pos long, strand int")


#: Bases whose 2-bit numbers fill a long; a word holds WORD - k + 1 k-mers.
WORD = 31


def digits(seq: Column) -> Column:
    """A sequence as digits, 0 to 3 for bases and 4 for breaks: single bytes, so that places are found at once."""
    return F.regexp_replace(F.translate(seq, "ACGTacgtN01234", "01230123444444"), "[^0-4]", "4")


def word(text: Column) -> tuple[Column, Column, Column]:
    """WORD digits as three longs: bases, bases of the reverse complement (a break counts as A there and as T here), a bit for each break."""
    bases = F.replace(text, F.lit("4"), F.lit("0"))
    number = lambda x, base: F.coalesce(F.conv(x, base, 10).cast("long"), F.lit(0).cast("long"))
    marks = text
    for x, y in ("10", "20", "30", "41"):
        marks = F.replace(marks, F.lit(x), F.lit(y))
    return number(bases, 4), F.lit((1 << 2 * WORD) - 1) - number(F.reverse(bases), 4), F.when(text.contains("4"), number(marks, 2)).otherwise(F.lit(0).cast("long"))


def _low(x: Column, y: Column, breaks: Column, i: Column, k: int) -> tuple[Column, Column, Column]:
    """k-mer ``i`` of a word: its own number, that of its reverse complement, whether it is whole."""
    right = lambda v, n: F.call_function("shiftright", v, n.cast("int")).bitwiseAND(F.lit((1 << 2 * k) - 1))
    whole = F.call_function("shiftright", breaks, (F.lit(WORD - k) - i).cast("int")).bitwiseAND(F.lit((1 << k) - 1)) == 0
    return right(x, (F.lit(WORD - k) - i) * 2), right(y, i * 2), whole


def kmer_sums(seqs: DataFrame, params: Params | None = None, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """(id, n_kmers, hash_sum, hash_max, n_reverse) over the rows of ``kmers``, in numpy: a slice of a sequence gives one row of sums, which Spark adds up; sequences without a k-mer have no row."""
    p = check(params)
    kind = seqs.schema[id_col].dataType.simpleString()
    names = [id_col, "n", "s", "m", "r"]
    size = min(SLICE, 1 << (62 - 2 * p.k))  # sums of a slice fit a long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = buffers(batch.column(1))
            for row, start, _, own in chunked(np.diff(off), size, p.k - 1):
                lo, hi = off[row] + start, np.minimum(off[row] + start + own + p.k - 1, off[row + 1])
                code = _CODE[np.concatenate([data[a:b] for a, b in zip(lo, hi)])]
                if len(code) < p.k:
                    continue
                fwd, rev = codes((code & 3).astype(np.uint32 if p.k <= 16 else np.uint64), p.k)
                h = mix_seed(np.minimum(fwd, rev), p.k).astype(np.int64)
                stop = np.append(0, np.cumsum(code > 3, dtype=np.int32))
                whole = stop[p.k :] == stop[: -p.k]
                seq = np.repeat(np.arange(len(row)), hi - lo)
                at = np.flatnonzero(whole & (seq[p.k - 1 :] == seq[: len(seq) - p.k + 1]))
                if not len(at):
                    continue
                first = np.flatnonzero(np.append(True, np.diff(seq[at]) > 0))
                n = np.diff(np.append(first, len(at)))
                cols = [n, np.add.reduceat(h[at], first), np.maximum.reduceat(h[at], first), np.add.reduceat((rev[at] < fwd[at]).astype(np.int64), first)]
                yield pa.record_batch([batch.column(0).take(pa.array(row[seq[at][first]])), *[pa.array(c.astype(np.int64)) for c in cols]], names)

    parts = seqs.select(id_col, seq_col).mapInArrow(run, f"`{id_col}` {kind}, n long, s long, m long, r long")
    return parts.groupBy(id_col).agg(F.sum("n").alias("n_kmers"), F.sum("s").alias("hash_sum"), F.max("m").alias("hash_max"), F.sum("r").alias("n_reverse"))


def kmers(seqs: DataFrame, params: Params | None = None, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """Every k-mer without a break: (id, pos of the last base, hash, strand).

    A sequence is taken apart into words of 31 bases, a word by shifts into its k-mers: rows of a few
    numbers, without a shuffle.
    """
    p = check(params)
    step = WORD - p.k + 1
    n = F.length("_t")
    words = seqs.select(id_col, digits(F.col(seq_col)).alias("_t")).where(n >= p.k).select(id_col, "_t", F.explode(F.sequence(F.lit(0), n - p.k, F.lit(step))).alias("_at"))
    words = words.select(id_col, "_at", F.rpad(slice_of(F.col("_t"), F.col("_at"), F.lit(WORD)), WORD, "4").alias("_s"))
    x, y, breaks = word(F.col("_s"))
    rows = words.select(id_col, "_at", x.alias("_x"), y.alias("_y"), breaks.alias("_b"))
    rows = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(step)])).alias("_i"))
    own, other, whole = _low(F.col("_x"), F.col("_y"), F.col("_b"), F.col("_i"), p.k)
    rows = rows.where(whole).select(id_col, (F.col("_at") + F.col("_i") + p.k - 1).cast("long").alias("pos"), own.alias("_own"), other.alias("_other"))
    rows = rows.select(id_col, "pos", F.least("_own", "_other").alias("_code"), (F.col("_other") < F.col("_own")).cast("int").alias("strand"))
    return with_seed_hash(rows, "_code", p.k).select(id_col, "pos", "hash", "strand")


def minimizers_sql(seqs: DataFrame, params: Params | None = None, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """``minimizers`` without Python: pieces of ``PIECE`` windows, each with the window before it, as arrays of numbers.

    Each k-mer is a number that orders by hash and then by place, rightmost first, so the least of
    a window is its minimizer; least ones of 2, 4, ... places make those of ``w``. What the window
    before a piece chose is the piece's before. A row is a piece, so memory depends on neither the
    sequence nor the table, and nothing is shuffled or sorted.
    """
    p = check(params)
    k, w, step = p.k, p.w, WORD - p.k + 1
    long = lambda v: F.lit(v).cast("long")
    n = F.length("_t") - (k + w - 2)  # windows
    at, lead = F.col("_at"), F.least(F.col("_at"), F.lit(1))
    rows = seqs.select(id_col, digits(F.col(seq_col)).alias("_t")).where(n > 0).select(id_col, "_t", F.explode(F.sequence(F.lit(0), n - 1, F.lit(PIECE))).alias("_at"))
    rows = rows.select(id_col, (at - lead).alias("_from"), lead.alias("_lead"), slice_of(F.col("_t"), at - lead, lead + F.lit(PIECE + k + w - 2)).alias("_s"))
    rows = rows.select(id_col, "_from", "_lead", (F.length("_s") - (k - 1)).alias("_n"), F.ceil((F.length("_s") - (k - 1)) / step).cast("int").alias("_m"), "_s")
    rows = rows.withColumn("_s", F.rpad("_s", F.col("_m") * step + k - 1, F.lit("4")))
    parts = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda j: F.substring("_s", j * step + 1, F.lit(WORD)))

    def numbers(t: Column) -> Column:
        x, y, breaks = word(t)
        return F.struct((x * 2).alias("x"), (y * 2).alias("y"), breaks.alias("b"))

    def code(e: Column, at: Column) -> Column:
        """Twice the lesser number of the k-mer's two, and its strand; -1 if the k-mer has a break."""
        right = lambda c, n: F.call_function("shiftright", e[c], at[n])
        own, other = (right(c, c).bitwiseAND(long(2 * p.mask)) for c in "xy")
        return F.when(right("b", "b").bitwiseAND(long((1 << k) - 1)) == 0, F.least(own, other + 1)).otherwise(long(-1))

    each = F.array(*[F.struct(F.lit(2 * (WORD - k - i)).alias("x"), F.lit(2 * i).alias("y"), F.lit(WORD - k - i).alias("b")) for i in range(step)])
    rows = rows.select(id_col, "_from", "_lead", "_n", F.transform(parts, numbers).alias("_w"))
    rows = rows.select(id_col, "_from", "_lead", "_n", F.slice(F.flatten(F.transform("_w", lambda e: F.transform(each, lambda i: code(e, i)))), F.lit(1), F.col("_n")).alias("_c"))
    first, *rest = hash_steps(k)
    rows = rows.withColumn("_h", F.transform("_c", lambda c: first(F.shiftright(c, 1))))
    for f in rest:
        rows = rows.withColumn("_h", F.transform("_h", f))
    bits = (PIECE + 1 + w).bit_length()  # of a place in a piece
    top = (1 << bits) - 1
    if 2 * k + 1 + bits <= 63:
        made = lambda c, h: F.when(c < 0, none).otherwise(F.shiftleft(h, bits + 1) + c.bitwiseAND(long(1)))
        put = lambda v, i: F.when(v < 0, v).otherwise(v + (F.lit(2 * top) - i * 2))
        none = long(-1)
        hash_, place, strand = (lambda v: F.shiftright(v, bits + 1)), (lambda v: F.lit(top) - F.shiftright(v, 1).bitwiseAND(long(top))), (lambda v: v.bitwiseAND(long(1)))
    else:
        made = lambda c, h: F.when(c < 0, none).otherwise(F.struct(h.alias("h"), long(0).alias("i"), c.bitwiseAND(long(1)).alias("s")))
        put = lambda v, i: F.when(v["h"] < 0, v).otherwise(F.struct(v["h"].alias("h"), (-i).cast("long").alias("i"), v["s"].alias("s")))
        none = F.struct(long(-1).alias("h"), long(0).alias("i"), long(0).alias("s"))
        hash_, place, strand = (lambda v: v["h"]), (lambda v: -v["i"]), (lambda v: v["s"])
    rows = rows.select(id_col, "_from", "_lead", "_n", F.transform(F.zip_with("_c", "_h", made), put).alias("_v"))
    span = 1
    while span < w:
        shift = min(span, w - span)
        rows = rows.withColumn("_v", F.zip_with("_v", F.slice("_v", F.lit(1 + shift), F.col("_n")), lambda a, b: F.least(a, b)))  # places beyond the last window are cut below
        span += shift
    every = F.col("_n") - (w - 1)
    chosen = F.array_except(F.slice("_v", F.col("_lead") + 1, every - F.col("_lead")), F.concat(F.slice("_v", F.lit(1), F.col("_lead")), F.array(none)))
    found = rows.select(id_col, "_from", F.explode(chosen).alias("_v"))
    v = F.col("_v")
    return found.select(id_col, hash_(v).alias("hash"), (F.col("_from") + place(v) + (k - 1)).cast("long").alias("pos"), strand(v).cast("int").alias("strand"))

"""Benchmark decontamination by latent semantic retrieval.

1. Documents become rows of benchmark-vocabulary numbers, once; every later pass reads those.
2. Tiles of ``TILE`` words (and the benchmark's own pieces) are the rows of a TF-IDF matrix A; idf
   counts all tiles of the corpus. A randomised SVD of A runs as distributed sums: a random sketch
   Y = A'A G, its orthonormal basis Q, a power step Z = A'A Q whose projection Q'Z gives the
   singular values and right singular vectors (Nystrom form). Tasks send (vocabulary x rank)
   sums, never rows of A.
3. A word's latent vector is its idf times its right singular vector over the root of the
   singular value (half of the usual fold-in: dividing by the whole value drowns small corpora in
   noise). Windows as long as a piece of an item (to the next of ``WINDOWS``), a
   quarter to a half of that apart, are summed from them and compared with every piece in batched matrix
   products; latent cosines of ``COSINE`` or more are candidates. No other filter stands before.
4. A candidate counts if, within the piece's length on both sides of the window, ``ANSWER`` of
   the item's key terms (its rarest words, where an answer would be) are found and the longest
   common subsequence holds ``LCS`` of the item's words.

The benchmark is taken in blocks of ``BLOCK_WORDS`` words, which bounds the model that tasks and
the driver hold (vocabulary x rank); the corpus is read whole for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm._arrow import Texts, frugal, owners, prefix_hash, sliced, spans, table
from strandweave.llm._shared import documents, keep

TILE = 64
RANK, OVERSAMPLE = 128, 8
COSINE = 0.4
#: Window length in words -> step between windows; no piece of an item is longer than the last.
WINDOWS = {8: 4, 12: 4, 16: 8, 24: 8, 32: 8, 48: 16, 64: 16}
BLOCK_WORDS = 1 << 16
LCS, ANSWER, KEYS = 0.6, 0.5, 0.4
#: An item of fewer words is a turn of speech, not a passage: it is found nowhere, or else it would have common prose deleted.
LEAST_WORDS = 4
#: Words that a matrix step holds at once, and rows of the vocabulary in one message.
HELD, ROWS = 1 << 14, 64
#: A long text is searched in stretches of so many words, which overlap by the longest window.
STRETCH = 1 << 13
_T = table(3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lowered words (letters and digits) and the first word of each text."""
    start, end, first = t.runs(_WORD)
    return spans(prefix_hash(_T[_LOWER[t.data]]), start, end), first


def look_up(keys: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Index of each key in the ascending vocabulary, -1 for other words."""
    if not len(vocabulary):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    return np.where(vocabulary[at] == keys, at, -1)


class Benchmark:
    """A block of items of ``LEAST_WORDS`` words or more as pieces of at most 64 words: vocabulary, pieces as vocabulary numbers, key terms."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        words, first = tokens(Texts(pa.array(texts, pa.string())))
        self.vocabulary = np.unique(words)
        v = np.searchsorted(self.vocabulary, words)
        self.ids, self.pieces = [], []
        for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            if b - a < LEAST_WORDS:
                continue
            for x in np.array_split(v[a:b], max(1, -(-(b - a) // max(WINDOWS)))):
                if len(x):
                    self.ids.append(ids[k])
                    self.pieces.append(x)
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        lengths = np.array(list(WINDOWS))
        self.window = lengths[np.abs(np.log(lengths[None, :] / np.maximum(self.sizes, 1)[:, None])).argmin(1)] if self.pieces else self.sizes

    def weigh(self, found: np.ndarray, tiles: int) -> None:
        """idf from the tiles that hold each word, and from it the key terms of each piece."""
        self.idf = np.log((tiles + 1.0) / (found + 1.0)) + 0.1
        keys = [np.unique(p[np.argsort(-self.idf[p], kind="stable")][: max(1, int(np.ceil(KEYS * len(p))))]) for p in self.pieces]
        self.n_keys = np.array([len(k) for k in keys], np.int64)
        self.keys, self.first_key = np.concatenate(keys), np.cumsum(self.n_keys) - self.n_keys
        # the pieces that have each word as a key term
        order = np.argsort(self.keys, kind="stable")
        self.holders = np.repeat(np.arange(len(keys)), self.n_keys)[order]
        self.posting = np.searchsorted(self.keys[order], np.arange(len(self.vocabulary) + 1))

    def rotate(self, vectors: np.ndarray) -> None:
        """Take the latent vector of each word; unit vectors of the pieces, by window length."""
        self.vectors = np.ascontiguousarray(np.vstack([vectors, np.zeros((1, vectors.shape[1]))]), np.float32)  # by rows, or else each take of some copies all
        self.latent = {}
        for length in WINDOWS:
            mine = np.flatnonzero(self.window == length)
            if len(mine):
                x = np.stack([self.vectors[self.pieces[p]].sum(0) for p in mine])
                self.latent[length] = mine, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The pieces as word occurrences: vocabulary number and piece of each."""
        return np.concatenate(self.pieces), np.repeat(np.arange(len(self.pieces)), self.sizes)


def numbered(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, v): the words of each whole text as 32-bit vocabulary numbers, -1 for other words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                words, first = tokens(Texts(part.column(1)))
                v = look_up(words, bench.vocabulary).astype("<i4")
                out = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(v)])
                yield pa.record_batch([part.column(0), out], ["doc_id", "v"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, v binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary numbers of some rows of ``numbered``, and the first word of each row."""
    t = Texts(column)
    return np.frombuffer(t.data.tobytes(), "<i4"), t.off // 4


def _tiles(first: np.ndarray) -> tuple[np.ndarray, int]:
    """The tile of each word, tiles side by side, and how many there are."""
    size = np.diff(first)
    per = -(-size // TILE)
    at = np.arange(first[-1]) - np.repeat(first[:-1], size)
    return at // TILE + np.repeat(np.cumsum(per) - per, size), int(per.sum())


def count_words(rows: DataFrame, bench: Benchmark) -> tuple[np.ndarray, int]:
    """In how many tiles of the corpus each benchmark word is, and how many tiles there are."""
    width = len(bench.vocabulary) + 1

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for part in sliced(batch, "v"):
                v, first = _numbers(part.column(0))
                tile, n = _tiles(first)
                known = v >= 0
                pairs = np.sort(tile[known] * np.int64(width) + v[known])
                total += np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] % width if len(pairs) else pairs, minlength=width)
                total[-1] += n
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["v", "n"])

    out = np.zeros(width, np.int64)
    for r in rows.select("v").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect():  # one row per word of the block
        out[r["v"]] = r["n"]
    return out[:-1], int(out[-1])


def run_sums(rows: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of rows[at] over consecutive runs of the given sizes (0 allowed), four rows at a time. The last row must be zero."""
    while True:
        per = -(-sizes // 4)
        slots = np.full(int(per.sum()) * 4, len(rows) - 1)
        slots[np.repeat((np.cumsum(per) - per) * 4 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(at))] = at
        slots = slots.reshape(-1, 4)
        out, held = np.empty((len(slots) + 1, rows.shape[1]), rows.dtype), np.empty((len(slots), rows.shape[1]), rows.dtype)
        rows.take(slots[:, 0], 0, out=out[:-1], mode="clip")  # no place is out of range; other modes copy once more
        for k in range(1, 4):
            out[:-1] += rows.take(slots[:, k], 0, out=held, mode="clip")
        out[-1] = 0
        if not len(per) or per.max() <= 1:
            if (per == 1).all():
                return out[:-1]
            full = np.zeros((len(sizes), rows.shape[1]), rows.dtype)
            full[per == 1] = out[:-1]
            return full
        rows, at, sizes = out, np.arange(len(slots)), per


def gram_share(v: np.ndarray, tile: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
    """Add to ``out`` the rows A'(A M) of word occurrences (number, ascending tile) but for the last idf; ``weight`` is idf x M and a blank row."""
    new = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(v) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(v)))
    cuts = np.unique(np.append(np.searchsorted(new, np.arange(0, len(v), HELD)), len(new)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w = v[new[a] : new[a] + int(size[a:b].sum())]
        y = np.vstack([run_sums(weight, w, size[a:b]), np.zeros((1, weight.shape[1]), weight.dtype)])
        order = np.argsort(w, kind="stable")
        heads = np.flatnonzero(np.append(True, w[order][1:] != w[order][:-1]))
        out[w[order][heads]] += run_sums(y, np.repeat(np.arange(b - a), size[a:b])[order], np.diff(np.append(heads, len(w))))


def gram(rows: DataFrame, bench: Benchmark, m: np.ndarray) -> np.ndarray:
    """A'A M over all tiles of the corpus and the benchmark's pieces, for M (vocabulary x columns).

    A task sends its sum in messages of ``ROWS`` words, which are added up as they stream in: no
    task and no driver holds more than vocabulary x columns numbers.
    """
    size, width = m.shape
    weight = np.ascontiguousarray(np.vstack([bench.idf[:, None] * m, np.zeros((1, width))]), np.float32)

    @frugal
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, width))
        for batch in batches:
            for part in sliced(batch, "v"):
                v, first = _numbers(part.column(0))
                tile, _ = _tiles(first)
                known = np.flatnonzero(v >= 0)
                gram_share(v[known], tile[known], weight, out)
        some = [k for k in range(0, size, ROWS) if out[k : k + ROWS].any()]
        yield pa.record_batch([pa.array(np.array(some, np.int64) // ROWS), pa.array([out[k : k + ROWS].tobytes() for k in some], pa.binary())], ["k", "x"])

    @frugal
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[k] = np.frombuffer(x.as_buffer(), float) + held.get(k, 0.0)
        yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["k", "x"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.select("v").mapInArrow(share, "k long, x binary").repartition(parts, "k").mapInArrow(add, "k long, x binary")
    out = np.zeros((size, width))
    for r in sums.collect():  # vocabulary / ROWS rows
        out[r["k"] * ROWS : (r["k"] + 1) * ROWS] = np.frombuffer(r["x"], float).reshape(-1, width)
    gram_share(*bench.rows(), weight, out)
    return bench.idf[:, None] * out


def randomised_svd(rows: DataFrame, bench: Benchmark, rank: int = RANK, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (vocabulary x rank) of the TF-IDF matrix; fewer where the matrix has less rank."""
    size = len(bench.vocabulary)
    width = min(size, rank + OVERSAMPLE)
    g = np.random.default_rng(seed).choice([-1.0, 1.0], (size, width))
    q, _ = np.linalg.qr(gram(rows, bench, g))
    z = gram(rows, bench, q)
    projected = q.T @ z
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    good = values > values.max() * 1e-10
    u, s, _ = np.linalg.svd(z @ (turn[:, good] / np.sqrt(values[good])), full_matrices=False)
    good = np.flatnonzero(s > s[0] * 1e-3)[:rank]
    return s[good], u[:, good]


def retrieve(bench: Benchmark, v: np.ndarray, first: np.ndarray, least: float = COSINE) -> tuple[np.ndarray, ...]:
    """Candidates of some texts: text, first word of the window, piece, latent cosine."""
    found = []
    for lo, hi, owner in stretches(first):
        # words fall into blocks of four; a text fills whole groups of four blocks and is followed by blank ones, so that windows may run over its end
        size = hi - lo
        per = -(-size // 16) * 4 + 12
        base = np.cumsum(per) - per
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        home = np.repeat(np.arange(len(size)), size)
        at, home = at[v[at] >= 0], home[v[at] >= 0]
        block = base[home] + (at - lo[home]) // 4
        held = np.bincount(block, minlength=int(per.sum()))
        edge = np.append(0, np.cumsum(held))
        four = np.concatenate([run_sums(bench.vectors, v[at[edge[k] : edge[min(k + 1024, len(held))]]], held[k : k + 1024]) for k in range(0, len(held), 1024)])
        sums, one = {}, four
        for step in (4, 8, 16):  # sums of two, three and four steps in a row
            two = one[:-1] + one[1:]
            sums |= {(step, 2): two, (step, 3): (two, one), (step, 4): (two, two)}
            one = two[0::2]
        for length, (pieces, latent) in bench.latent.items():
            step = WINDOWS[length]
            e = sums[step, length // step]
            if isinstance(e, tuple):
                n = len(e[1]) - 2
                e = e[0][:n] + e[1][2 : n + 2]
            which = np.repeat(np.arange(len(size)), per * 4 // step)[: len(e)]
            begin = (np.arange(len(e)) - base[which] * 4 // step) * step
            norm = np.sqrt(np.einsum("ij,ij->i", e, e))
            norm[(begin >= size[which]) | (norm < 1e-9)] = np.inf
            each = max(1, min(HELD // 8, (HELD << 8) // len(pieces)))
            for k in range(0, len(e), each):
                product = e[k : k + each] @ latent.T
                hit = np.flatnonzero(product >= least * norm[k : k + each, None])
                i, p = k + hit // len(pieces), hit % len(pieces)
                found.append((owner[which[i]], lo[which[i]] + begin[i], pieces[p], product.ravel()[hit] / norm[i]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)


def stretches(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about ``STRETCH`` words: start and end word and text of each stretch. Long texts are cut."""
    lo, hi, owner = [], [], []
    for d in np.flatnonzero(np.diff(first)).tolist():
        for a in range(int(first[d]), int(first[d + 1]), STRETCH):
            lo.append(a)
            hi.append(min(int(first[d + 1]), a + STRETCH + max(WINDOWS)))
            owner.append(d)
            if hi[-1] - lo[0] > STRETCH:
                yield np.array(lo), np.array(hi), np.array(owner)
                lo, hi, owner = [], [], []
    if lo:
        yield np.array(lo), np.array(hi), np.array(owner)


def answerable(bench: Benchmark, v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ascending text x pieces + piece of every text that holds ``ANSWER`` of a piece's key terms anywhere: no other can pass the answer check."""
    at = np.flatnonzero(v >= 0)
    many = bench.posting[v[at] + 1] - bench.posting[v[at]]
    at, many = at[many > 0], many[many > 0]
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(bench.posting[v[at]], many)
    text = np.repeat(np.searchsorted(first, at, "right") - 1, many)
    seen = np.unique(text * len(bench.holders) + entry)  # a repeated word counts once
    pairs, found = np.unique(seen // len(bench.holders) * len(bench.pieces) + bench.holders[seen % len(bench.holders)], return_counts=True)
    return pairs[found >= ANSWER * bench.n_keys[pairs % len(bench.pieces)] - 1e-9]


def answers(bench: Benchmark, v: np.ndarray, piece: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Share of each piece's key terms that the words lo..hi hold."""
    known = np.flatnonzero(v >= 0)
    places = np.sort(v[known].astype(np.int64) * (len(v) + 1) + known)
    out = np.zeros(len(piece))
    for k in range(0, len(piece), 1 << 15):
        p, a, b = piece[k : k + (1 << 15)], lo[k : k + (1 << 15)], hi[k : k + (1 << 15)]
        n = bench.n_keys[p]
        row = np.repeat(np.arange(len(p)), n)
        key = bench.keys[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + bench.first_key[p][row]] * (len(v) + 1)
        at = np.searchsorted(places, key + a[row])
        there = (at < len(places)) & (places[np.minimum(at, len(places) - 1)] < key + b[row]) if len(places) else np.zeros(len(row), bool)
        out[k : k + (1 << 15)] = np.bincount(row, there, len(p)) / n
    return out


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    n = len(item)
    masks: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    state = every = (1 << n) - 1
    for x in words.tolist():
        m = masks.get(x)
        if m is not None:
            u = state & m
            state = ((state + u) | (state - u)) & every
    return n - state.bit_count()


def accepted(bench: Benchmark, v: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(text, piece, cosine, lcs, answer) of every pair with an accepted window, the best window of each."""
    d, begin, piece, cosine = retrieve(bench, v, first)
    there = look_up(d * len(bench.pieces) + piece, answerable(bench, v, first)) >= 0
    d, begin, piece, cosine = d[there], begin[there], piece[there], cosine[there]
    lo = np.maximum(first[:-1][d], begin - bench.sizes[piece])
    hi = np.minimum(first[1:][d], begin + bench.window[piece] + bench.sizes[piece])
    answer = answers(bench, v, piece, lo, hi)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for c in np.flatnonzero(answer >= ANSWER).tolist():
        p = int(piece[c])
        near = v[lo[c] : hi[c]]
        share = common_subsequence(bench.pieces[p], near[near >= 0]) / int(bench.sizes[p])
        if share >= LCS - 1e-9:
            key = int(d[c]), p
            best[key] = max(best.get(key, (0.0,)), (share, float(answer[c]), round(float(cosine[c]), 3)))
    return [(*key, x[2], x[0], x[1]) for key, x in sorted(best.items())]


def models(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Benchmark, DataFrame]]:
    """A fitted model for each block of the benchmark, and the corpus in its numbers."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    parts = max(1, -(-int(total) // BLOCK_WORDS))
    for k in range(parts):
        rows = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # about BLOCK_WORDS words
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))
        bench = Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows])
        if not bench.pieces:
            continue
        numbers = keep(numbered(docs, bench))
        bench.weigh(*count_words(numbers, bench))
        s, u = randomised_svd(numbers, bench)
        bench.rotate(bench.idf[:, None] * u / np.sqrt(s))
        yield bench, numbers


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` against ``benchmark(item_id, text)``: (doc_id, item_id, cosine, lcs, answer), a row per contaminated pair.

    Items longer than 64 words are looked for piece by piece; the best piece counts. Items of fewer
    than ``LEAST_WORDS`` words are found nowhere. Null and empty texts on either side match nothing; rows with one doc_id (null is an id like others)
    give one row per item; equal items under several ids are found under each. Very long texts
    are searched in overlapping stretches. Other columns are ignored; empty tables give an empty
    result.
    """
    spark = docs.sparkSession
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    out = spark.createDataFrame([], f"{kinds}, cosine double, lcs double, answer double")
    for bench, numbers in models(docs.select("doc_id", "text"), benchmark):
        model = spark.sparkContext.broadcast(bench)  # bounded by BLOCK_WORDS x RANK numbers

        @frugal
        def search(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in sliced(batch, "v"):
                    found = accepted(model.value, *_numbers(part.column(1)))
                    ids = part.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                    yield pa.record_batch([ids, pa.array([x[1] for x in found], pa.int64()), *[pa.array([x[k] for x in found], pa.float64()) for k in (2, 3, 4)]], ["doc_id", "piece", "cosine", "lcs", "answer"])

        hits = keep(numbers.mapInArrow(search, f"{kinds.split(', ')[0]}, piece long, cosine double, lcs double, answer double"))
        names = spark.createDataFrame([(p, i) for p, i in enumerate(bench.ids)], f"piece long, {kinds.split(', ')[1]}")
        out = out.unionByName(hits.join(F.broadcast(names), "piece").drop("piece"))  # the block's pieces
    best = F.max(F.struct("lcs", "answer", "cosine")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.lcs", "b.answer")


def op3_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair in which the document holds the item or a paraphrase of it; awkward rows as in ``contaminated``."""
    return contaminated(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows whose text holds no benchmark item, with the columns of ``docs``.

    Each row is judged by its own text, so rows that share a doc_id (or have none) go or stay
    one by one; null and empty texts stay. Nothing is shuffled or joined.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")
    out = docs
    for bench, _ in models(docs.select(F.lit(0).alias("doc_id"), "text"), benchmark):
        model = spark.sparkContext.broadcast(bench)

        @frugal
        def clean(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in sliced(batch, batch.schema.field(at).name):
                    words, first = tokens(Texts(part.column(at)))
                    stays = np.ones(part.num_rows, bool)
                    stays[[x[0] for x in accepted(model.value, look_up(words, model.value.vocabulary), first)]] = False
                    yield part.filter(pa.array(stays))

        out = out.mapInArrow(clean, docs.schema)
    return out

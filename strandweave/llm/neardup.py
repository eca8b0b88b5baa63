"""Near-duplicates by ProbMinHash, banding and exact verification.

A document is a set of word shingles weighted by how often it has them. Each shingle runs a
Poisson process whose rate is its weight; every arrival is thrown into one of ``REGISTERS``
registers, which keep their first arrival. A document stops early: an element is done once its
next arrival is later than the latest register. The chance that two documents agree in a
register is their probability Jaccard similarity.

Bands of registers put likely pairs into buckets. Equal texts are one node from the start, and
buckets with the same members count once. In a bucket, nodes whose shingles are mostly found in
no other member can't be similar to any of them and go; what remains is compared exactly, and
only links that join two parts are kept (a spanning forest), so a bucket of n members gives
n - 1 links at most and no list of pairs. Buckets above ``BLOCK`` members or ``BLOCK_BYTES`` bytes
are compared block by block in different tasks.

A node is (first_id, k1, k2): the least doc_id that has a text, and the text's hashes. The least
node of a class names it, so no class is ever gathered or joined by its label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm._arrow import Texts, U, frugal, mix, prefix_hash, shingles, sliced, spans, table
from strandweave.llm._components import components
from strandweave.llm._shared import documents, keep

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
BLOCK, BLOCK_BYTES = 1024, 16 << 20
_T = table(1)


def weighted(t: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text: hash, weight (occurrences) and bounds by text; hashes ascend within a text."""
    start, end, first = t.words()
    h, owner = shingles(spans(prefix_hash(_T[t.data]), start, end), first, size)
    by = np.argsort(h)
    order = by[np.argsort(owner[by].astype(np.uint16 if len(t) < 65536 else np.int64), kind="stable")]
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[new], np.diff(np.append(new, len(h))).astype(float), np.searchsorted(owner[new], np.arange(len(t) + 1))


def prob_minhash(h: np.ndarray, w: np.ndarray, bounds: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The element in each register of each set (uint64, sets x registers); rows of empty sets are zero."""
    n = len(bounds) - 1
    time, held = np.full(n * registers, np.inf), np.zeros(n * registers, U)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    element, weight, at = h, w, np.zeros(len(h))
    done, block = 0, 1
    while len(element):
        k = np.arange(done + 1, done + block + 1, dtype=U)
        r = mix(element[:, None] + k * U(0x9E3779B97F4A7C15))
        u = ((r >> U(11)).astype(float) + 0.5) * 2.0**-53
        arrival = at[:, None] + np.cumsum(-np.log(u), axis=1) / weight[:, None]
        slot = (owner[:, None] * registers + (mix(r) % U(registers)).astype(np.int64)).ravel()
        flat = arrival.ravel()
        np.minimum.at(time, slot, flat)
        won = time[slot] == flat
        held[slot[won]] = np.repeat(element, block)[won]
        latest = time.reshape(n, registers).max(1)
        go = arrival[:, -1] < latest[owner]
        element, weight, owner, at = element[go], weight[go], owner[go], arrival[go, -1]
        done, block = done + block, min(block * 2, 64)
    return held.reshape(n, registers)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of each signature."""
    parts = signatures.reshape(len(signatures), bands, -1)
    out = np.zeros(parts.shape[:2], U)
    for k in range(parts.shape[2]):
        out = mix(out * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets (ascending hashes, weights): the sum over common d of 1 / sum_e max(a_e / a_d, b_e / b_d). Plain Jaccard if all weights are equal; 1 for two empty sets."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = b[0][at] == a[0]
    x, y = a[1][common], b[1][at[common]]
    if not len(x):
        return 0.0
    alone_a, alone_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.append(0, np.cumsum(y))[np.searchsorted(ratio, ratio, "left")]
    above = x.sum() - np.append(0, np.cumsum(x))[np.searchsorted(ratio, ratio, "left")]
    return float((x / (alone_a + above + ratio * (alone_b + below))).sum())


def forest(sets: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILAR) -> list[tuple[int, int]]:
    """Links of similarity ``least`` or more that span the same parts as all such links between the sets."""
    if len(sets) == 2:
        return [(0, 1)] if probability_jaccard(*sets) >= least - 1e-9 else []
    alive = np.arange(len(sets))
    while len(alive) > 1:  # similarity is at most the share of weight that some other member has too
        ids, at = np.unique(np.concatenate([sets[i][0] for i in alive]), return_inverse=True)
        owner = np.repeat(np.arange(len(alive)), [len(sets[i][0]) for i in alive])
        weight = np.concatenate([sets[i][1] for i in alive])
        shared = np.bincount(at, minlength=len(ids))[at] > 1
        mass = np.bincount(owner, weight * shared, len(alive)) / np.maximum(np.bincount(owner, weight, len(alive)), 1e-12)
        good = mass >= least - 1e-9
        if good.all():
            break
        alive = alive[good]
    if len(alive) < 2:
        return []
    m = len(alive)
    cols, at = np.unique(at[shared], return_inverse=True)
    owner, weight = owner[shared], weight[shared]
    total = np.array([sets[i][1].sum() for i in alive])
    size = np.array([len(sets[i][0]) for i in alive])
    common, mass = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    for lo in range(0, len(cols), 4096):
        mine = (at >= lo) & (at < lo + 4096)
        has, much = (np.zeros((m, min(4096, len(cols) - lo)), np.float32) for _ in range(2))
        has[owner[mine], at[mine] - lo] = 1
        much[owner[mine], at[mine] - lo] = weight[mine]
        common += has @ has.T
        mass += much @ has.T
    mass /= total[:, None]
    bound = np.minimum(mass, mass.T)
    plain = np.array([(sets[i][1] == 1).all() for i in alive])
    both = plain[:, None] & plain[None, :]
    bound = np.where(both, common / (size[:, None] + size[None, :] - common), bound)
    i, j = np.nonzero(np.triu(bound >= least - 1e-4, 1))
    order = np.argsort(-bound[i, j], kind="stable")
    parent = np.arange(m)

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
        a, b = root(p), root(q)
        if a != b and probability_jaccard(sets[alive[p]], sets[alive[q]]) >= least - 1e-9:
            parent[a] = b
            out.append((int(alive[p]), int(alive[q])))
    return out


def node_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("strandweave"), text).alias("k2")]


def signatures(docs: DataFrame) -> DataFrame:
    """Band keys of each distinct text: (k1, k2, size, bands array<long>); texts without words have none."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                h, w, bounds = weighted(Texts(part.column(0)))
                full = np.flatnonzero(np.diff(bounds))
                keys = band_keys(prob_minhash(h, w, bounds)[full]).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.record_batch([*[part.column(c).take(pa.array(full)) for c in (1, 2, 3)], flat], ["k1", "k2", "size", "bands"])

    size = F.octet_length("text").cast("long").alias("size")
    return docs.select("text", *node_key(F.col("text")), size).mapInArrow(run, "k1 long, k2 long, size long, bands array<long>").dropDuplicates(["k1", "k2"])


def buckets(bands: DataFrame) -> DataFrame:
    """Members of the buckets worth comparing: (band, key, k1, k2, n, bytes). Of buckets with the same members the first band's stays."""
    rows = bands.select("k1", "k2", "size", F.posexplode("bands").alias("band", "key"))
    sets = rows.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("k1", "k2")).alias("x"), F.bit_xor(F.xxhash64("k2", "k1", F.lit(2))).alias("y")
    ).where("n > 1")
    chosen = keep(sets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("b"), F.max("bytes").alias("bytes")).select("b.band", "b.key", "n", "bytes"))
    return rows.drop("size").join(chosen, ["band", "key"])


def similar(docs: DataFrame, least: float = SIMILAR, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Verified links between texts: (nodes, links).

    ``nodes(k1, k2, first_id, copies)`` are the distinct texts with the least doc_id that has
    them; ``links(a, b)`` are pairs of nodes, struct<none, first_id, k1, k2>, of similarity
    ``least`` or more that span the classes.
    """
    narrow = docs.select("doc_id", *node_key(F.col("text")))
    nodes = keep(narrow.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    members = keep(buckets(keep(signatures(docs))))
    wanted = members.select("k1", "k2").distinct().join(nodes, ["k1", "k2"]).select(F.col("k1").alias("_a"), F.col("k2").alias("_b"), "first_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *node_key(F.col("text")))
    texts = texts.join(wanted, (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("k1", "k2", "first_id", "text")
    # a bucket of b blocks is compared in all pairs of blocks; each member goes to b of them
    parts = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BLOCK_BYTES))).cast("int")
    mine = F.pmod(F.xxhash64("k2", "k1"), parts).cast("int")
    placed = (
        members.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("band", "key", "k1", "k2", F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"))
    )
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = placed.join(texts, ["k1", "k2"]).repartition(spread, "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "k1", "k2")
    names = ["band", "key", "i", "j", "k1", "k2", "text", "first_id"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    @frugal
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # rows of the group that may go on

        def links(rows: pa.Table) -> pa.RecordBatch:
            group = np.stack([rows.column(c).to_numpy() for c in ("band", "key", "i", "j")], 1)
            k1, k2 = rows.column("k1").to_numpy(), rows.column("k2").to_numpy()
            sets = []
            for b in rows.select(["text"]).combine_chunks().to_batches():
                for part in sliced(b):
                    h, w, bounds = weighted(Texts(part.column(0)))
                    sets += [(h[p:q], w[p:q]) for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
            edges = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1))).tolist() + [len(group)]
            out = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = [lo + k for k in range(hi - lo) if k == 0 or (k1[lo + k], k2[lo + k]) != (k1[lo + k - 1], k2[lo + k - 1])]
                if len(at) > 1:
                    out += [(at[p], at[q]) for p, q in forest([sets[k] for k in at], least)]
            pairs = np.array(out, np.int64).reshape(-1, 2)
            ids = rows.column("first_id").combine_chunks()
            ends = [x for k in (0, 1) for x in (ids.take(pa.array(pairs[:, k])), pa.array(k1[pairs[:, k]]), pa.array(k2[pairs[:, k]]))]
            return pa.record_batch([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in ends], ["a0", "a1", "a2", "b0", "b1", "b2"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in range(4)], 1)
            change = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            if waiting:
                last = np.array([waiting[-1].column(c)[waiting[-1].num_rows - 1].as_py() for c in range(4)])
                if (last != group[0]).any():
                    yield links(pa.Table.from_batches(waiting))
                    waiting = []
            cut = int(change[-1]) if len(change) else 0
            if cut:
                yield links(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield links(pa.Table.from_batches(waiting))

    found = together.select(*names).mapInArrow(verify, f"a0 {kind}, a1 long, a2 long, b0 {kind}, b1 long, b2 long")
    return nodes, keep(found.select(node_of("a0", "a1", "a2").alias("a"), node_of("b0", "b1", "b2").alias("b")).distinct())


def node_of(first_id: str, k1: str, k2: str) -> Column:
    """A text's node; nodes order by doc_id, those without come last."""
    return F.struct(F.col(first_id).isNull().alias("none"), F.col(first_id).alias("first_id"), F.col(k1).alias("k1"), F.col(k2).alias("k2"))


def _labelled(docs: DataFrame, least: float) -> DataFrame:
    """The distinct texts with their class: (a, b, first_id, copies, class_id, keeper); the least node of each class is its keeper."""
    nodes, links = similar(docs, least)
    labels = components(links).select(F.col("node.k1").alias("_a"), F.col("node.k2").alias("_b"), "label")
    rows = nodes.join(labels, (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b")), "left").drop("_a", "_b")
    label = F.coalesce("label", node_of("first_id", "k1", "k2"))
    return keep(rows.select(F.col("k1").alias("_a"), F.col("k2").alias("_b"), "first_id", "copies", label["first_id"].alias("class_id"), (label == node_of("first_id", "k1", "k2")).alias("keeper")))


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, class_id, copies): a row per row; class_id is the least doc_id of the class.

    Classes are the components of links between texts of similarity ``least`` or more. Equal
    texts are one class; null and empty texts and texts without words are equal to their like
    only. Null ids never name a class that has another id. Other columns are ignored; an empty
    table gives an empty result.
    """
    ids = _labelled(docs, least).select("_a", "_b", "class_id", "copies")
    narrow = docs.select("doc_id", *node_key(F.col("text")))
    return narrow.join(ids, (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b"))).select("doc_id", "class_id", "copies")


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least doc_id of the near-duplicate class) and copies (rows with the same text) for every document."""
    return classes(documents(spark, sf_dir).select("doc_id", "text"))


def keep_first(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id, with the columns of ``docs``.

    A class without any doc_id keeps one of its rows; of equal (doc_id, text) rows one stays.
    Texts move once: repeated rows are dropped where the join has put them.
    """
    keepers = _labelled(docs.select("doc_id", "text"), least).where("keeper").select(F.col("_a").alias("__sw_a"), F.col("_b").alias("__sw_b"), F.col("first_id").alias("__sw_first"))
    keyed = docs.select("*", *[k.alias(f"__sw_{n}") for k, n in zip(node_key(F.col("text")), ("k1", "k2"), strict=True)])
    rows = keyed.join(keepers, (F.col("__sw_k1") == F.col("__sw_a")) & (F.col("__sw_k2") == F.col("__sw_b"))).where(F.col("doc_id").eqNullSafe(F.col("__sw_first")))
    return rows.dropDuplicates(["__sw_k1", "__sw_k2"]).select(*[F.col(f"`{c}`") for c in docs.columns])

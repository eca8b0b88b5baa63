"""Holding placements against another mapper's, against truth, and against each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators._groups import per_group


def average_ranks(frame: DataFrame, value: str, name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """``frame`` with the 1-based rank of ``value`` by group; ties share the mean of their places, nulls come first.

    Ranks come from counts per distinct value, so windows hold distinct values, not rows.
    """
    by = by or []
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    n = frame.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2
    ranks = n.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate([*by, value])], rank.alias(name))
    same = [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate([*by, value])]
    return frame.join(ranks, same).select(*frame.columns, name)


def spearman(frame: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Correlation of average ranks, by group; 0 for fewer than two rows or no variance.

    Ranks come from counts per distinct value, so windows hold distinct values, not rows.
    """
    by = by or []

    def ranks(c: str) -> DataFrame:
        n = frame.groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        return n.select(*by, c, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2).alias(f"_r_{c}"))

    rows = frame.select(*by, a, b).dropna(subset=[a, b]).join(ranks(a), [*by, a]).join(ranks(b), [*by, b])
    x, y = f"_r_{a}", f"_r_{b}"
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return rows.groupBy(*by).agg(F.when(spread > 0, F.covar_pop(x, y) / spread).otherwise(0.0).alias("spearman"), F.count(F.lit(1)).alias("n"))


def rmse(a: Column, b: Column) -> Column:
    return F.coalesce(F.sqrt(F.avg(F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))), F.lit(0.0))


def mapped_jaccard(ours: DataFrame, golden: DataFrame) -> DataFrame:
    """(n_ours, n_golden, n_both, n_any, jaccard) of the mapped read names of two parsed SAM tables."""
    a = ours.where(~F.col("unmapped")).select("name").distinct().withColumn("a", F.lit(1))
    b = golden.where(~F.col("unmapped")).select("name").distinct().withColumn("b", F.lit(1))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = a.join(b, "name", "full").agg(s(F.col("a")).alias("n_ours"), s(F.col("b")).alias("n_golden"), s(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    return out.withColumn("jaccard", F.when(F.col("n_any") > 0, F.col("n_both") / F.col("n_any")).otherwise(0.0))


def nearest_free(ours: np.ndarray, golden: np.ndarray) -> np.ndarray:
    """For each position of ``ours`` in order the place in ``golden`` of the nearest one that no earlier position took, or -1; of equally near ones the earliest in ``golden``.

    Positions are sorted once; two union-find forests know the next free place to the right and to
    the left of any place, so a search takes next to constant time.
    """
    n = len(golden)
    order = np.argsort(golden, kind="stable")
    sorted_ = golden[order]
    head = np.searchsorted(sorted_, sorted_, "left").tolist()  # first of the equal positions
    at = np.searchsorted(sorted_, ours, "left").tolist()
    right, left = list(range(n + 1)), list(range(n + 1))  # left[i + 1] is for place i; n and 0 are the ends
    place, pos = order.tolist(), sorted_.tolist()

    def find(forest: list[int], i: int) -> int:
        root = i
        while forest[root] != root:
            root = forest[root]
        while forest[i] != root:
            forest[i], i = root, forest[i]
        return root

    out = np.full(len(ours), -1)
    for k, (x, i) in enumerate(zip(ours.tolist(), at, strict=True)):
        r, l = find(right, i), find(left, i) - 1
        if l >= 0:
            l = find(right, head[l])
        if r == n and l < 0:
            break  # all are taken
        if l >= 0 and (r == n or (x - pos[l], place[l]) < (pos[r] - x, place[r])):
            r = l
        out[k] = place[r]
        right[r], left[r + 1] = r + 1, r
    return out


def pair_records(ours: DataFrame, golden: DataFrame) -> DataFrame:
    """(name, ref_name, reverse, pos_ours, pos_golden, distance, mapq_ours, mapq_golden): each of our mapped records, in query order, takes the nearest golden record of its contig and strand that is still free."""
    cols = ["name", "ref_name", "reverse", "pos0", "mapq", "q_start", "cigar"]
    both = ours.where(~F.col("unmapped")).select(F.lit(0).alias("side"), *cols).unionByName(golden.where(~F.col("unmapped")).select(F.lit(1).alias("side"), *cols))
    names = ["name", "ref_name", "reverse", "pos_ours", "pos_golden", "distance", "mapq_ours", "mapq_golden"]

    def work(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        name = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        ref = rows.column("ref_name").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        back = rows.column("reverse").to_numpy().astype(np.int64)
        side, pos = rows.column("side").to_numpy(), rows.column("pos0").to_numpy()
        order = np.lexsort((back, ref, name))  # stable: both sides stay in query order
        new = np.any([x[order][1:] != x[order][:-1] for x in (back, ref, name)], axis=0)
        edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
        left, right = [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = order[lo:hi]
            a, b = part[side[part] == 0], part[side[part] == 1]
            if len(a) and len(b):
                got = nearest_free(pos[a], pos[b])
                left.append(a[got >= 0])
                right.append(b[got[got >= 0]])
        if not left:
            return None
        one, two = (rows.take(pa.array(np.concatenate(x))).combine_chunks() for x in (left, right))
        col = lambda t, c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
        far = np.abs(col(one, "pos0").to_numpy() - col(two, "pos0").to_numpy())
        q = [col(t, "mapq").cast(pa.int64()) for t in (one, two)]
        return pa.record_batch([col(one, "name"), col(one, "ref_name"), col(one, "reverse"), col(one, "pos0"), col(two, "pos0"), pa.array(far), *q], names)

    return per_group(both, "name", ["name", "side", "q_start", "pos0", "ref_name", "reverse", "mapq", "cigar"], work, "name string, ref_name string, reverse boolean, pos_ours long, pos_golden long, distance long, mapq_ours long, mapq_golden long")


def diff_sam(ours: DataFrame, golden: DataFrame, tolerance: int = 10) -> DataFrame:
    """One row: mapped records of either side, compared, matched, match_rate, mapq_rmse, mapq_spearman (both over matched pairs), and the mapped-set columns."""
    pairs = pair_records(ours, golden).withColumn("matched", F.col("distance") <= tolerance)
    good = pairs.where("matched")
    counts = pairs.agg(F.count(F.lit(1)).alias("compared"), F.coalesce(F.sum(F.col("matched").cast("long")), F.lit(0)).alias("matched"))
    error = good.agg(rmse(F.col("mapq_ours"), F.col("mapq_golden")).alias("mapq_rmse"))
    rank = spearman(good, "mapq_ours", "mapq_golden").agg(F.coalesce(F.max("spearman"), F.lit(0.0)).alias("mapq_spearman"))
    sides = [x.where(~F.col("unmapped")).agg(F.count(F.lit(1)).alias(f"records_{n}")) for x, n in ((ours, "ours"), (golden, "golden"))]
    out = counts.crossJoin(error).crossJoin(rank).crossJoin(mapped_jaccard(ours, golden)).crossJoin(sides[0]).crossJoin(sides[1])  # one-row tables
    return out.withColumn("match_rate", F.when(F.col("compared") > 0, F.col("matched") / F.col("compared")).otherwise(0.0))


def truth_accuracy(placements: DataFrame, truth: DataFrame, tolerances: tuple[int, ...] = (10, 50, 200)) -> DataFrame:
    """Primary placements against ``truth(read_id, contig_id, start, joint)``: reads, placed, on the right contig and strand, and within each tolerance of the true start."""
    best = placements.where("is_primary").select("read_id", F.col("contig_id").alias("_c"), F.col("joint").alias("_j"), F.col("ref_start").alias("_s"))
    rows = truth.join(best, "read_id", "left")
    right = (F.col("_c") == F.col("contig_id")) & (F.col("_j") == F.col("joint"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n_reads"), n(F.col("_c").isNotNull()).alias("n_placed"), n(right).alias("n_right"), *[n(right & (F.abs(F.col("_s") - F.col("start")) <= t)).alias(f"within_{t}") for t in tolerances])


def mapping_stats(reads: DataFrame, placements: DataFrame, anchors: DataFrame, seeds: DataFrame, shard_bits: int) -> DataFrame:
    """One row of counters: reads, mapped, unmapped, fragments (without alternates), anchors, shards touched."""
    a = reads.agg(F.count(F.lit(1)).alias("reads"))
    b = placements.agg(F.count_distinct("read_id").alias("mapped"), F.coalesce(F.sum(F.when(~F.col("is_secondary"), 1)), F.lit(0)).cast("long").alias("fragments"))
    c = anchors.agg(F.count(F.lit(1)).alias("anchors"))
    d = seeds.agg(F.count_distinct(F.col("hash").bitwiseAND(F.lit((1 << shard_bits) - 1))).alias("shards_touched"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).withColumn("unmapped", F.col("reads") - F.col("mapped"))  # one-row tables


def contacts(placements: DataFrame, least_mapq: int = 1, least_distance: int = 1000) -> DataFrame:
    """Pairs of fragments of one read, an own definition (parity isn't claimed).

    Primary and supplementary fragments of mapping quality ``least_mapq`` or more are monomers;
    each unordered pair of a read's monomers is a contact. Pairs on one contig nearer than
    ``least_distance`` go; ``duplicate`` marks pairs of equal ends beyond the first read's.
    """
    from strandweave.functions.seeds import approximate_mapq

    mono = placements.where(~F.col("is_secondary") & (approximate_mapq(F.col("f1"), F.col("f2"), F.col("m")) >= least_mapq)).select("read_id", "fragment_index", F.col("contig_id").alias("c"), F.col("ref_start").alias("p"))
    a, b = (mono.select("read_id", *[F.col(x).alias(f"{x}{k}") for x in ("fragment_index", "c", "p")]) for k in (1, 2))
    pairs = a.join(b, "read_id").where("fragment_index1 < fragment_index2").where((F.col("c1") != F.col("c2")) | (F.abs(F.col("p1") - F.col("p2")) >= least_distance))
    lo, hi = F.least(F.struct("c1", "p1"), F.struct(F.col("c2").alias("c1"), F.col("p2").alias("p1"))), F.greatest(F.struct("c1", "p1"), F.struct(F.col("c2").alias("c1"), F.col("p2").alias("p1")))
    ends = pairs.select("read_id", lo.alias("lo"), hi.alias("hi"))
    first = Window.partitionBy("lo", "hi").orderBy("read_id")
    return ends.withColumn("duplicate", F.row_number().over(first) > 1).select("read_id", F.col("lo.c1").alias("contig_a"), F.col("lo.p1").alias("pos_a"), F.col("hi.c1").alias("contig_b"), F.col("hi.p1").alias("pos_b"), "duplicate", (F.col("lo.c1") == F.col("hi.c1")).alias("cis"))


def contact_summary(contacts_: DataFrame) -> DataFrame:
    """One row: raw, duplicates, cis, trans, cis_fraction (of contacts that are no duplicates)."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    out = contacts_.agg(F.count(F.lit(1)).alias("raw"), n(F.col("duplicate")).alias("duplicates"), n(~F.col("duplicate") & F.col("cis")).alias("cis"), n(~F.col("duplicate") & ~F.col("cis")).alias("trans"))
    return out.withColumn("cis_fraction", F.when(F.col("cis") + F.col("trans") > 0, F.col("cis") / (F.col("cis") + F.col("trans"))).otherwise(0.0))

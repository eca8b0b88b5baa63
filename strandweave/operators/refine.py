"""Endpoint refinement: extend chains into the flanks while they match well enough, many flanks at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.functions.seeds import check, stored_reference
from strandweave.operators.chunks import SIZE, cut, window_parts
from strandweave.params import Params


def flanks(texts: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of bytes, and their lengths; null is empty."""
    texts = texts.fillna("")
    size = texts.str.len().to_numpy(np.int64)
    return np.frombuffer("".join(texts.str.ljust(width)).encode("ascii", "replace"), np.uint8).reshape(-1, width), np.minimum(size, width)


def extension(read: pd.Series, ref: pd.Series, window: int, rate: float) -> np.ndarray:
    """Bases by which two outward flanks agree: grows while the last ``window`` comparisons match at ``rate``; stops at the first that don't. Flanks of unequal length don't grow."""
    width = max(1, int(read.fillna("").str.len().max() or 0) if len(read) else 1)
    (a, n), (b, m) = flanks(read, width), flanks(ref.fillna("").str.slice(0, width), width)
    m = ref.fillna("").str.len().to_numpy(np.int64)
    upto = np.cumsum(a == b, axis=1)
    last = upto.copy()
    last[:, window:] -= upto[:, :-window]
    bad = last / np.minimum(np.arange(1, width + 1), window) < rate
    bad |= np.arange(width) >= n[:, None]
    grown = np.where(bad.any(1), bad.argmax(1), width)
    return np.where(n == m, grown, 0)


def reference_flanks(chains: DataFrame, chunks: DataFrame, width: int, size: int) -> DataFrame:
    """(contig_id, ref_start, ref_end, before, after) of the chains' distinct spans: up to ``width`` bases on either side, as the stored reference has them (N reads as A)."""
    spans = chains.select("contig_id", "ref_start", "ref_end").distinct()
    sides = F.array(*[F.struct(F.lit(k).alias("side"), (a - w).alias("start"), (a + width - w).alias("end")) for k, (a, w) in enumerate(((F.col("ref_start"), width), (F.col("ref_end"), 0)))])
    wanted = spans.select("*", F.explode(sides).alias("_s")).select(*spans.columns, "_s.side", "_s.start", "_s.end")
    found = window_parts(wanted, chunks, size).groupBy(*spans.columns).agg(F.array_sort(F.collect_list(F.struct("side", "_chunk", "_t"))).alias("_parts"))
    one = lambda k, name: stored_reference(F.array_join(F.transform(F.filter("_parts", lambda x: x["side"] == k), lambda x: x["_t"]), "")).alias(name)
    return found.select(*spans.columns, one(0, "before"), one(1, "after"))


def refine_endpoints(chains: DataFrame, reads: DataFrame, contigs: DataFrame, params: Params | None = None, chunks: DataFrame | None = None, size: int = SIZE) -> DataFrame:
    """Chains with moved q_start, q_end, ref_start, ref_end.

    The reference comes as ``chunks`` of ``size`` bases, cut from ``contigs(contig_id, seq)`` if not
    given: flanks of ``max_ext`` bases at most are fetched from the chunks they touch, and only
    they go to the chains and to Python. The stored reference has no N (it reads as A). On the
    reverse strand the left end of the read grows into the right end of the reference. Chains
    whose read or contig is missing stay as they are.
    """
    p = check(params)

    @F.pandas_udf(T.IntegerType())
    def extend(read: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series(extension(read, ref, p.match_window, p.min_match_rate), dtype="int32")

    names = chains.columns
    if chunks is None:
        chunks = cut(contigs, size=size, halo=0)
    found = reference_flanks(chains, chunks, p.max_ext, size)
    found = found.select(*[F.col(c).alias(f"_{c}") for c in ("contig_id", "ref_start", "ref_end")], "before", "after")
    rows = chains.join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("contig_id", "ref_start", "ref_end")], "left")
    rows = rows.join(reads.select(F.col("read_id").alias("_r"), F.col("seq").alias("_read")), F.col("read_id") == F.col("_r"), "left")

    def complement(s: Column) -> Column:
        return F.translate(s, "ACGT", "TGCA")

    q0, q1, r0, r1, reverse = F.col("q_start"), F.col("q_end"), F.col("ref_start"), F.col("ref_end"), F.col("joint") == 1
    read, none = F.col("_read"), F.lit("")
    n = F.coalesce(F.length("_read"), F.lit(0))
    # flanks run outwards from the end they extend
    low, high = F.reverse(F.coalesce("before", none)), F.coalesce("after", none)
    wide = lambda x: F.greatest(F.lit(0), F.least(F.lit(p.max_ext), x)).cast("int")
    rows = rows.select("*", F.when(reverse, complement(high)).otherwise(low).alias("_lf"), F.when(reverse, complement(low)).otherwise(high).alias("_rf"))
    left, right = wide(F.least(q0, F.length("_lf"))), wide(F.least(n - q1, F.length("_rf")))
    before = F.reverse(F.substring(read, (q0 - left + 1).cast("int"), left))
    rows = rows.withColumn("_l", extend(before, F.substring("_lf", F.lit(1), left)))
    rows = rows.withColumn("_e", extend(F.substring(read, (q1 + 1).cast("int"), right), F.substring("_rf", F.lit(1), right)))
    new = {
        "q_start": q0 - F.col("_l"), "q_end": q1 + F.col("_e"),
        "ref_start": F.when(reverse, r0 - F.col("_e")).otherwise(r0 - F.col("_l")), "ref_end": F.when(reverse, r1 + F.col("_l")).otherwise(r1 + F.col("_e")),
    }
    return rows.select(*[new[c].cast("long").alias(c) if c in new else F.col(c) for c in names])

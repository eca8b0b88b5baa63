"""Long sequences as chunks of bounded size, so that no contig is one row, one task or a join's payload.

A chunk table has (contig_id, chunk, start, lead, own, text): chunk c holds the ``own`` bases from
``start`` = c x size on, one base before them (``lead`` is 1, but 0 for the first chunk) and up to
``halo`` bases after them. That is enough for every minimizer window that starts in the chunk and
for telling whether the window before it chose the same k-mer. Texts are single bytes a base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 18
#: k + w - 2 for the largest k and w that are allowed.
HALO = 28 + 255 - 2


def slice_of(text: Column, start: Column, size: Column) -> Column:
    """Bases of a text by place, from 0. On bytes, so that finding the place takes no time."""
    return F.substring(text.cast("binary"), (start + 1).cast("int"), size.cast("int")).cast("string")


def cut(seqs: DataFrame, id_col: str = "contig_id", seq_col: str = "seq", size: int = SIZE, halo: int = HALO) -> DataFrame:
    """The chunk table of a table of whole sequences (its id column keeps its name); null and empty ones have no chunk."""
    n, start = F.octet_length(seq_col), F.col("chunk") * size
    rows = seqs.where(n > 0).select(id_col, F.col(seq_col).cast("binary").alias("_t"), n.cast("long").alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size).cast("long"))).alias("chunk"))
    rows = rows.select(id_col, "_t", "_n", "chunk", start.alias("start"), F.least(F.col("chunk"), F.lit(1)).cast("int").alias("lead"))
    own = F.least(F.lit(size).cast("long"), F.col("_n") - F.col("start")).cast("int")
    return rows.select(id_col, "chunk", "start", "lead", own.alias("own"), slice_of(F.col("_t"), F.col("start") - F.col("lead"), F.col("lead") + F.lit(size + halo)).alias("text"))


def gather(pieces: DataFrame, size: int = SIZE, halo: int = HALO) -> DataFrame:
    """The chunk table of ``pieces(contig_id, start, bases)`` of any length that cover contigs without gaps.

    A piece goes to the chunks that its bases belong to, as own ones or around them; a chunk is put
    together from at most size + halo + 1 bases.
    """
    s, e = F.col("start"), F.col("start") + F.octet_length("bases")
    first, last = F.greatest(F.lit(0).cast("long"), F.floor((s - halo) / size).cast("long")), F.floor(e / size).cast("long")
    rows = pieces.where(e > s).select("contig_id", s.alias("_s"), e.alias("_e"), "bases", F.explode(F.sequence(first, last)).alias("chunk"))
    a = F.greatest(F.col("_s"), F.col("chunk") * size - 1)
    b = F.least(F.col("_e"), (F.col("chunk") + 1) * size + halo)
    rows = rows.select("contig_id", "chunk", a.alias("a"), b.alias("b"), slice_of(F.col("bases"), a - F.col("_s"), b - a).alias("t")).where("b > a")
    found = rows.groupBy("contig_id", "chunk").agg(F.min("a").alias("_a"), F.max("b").alias("_b"), F.array_sort(F.collect_list(F.struct("a", "t"))).alias("_parts"))
    start = F.col("chunk") * size
    own = F.least(F.lit(size).cast("long"), F.col("_b") - start)
    found = found.where(own > 0)
    return found.select("contig_id", "chunk", start.alias("start"), (F.col("_a") < start).cast("int").alias("lead"), own.cast("int").alias("own"), F.array_join(F.transform("_parts", lambda x: x["t"]), "").alias("text"))


def joined(chunks: DataFrame) -> DataFrame:
    """(contig_id, seq): whole sequences again, for those who want a row of each."""
    own = slice_of(F.col("text"), F.col("lead").cast("long"), F.col("own").cast("long"))
    rows = chunks.select("contig_id", "chunk", own.alias("t")).groupBy("contig_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "t"))).alias("_parts"))
    return rows.select("contig_id", F.array_join(F.transform("_parts", lambda x: x["t"]), "").alias("seq"))


def window_parts(wanted: DataFrame, chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """``wanted(contig_id, start, end, ...)`` with (_chunk, _t): what each chunk that a window touches holds of it, joined by (contig, chunk)."""
    names = wanted.columns
    low = F.greatest(F.col("start"), F.lit(0).cast("long"))
    rows = wanted.where(F.col("end") > low).select("*", F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor((F.col("end") - 1) / size).cast("long"))).alias("_chunk"))
    held = chunks.select(F.col("contig_id").alias("_c"), F.col("chunk").alias("_k"), F.col("start").alias("_s"), F.col("lead").alias("_lead"), F.col("own").alias("_own"), F.col("text").alias("_text"))
    met = rows.join(held, (F.col("contig_id") == F.col("_c")) & (F.col("_chunk") == F.col("_k")))
    a, b = F.greatest(F.col("start"), F.col("_s")), F.least(F.col("end"), F.col("_s") + F.col("_own"))
    part = slice_of(F.col("_text"), a - F.col("_s") + F.col("_lead"), b - a)
    return met.where(b > a).select(*names, "_chunk", part.alias("_t"))


def reference_windows(wanted: DataFrame, chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """``wanted(contig_id, start, end, ...)``, each distinct row once, with ``bases``: what the contig holds of [start, end).

    Windows are put together over the borders of the chunks that they touch. They are cut to the
    contig; those outside, empty ones and those of unknown contigs have no row.
    """
    parts = window_parts(wanted.distinct(), chunks, size).groupBy(*wanted.columns).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_t"))).alias("_parts"))
    return parts.select(*wanted.columns, F.array_join(F.transform("_parts", lambda x: x["_t"]), "").alias("bases"))

"""Connected components of a link table by alternating star contractions; everything stays in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm._shared import keep

ROUNDS = 60
#: A node with more than this share of all links is joined by broadcast; there are at most 2 x SHARE of them.
SHARE, LEAST = 10_000, 10_000


def components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``links(a, b)`` as (node, label): label is the least node of the node's component; nodes may be of any type with an order.

    Each round links every node's larger neighbours, then its smaller ones, to the least node
    around; the link table shrinks to stars. A star's centre may hold a third of all links: such
    nodes are few, so what they learn is broadcast instead of joined. Rounds grow with the
    logarithm of a component's size; running out of ``rounds`` is an error, never a wrong answer.
    """
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _digest(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("a", "m"))
        most = max(LEAST, seen[0] // SHARE)
        heavy = F.col("_n") > most
        large = both.where("b > a")
        if seen[0] > most and low.where(heavy).limit(1).count():
            centres = F.broadcast(low.where(heavy).select(F.col("a").alias("_a"), "m"))
            at = F.col("a") == F.col("_a")
            large = large.join(centres, at).select("b", "m").unionByName(large.join(centres, at, "left_anti").join(low.where(~heavy), "a").select("b", "m"))
        else:
            large = large.join(low, "a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = keep(small)
        before, seen = seen, _digest(edges)
        if seen == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _digest(edges: DataFrame) -> tuple:
    """Number and order-free hashes of the links."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())

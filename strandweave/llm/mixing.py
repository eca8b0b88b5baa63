"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]. The schedule's integral is
the source's demand; documents of a source are laid out once per epoch in a hashed order, and
inverting the cumulative demand turns a document's token offset into the time at which it is
read. Sorting by that time (a range partitioning, no global task) is the training order.

Token offsets inside a source are two-level prefix sums (source, hash bucket), so a source that
holds a third of all rows is spread over thousands of windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm._shared import documents, keep, word_count

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
EPOCHS = 2
#: (rate at t=0, rate at t=1) for each weight in turn: heavy sources fade out, light ones fade in. Rates average 1.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, cap: float = EPOCHS) -> DataFrame:
    """``sizes(source, source_size)`` plus ``rank``, ``weight`` and ``target``.

    Sources rank by code point, null last; weights repeat along the ranks. Together targets make
    ``budget`` x all sizes; none is above ``cap`` x its source. The level (target per unit of
    weight) comes from repeated sums over the sources, so no task needs all of them.
    """
    # ranks without one window over all sources: ranges by name, ranks inside, rows of the ranges before
    order = F.col("source").asc_nulls_last()
    ranges = keep(sizes.select("source", F.col("source_size").cast("long").alias("source_size")).repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    ranked = ranges.withColumn("_inside", inside).join(offsets, "_part").select("source", "source_size", (F.col("_base") + F.col("_inside")).cast("long").alias("rank"))
    ranked = keep(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    top = F.col("source_size") * F.lit(float(cap))
    level = -1.0
    while True:  # the capped set only grows, so this ends
        full = top < F.col("weight") * F.lit(level)
        held, left = ranked.agg(F.sum(F.when(full, top).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not left:
            break
        new = (budget * total - held) / left
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.when(top < F.col("weight") * F.lit(level), top).otherwise(F.col("weight") * F.lit(level)))


def time_of(share: Column, start: Column, end: Column) -> Column:
    """Inverse of the cumulative demand of a rate that goes linearly from ``start`` to ``end`` (averaging 1)."""
    slope = end - start
    bent = (F.sqrt(start * start + slope * share * 2.0) - start) / slope
    return F.when(F.abs(slope) < 1e-12, share).otherwise(bent)


def curriculum(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, schedules: Sequence[tuple[float, float]] = SCHEDULES) -> DataFrame:
    """``sized(doc_id, source, size)`` plus source_size, target, taken, copies, first_position, second_position.

    A copy of a document is taken when its middle word lies inside the target, so a source is off
    by half a document at most. Positions are times in [0, 1]; null where the copy isn't taken.
    Null sources are a source of their own; null ids sort like the text ``null``; repeated rows
    are taken one by one; an empty table gives an empty result.
    """
    sized = keep(
        sized.select("doc_id", "source", "size", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_key")).withColumn(
            "_bucket", F.substring("_key", 1, 3)
        )
    )
    buckets = keep(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_size")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, budget)
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    n = len(schedules)
    pick = lambda k: F.element_at(F.array(*[F.lit(float(s[k])) for s in schedules]), (F.col("rank") % n + 1).cast("int"))
    offsets = (
        buckets.withColumn("_ahead", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
        .withColumnRenamed("source", "_s")
        .join(targets, F.col("_s").eqNullSafe(F.col("source")))
        .select("_s", F.col("_bucket").alias("_b"), "_ahead", "source_size", "target", pick(0).alias("_from"), pick(1).alias("_to"))
    )
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = (
        sized.withColumn("_upto", F.sum("size").over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_start", F.col("_ahead") + F.col("_upto") - F.col("size"))
    )

    def begins(epoch: int) -> Column:
        return F.col("_start") + F.lit(epoch) * F.col("source_size")

    def taken(epoch: int) -> Column:
        return begins(epoch) * 2.0 + F.col("size") <= F.col("target") * 2.0

    def position(epoch: int) -> Column:
        share = F.least(F.when(F.col("target") > 0, begins(epoch) / F.col("target")).otherwise(0.0), F.lit(1.0))
        return F.when(taken(epoch), F.round(time_of(share, F.col("_from"), F.col("_to")), 9) + 0.0)

    copies = taken(0).cast("int") + taken(1).cast("int")
    return laid.select(
        "doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"),
        copies.alias("copies"), position(0).alias("first_position"), position(1).alias("second_position"),
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def op4_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mix, a row per row of ``documents``, range-sorted by the time of its first reading; awkward rows as in ``curriculum``."""
    plan = curriculum(sized_documents(documents(spark, sf_dir)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return plan.repartitionByRange(parts, "first_position", "doc_id").sortWithinPartitions("first_position", "doc_id").drop("source")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order: a document read twice is there twice, one not taken is gone.

    Copies of the text travel once, with their positions; columns are those of ``docs``.
    """
    keys = ("__sw_id", "__sw_src", "__sw_size")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    plan = curriculum(sized_documents(docs)).where("copies > 0").select(
        name("doc_id").alias("__sw_id"), name("source").alias("__sw_src"), F.col("size").alias("__sw_size"), F.array_compact(F.array("first_position", "second_position")).alias("__sw_times")
    )
    # Rows that agree in id, source and size are interchangeable to the plan: number them on both sides to pair them one to one.
    plan = plan.withColumn("__sw_n", F.row_number().over(Window.partitionBy(*keys).orderBy("__sw_times")))
    left = docs.withColumns({"__sw_id": name("doc_id"), "__sw_src": name("source"), "__sw_size": word_count(F.col("text"))})
    left = left.withColumn("__sw_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("text"))))
    # the number is no join key, so that texts stay where the window has put them
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    joined = left.alias("l").join(plan.alias("r"), same[0] & same[1] & same[2] & (F.col("l.__sw_n") - F.col("r.__sw_n") == 0))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        joined.select(*[F.col(f"l.`{c}`") for c in docs.columns], F.explode("r.__sw_times").alias("__sw_time"))
        .repartitionByRange(parts, "__sw_time")
        .sortWithinPartitions("__sw_time")
        .drop("__sw_time")
    )


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``op4_curriculum``."""
    return f"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                      md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM {table}),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
    w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                 CASE rank % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a,
                 CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS b,
                 (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM r),
    c AS (SELECT *, (1.5::DOUBLE * total - coalesce(sum(source_size * 2.0::DOUBLE) OVER lo, 0)) / sum(weight) OVER hi AS level,
                 source_size * 2.0::DOUBLE / weight AS edge FROM w
          WINDOW lo AS (ORDER BY source_size * 2.0::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 hi AS (ORDER BY source_size * 2.0::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    l AS (SELECT level FROM c WHERE level <= edge ORDER BY edge, rank LIMIT 1),
    t AS (SELECT c.*, least(source_size * 2.0::DOUBLE, weight * (SELECT level FROM l)) AS target FROM c),
    o AS (SELECT d.*, t.source_size, t.target, t.a, t.b,
                 sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS c0
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    p AS (SELECT *, c0 * 2.0::DOUBLE + size <= target * 2.0::DOUBLE AS t1, (c0 + source_size) * 2.0::DOUBLE + size <= target * 2.0::DOUBLE AS t2,
                 least(CASE WHEN target > 0 THEN c0 / target ELSE 0 END, 1.0::DOUBLE) AS u1,
                 least(CASE WHEN target > 0 THEN (c0 + source_size) / target ELSE 0 END, 1.0::DOUBLE) AS u2 FROM o)
    SELECT doc_id, size, source_size, target, CAST((t1::INT + t2::INT) * size AS BIGINT) AS taken, t1::INT + t2::INT AS copies,
           CASE WHEN t1 THEN round(CASE WHEN a = b THEN u1 ELSE (sqrt(a * a + (b - a) * u1 * 2.0::DOUBLE) - a) / (b - a) END, 9) + 0.0::DOUBLE END AS first_position,
           CASE WHEN t2 THEN round(CASE WHEN a = b THEN u2 ELSE (sqrt(a * a + (b - a) * u2 * 2.0::DOUBLE) - a) / (b - a) END, 9) + 0.0::DOUBLE END AS second_position
    FROM p"""

"""Mapping a stream of reads against a fixed index: stateless micro-batches, append only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from strandweave.functions.seeds import check
from strandweave.operators._store import scratch
from strandweave.operators.sam import sam_lines, sam_records
from strandweave.params import Params
from strandweave.plans.mapping import map_reads
from strandweave.plans.reference import Reference, map_batch

COUNTERS = ("reads", "mapped", "unmapped", "anchors", "fragments")
COUNTED = "batch long, " + ", ".join(f"{c} long" for c in COUNTERS)


def map_stream(reads: DataFrame, contigs: DataFrame, index: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, params: Params | None = None, available_now: bool = True) -> StreamingQuery:
    """Map each micro-batch of the streaming ``reads(read_id, name, seq, qual)`` and hand its SAM lines to ``sink(lines, batch_id)``.

    No state is kept between batches, so no watermark is needed; a replayed batch gives the same
    lines, so a sink that overwrites by batch id is exactly-once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(sam_lines(sam_records(map_reads(batch, contigs, params, index).placements, batch, contigs)), batch_id)

    writer = reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def observed(placements: DataFrame, name: str | Observation = "mapping") -> DataFrame:
    """Placements that report running counters to listeners and ``Observation`` objects."""
    return placements.observe(name, F.count(F.lit(1)).alias("records"), F.sum(F.col("is_primary").cast("long")).alias("mapped"), F.sum((~F.col("is_secondary")).cast("long")).alias("fragments"))


def map_growing(reads: DataFrame, reference: Reference, out: str, checkpoint: str, params: Params | None = None, seconds: float = 0) -> StreamingQuery:
    """Map the streaming ``reads`` against a stored reference: SAM text of each batch in ``out/sam/batch=<id>``, its counters in ``out/counters/batch=<id>``.

    Both folders are overwritten when a batch is replayed after a failure, and counters are
    written last but before the batch is committed, so ``totals`` is right after any restart.
    """
    p = check(params)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            mapped = map_batch(batch.select("read_id", "name", "seq", "qual"), reference, p)
            mapped.lines.orderBy("read_id", "fragment_index", "alt_rank").select("value").write.mode("overwrite").text(f"{out}/sam/batch={batch_id}")
        row = spark.range(1).select(*[F.lit(mapped.counters[c]).cast("long").alias(c) for c in COUNTERS])
        row.coalesce(1).write.mode("overwrite").json(f"{out}/counters/batch={batch_id}")

    writer = reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def totals(spark: SparkSession, out: str) -> dict[str, int]:
    """The sums of all batches' counters in ``out``, each batch once; 0 before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/counters")
    known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(COUNTED).json(f"{out}/counters") if known else spark.createDataFrame([], COUNTED)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]).first().asDict()


class RunningTotals(StreamingQueryListener):
    """Adds up, as batches end, what queries observe under ``name`` (see ``observed``); a batch that is reported twice counts once. Starts from ``before``, the totals of earlier runs."""

    def __init__(self, name: str = "mapping", before: dict[str, int] | None = None) -> None:
        self.name, self.sums, self._seen = name, Counter(before or {}), set()

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        progress = event.progress
        key, row = (str(progress.id), progress.batchId), progress.observedMetrics.get(self.name)
        if row is not None and key not in self._seen:
            self._seen.add(key)
            self.sums.update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        pass

"""Structured Streaming: incremental preparation and live run totals.

Both sinks write one folder per micro-batch and overwrite it on a retry, so a batch that is
replayed after a failure leaves the same result as one that ran once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.packing import assign_batches, pack
from ..operators.tokens import tokenize
from ..schemas import PACK_BATCH_ROWS
from ..sources.prepared import is_complete, newest_first
from ..sources.readers import file_place, with_file_position

COLUMNS = ("input_ids", "special_tokens_mask")


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream over text files that arrive in a folder, one document per line."""
    lines = spark.readStream.text(path).withColumnRenamed("value", "text")
    return lines.select("text", *file_place())


def stream_table(spark: SparkSession, path: str, schema: StructType, name: str | None = None) -> DataFrame:
    """A stream over parquet files that arrive in a folder, or of the table ``name`` in it: one file or a folder of files."""
    # A source's path is a folder unless it is a pattern; the file or folder of this name is all that this one matches.
    return spark.readStream.schema(schema).parquet(f"{path}/{{{name}}}" if name else path)


def stream_pack(
    docs: DataFrame,
    vocab: pa.Table,
    out: str,
    checkpoint: str,
    block_size: int,
    n_shards: int,
    batch_rows: int = PACK_BATCH_ROWS,
    key: str | None = None,
    split: str = "train",
) -> StreamingQuery:
    """Tokenize and pack whatever has arrived; blocks do not cross micro-batches.

    Without a ``key`` column, rows are ordered by their place in the files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if key is None:
            batch = with_file_position(batch)
        if "split" not in batch.columns:
            batch = batch.withColumn("split", F.lit(split))
        order = key or "row_idx"
        placed = assign_batches(batch.select("split", order, "text"), order, n_shards, batch_rows)
        blocks = pack(tokenize(placed, vocab), block_size, order, COLUMNS)
        blocks.write.mode("overwrite").parquet(f"{out}/stream_batch={batch_id}")

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_totals(steps: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Samples and tokens per run so far; each micro-batch writes them for all runs.

    There is one row per run, so a snapshot is small, and a reader needs the newest one only.
    """
    seen = F.when((F.col("rank") == 0) & (F.col("phase") == "train"), F.col("batch_size") * F.col("devices"))
    totals = steps.groupBy("run_id").agg(
        F.coalesce(F.sum(seen), F.lit(0)).cast("long").alias("samples"),
        F.coalesce(F.sum(seen * F.col("width")), F.lit(0)).cast("long").alias("tokens"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/stream_batch={batch_id}")

    return (
        totals.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def events_once(events: DataFrame, event_time: str, delay: str, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """A stream of events without the ones that were sent again, and without those that come too late.

    An event is late if it is more than ``delay`` behind the newest event time of the micro-batches before; it
    is dropped, and the query's progress counts it. A copy is recognised if it arrives while its original is
    within the delay: what has to be remembered is bounded by the delay, not by the stream.
    """
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def late_events(query: StreamingQuery) -> int:
    """How many rows a query has dropped because they were late, as far as its progress reports go back."""
    reports = [p.stateOperators for p in query.recentProgress]
    return sum(o.numRowsDroppedByWatermark for operators in reports for o in operators)


def read_totals(spark: SparkSession, out: str) -> DataFrame:
    """Current totals: the newest snapshot that was finished."""
    for path in newest_first(spark, out):
        if is_complete(spark, path):
            return spark.read.parquet(path).select("run_id", "samples", "tokens")
    raise FileNotFoundError(f"no finished totals at {out}")

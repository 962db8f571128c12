"""Printable metric lines and corpus summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fixed, format_elapsed, last_path_part
from .packing import blocks_in


def metric_text(name: Column, value: Column, is_float: Column) -> Column:
    """``key: value``: times as durations, other floats with 3 decimals, integers as they are."""
    shown = (
        F.when(is_float & name.contains("time"), format_elapsed(value))
        .when(is_float, fixed(value, 3))
        .otherwise(value.cast("long").cast("string"))
    )
    return F.concat(last_path_part(name), F.lit(": "), shown)


def metric_line(metrics: DataFrame, by: Sequence[str] = ("run_id", "step"), prefix: str = "") -> DataFrame:
    """One line per step from a tall table ``(…, ord, name, value, is_float)``.

    A line holds the metrics of one step: a handful of names, however long the run.
    """
    text = metric_text(F.col("name"), F.col("value"), F.col("is_float"))
    lines = metrics.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))).alias("parts"))
    return lines.select(
        *by, F.concat(F.lit(f"{prefix} " if prefix else ""), F.array_join("parts.t", ", ")).alias("line")
    )


def corpus_stats(totals: DataFrame, block_sizes: Sequence[int]) -> DataFrame:
    """Documents, tokens, blocks and document lengths per split, for each block size."""
    sizes = F.array(*[F.lit(b).cast("long") for b in block_sizes])
    per_size = totals.withColumn("block_size", F.explode(sizes))
    return per_size.groupBy("split", "block_size").agg(
        F.sum("docs").alias("docs"),
        F.sum("tokens").alias("tokens"),
        F.sum(blocks_in(F.col("tokens"), F.col("block_size"))).alias("blocks"),
        F.min("min_len").alias("min_len"),
        F.max("max_len").alias("max_len"),
        F.round(F.sum("tokens") / F.sum("docs"), 6).alias("mean_len"),
    )


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("docs"))

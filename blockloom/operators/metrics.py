"""Run metrics over step logs.

A step log has one row per ``(run_id, session, rank, batch_idx)``. One run may hold a large part
of all rows; the order-sensitive operators therefore work in ranges of steps (see ``ordering``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import int_div
from .ordering import dense_index, forward_fill, previous_value, running_sum

# Steps of one run that are handled together; a step counter is dense, so no cut points needed.
STEP_RANGE = 65_536


def _range_of(step: str) -> Column:
    return int_div(F.col(step), F.lit(STEP_RANGE))


def _counters() -> dict[str, Column]:
    # Rank 0 speaks for all devices, so uneven last batches are counted as if they were even.
    seen = F.when(F.col("phase") == "train", F.col("batch_size") * F.col("devices")).otherwise(0).cast("long")
    return {"samples": seen, "tokens": seen * F.col("width")}


def progress(steps: DataFrame) -> DataFrame:
    """Running samples and tokens after each training batch; counters restart with the session."""
    train = steps.filter((F.col("rank") == 0) & (F.col("phase") == "train"))
    return running_sum(
        train, _counters(), F.col("batch_idx"), by=("run_id", "session"), bucket=_range_of("batch_idx")
    )


def progress_at_val(steps: DataFrame) -> DataFrame:
    """The training counters as they stand at each validation batch."""
    rank0 = steps.filter(F.col("rank") == 0)
    counted = running_sum(
        rank0, _counters(), F.col("batch_idx"), by=("run_id", "session"), bucket=_range_of("batch_idx")
    )
    return counted.filter(F.col("phase") == "val")


def train_loss(steps: DataFrame) -> DataFrame:
    """One training loss per step, as rank 0 logs it."""
    return steps.filter((F.col("rank") == 0) & (F.col("phase") == "train")).select(
        "run_id", "session", "batch_idx", "step", "loss"
    )


def val_loss(steps: DataFrame) -> DataFrame:
    """Mean validation loss per pass: weighted by batch size on a rank, then over ranks."""
    per_rank = (
        steps.filter(F.col("phase") == "val")
        .groupBy("run_id", "step", "rank")
        .agg(F.sum(F.col("loss") * F.col("batch_size")).alias("s"), F.sum("batch_size").alias("w"))
    )
    return per_rank.groupBy("run_id", "step").agg(
        F.avg(F.col("s") / F.col("w")).alias("val_loss"), F.count(F.lit(1)).alias("ranks")
    )


def validation_spans(steps: DataFrame) -> DataFrame:
    """Start, end and peak memory of every validation pass on every rank, sessions apart."""
    return (
        steps.filter(F.col("phase") == "val")
        .groupBy("run_id", "session", "rank", "step")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.max("peak_bytes").alias("peak_bytes"),
        )
    )


def system_metrics(spans: DataFrame) -> DataFrame:
    """Per validation: largest peak memory in MiB and mean seconds since the last one ended.

    The first validation of a rank in a session has no interval and is left out: the clock lives in
    the process, and the pause before a restart is no time between validations.
    """
    timed = previous_value(
        spans,
        F.col("end_us"),
        "prev_end_us",
        F.col("step"),
        by=("run_id", "session", "rank"),
        bucket=_range_of("step"),
    ).filter(F.col("prev_end_us").isNotNull())
    return timed.groupBy("run_id", "session", "step").agg(
        (F.max("peak_bytes") / F.lit(2**20)).alias("max_peak_mib"),
        (F.sum(F.col("start_us") - F.col("prev_end_us")) / F.count(F.lit(1)) / F.lit(1e6)).alias("avg_seconds"),
    )


def loss_at_saves(saves: DataFrame, losses: DataFrame) -> DataFrame:
    """Saved steps with the newest validation loss at or before them."""
    events = losses.select("run_id", "step", F.lit(0).alias("kind"), "val_loss").unionByName(
        saves.select("run_id", "step", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("val_loss"))
    )
    filled = forward_fill(
        events,
        {"loss": F.col("val_loss")},
        F.col("step"),
        by=("run_id",),
        tie=F.col("kind"),
        bucket=_range_of("step"),
    )
    return filled.filter(F.col("kind") == 1).select("run_id", "step", "loss")


def best_checkpoint(candidates: DataFrame) -> DataFrame:
    """The saved step with the lowest loss per run, the earlier one on equal loss."""
    return (
        candidates.filter(F.col("loss").isNotNull())
        .groupBy("run_id")
        .agg(F.min(F.struct("loss", "step")).alias("b"))
        .select("run_id", "b.step", "b.loss")
    )


def every_nth(
    events: DataFrame, backoff: int = 10, order: str = "step", by: Sequence[str] = ("run_id", "session")
) -> DataFrame:
    """Events that act when ``backoff`` events are skipped between two actions: every 11th by default.

    The count starts again with each session, as it lives in the process.
    """
    counted = dense_index(events, F.col(order), by=by, out="event_no", bucket=_range_of(order))
    return counted.withColumn("event_no", F.col("event_no") + 1).filter(
        F.pmod(F.col("event_no"), F.lit(backoff + 1)) == 0
    )

"""Positions of blocks in an epoch: permutation, batches, ranks, steps.

Everything here works on narrow rows of block ids; blocks themselves stay where they are stored
until a consumer reads them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import int_div
from ..functions.draws import sort_draw, sort_draw_bucket, stream_id
from ..functions.permute import Permutation
from .ordering import default_buckets, dense_index


def shuffle(
    df: DataFrame, seed: int, epoch: int, block: str = "block_idx", by: Sequence[str] = ("split",), out: str = "pos"
) -> DataFrame:
    """Dense random position per epoch, a pure function of seed, epoch and block id."""
    drawn = df.withColumn("__draw", sort_draw(stream_id(seed, epoch, F.col(block))))
    n = default_buckets(df.sparkSession)
    return dense_index(
        drawn,
        F.col("__draw"),
        by=by,
        tie=F.col(block),
        out=out,
        bucket=sort_draw_bucket(F.col("__draw"), n),
    ).drop("__draw")


def batches(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Consecutive groups of ``size``; the last one may be short."""
    return df.withColumn("batch_idx", int_div(F.col(pos), F.lit(size))).withColumn(
        "slot", F.pmod(F.col(pos), F.lit(size)).cast("long")
    )


def limit_eval(df: DataFrame, samples: int, batch: int) -> DataFrame:
    """Keep ``samples // batch`` batches per rank; -1 keeps all, too few samples keep none."""
    if samples == -1:
        return df
    return df.filter(F.col("batch_idx") < samples // batch)


def shard_by_rank(
    df: DataFrame,
    world: int,
    pos: str = "pos",
    by: Sequence[str] = ("split",),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Deal positions to ranks in turn; the first rows are repeated so that ranks are equal.

    A row repeats itself at ``pos + N, pos + 2N …`` below the padded length, which covers sets
    smaller than the world as well. ``counts`` (``by``, ``n``) has one row per split; without
    it, the rows are counted.
    """
    if counts is None:
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*by, F.col("n").alias("__n"))
    padded = int_div(F.col("__n") + (world - 1), F.lit(world)) * world
    dealt = (
        df.join(counts, list(by))
        .withColumn("__padded", padded)
        .withColumn("__p", F.explode(F.sequence(F.col(pos), F.col("__padded") - 1, F.col("__n"))))
        .withColumn("is_pad", F.col("__p") >= F.col("__n"))
        .withColumn("rank", F.pmod(F.col("__p"), F.lit(world)).cast("long"))
        .withColumn(pos, int_div(F.col("__p"), F.lit(world)))
    )
    return dealt.drop("__n", "__padded", "__p")


def accumulate(df: DataFrame, n: int) -> DataFrame:
    """``n`` micro batches make one optimizer step."""
    return df.withColumn("step", int_div(F.col("batch_idx"), F.lit(n)))


def check_steps(df: DataFrame, batch_size: int, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows per optimizer step over all ranks, and whether they make a full batch."""
    rows = df.groupBy(*by, "step").agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("full", F.col("rows") == batch_size)


def due(step: Column, interval: int) -> Column:
    """Whether something that happens every ``interval`` steps happens at ``step``."""
    if interval <= 0:
        return F.lit(False)
    return (step > 0) & (F.pmod(step, F.lit(interval)) == 0)


def first_step(step: Column) -> Column:
    """The extra trigger at step 1."""
    return step == 1


def due_steps(
    df: DataFrame, eval_interval: int, save_interval: int, accum: int, passes: str = "passes", at_first: bool = True
) -> DataFrame:
    """Mark forward passes that evaluate and those that save.

    ``passes`` counts forward passes from 1 across epochs. An evaluation comes every
    ``eval_interval * accum`` passes, a save every ``save_interval`` full steps.
    """
    n = F.col(passes)
    step = int_div(n, F.lit(accum))
    ends_step = F.pmod(n, F.lit(accum)) == 0
    evals = due(n, eval_interval * accum)
    if at_first:
        evals = evals | (first_step(step) & ends_step)
    return (
        df.withColumn("step", step)
        .withColumn("eval_due", evals)
        .withColumn("save_due", due(step, save_interval) & ends_step)
    )


def resume_epoch(spark: SparkSession, order: Permutation, world: int, micro: int, accum: int, first_step: int = 0) -> DataFrame:
    """``(step, rank, batch_idx, slot, block_idx, is_pad)`` of an epoch from an optimizer step on.

    The order of the epoch is a function of the position, so a run goes on at any step: steps before
    it cost nothing, and nothing is sorted or shuffled. Ranks are dealt positions in turn and made equal by the
    first blocks of the order, as in ``shard_by_rank``; batches and steps are as in ``batches`` and ``accumulate``.
    """
    if min(world, micro, accum) <= 0 or first_step < 0:
        raise ValueError("world, micro and accum must be positive, first_step 0 or more")
    padded = -(-order.n // world) * world
    rows = spark.range(min(first_step * world * micro * accum, padded), padded).withColumnRenamed("id", "__p")
    within = int_div(F.col("__p"), F.lit(world))
    batch = int_div(within, F.lit(micro))
    return rows.select(
        int_div(batch, F.lit(accum)).alias("step"),
        F.pmod("__p", F.lit(world)).alias("rank"),
        batch.alias("batch_idx"),
        F.pmod(within, F.lit(micro)).alias("slot"),
        order.block_at(F.pmod(F.col("__p"), F.lit(max(order.n, 1)))).alias("block_idx"),
        (F.col("__p") >= order.n).alias("is_pad"),
    )

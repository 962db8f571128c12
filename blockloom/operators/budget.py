"""Run budgets: options in samples, tokens, iterations or steps, turned into optimizer steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import int_div

# Option defaults of a run.
DEFAULTS = {
    "base_unit": "optimizer-steps",
    "training_goal": 100_000,
    "eval_interval": 0.1,
    "save_interval": 0.1,
    "warmup_period": 0.005,
    "lr_decay_period": -1.0,
    "block_size": 512,
    "batch_size": 128,
    "num_devices": 1,
    "micro_batch_size": None,
    "gradient_accumulation_steps": -1,
}


# Options that may be shares of the goal.
FRACTIONS = ("eval_interval", "save_interval", "warmup_period", "lr_decay_period")


def _of_goal(value: Column, goal: Column) -> Column:
    # Below one it is a share of the goal. Both truncations are those of float arithmetic.
    v = value.cast("double")
    return F.when(v < 1, (v * goal).cast("long").cast("double")).otherwise(v)


def _per_step(value: Column, units: Column) -> Column:
    return (value.cast("double") / units).cast("long")


def run_plan(runs: DataFrame) -> DataFrame:
    """Add micro batch, accumulation, units per step and all budgets in optimizer steps.

    Rows whose options contradict each other, or whose goal or intervals come out as zero
    steps, have ``valid = false``; numbers that cannot be computed are null.
    """
    devices = F.when(F.col("num_devices") > 0, F.col("num_devices").cast("long"))
    batch = F.col("batch_size").cast("long")
    micro = F.coalesce(F.col("micro_batch_size").cast("long"), int_div(batch, devices))
    micro = F.when(micro > 0, micro)
    auto = F.col("gradient_accumulation_steps") == -1
    accum = F.when(auto, int_div(batch, micro * devices)).otherwise(F.col("gradient_accumulation_steps").cast("long"))
    accum = F.when(accum > 0, accum)
    unit = F.col("base_unit")
    units = (
        F.when(unit == "samples", batch)
        .when(unit == "tokens", batch * F.col("block_size"))
        .when(unit == "optimizer-steps", F.lit(1).cast("long"))
        .when(unit == "iters", accum)
    )
    units = F.when(units > 0, units)
    goal = F.col("training_goal").cast("double")
    decay = F.when(F.col("lr_decay_period") == -1, goal).otherwise(_of_goal(F.col("lr_decay_period"), goal))
    consistent = (
        devices.isNotNull()
        & (F.col("micro_batch_size").isNotNull() | (F.pmod(batch, devices) == 0))
        & (F.pmod(batch, F.col("micro_batch")) == 0)
        & (batch == F.col("micro_batch") * devices * F.col("accumulation"))
        & F.col("units_per_step").isNotNull()
        & (F.col("goal_steps") > 0)
        & (F.col("eval_steps") > 0)
        & (F.col("save_steps") > 0)
    )
    return (
        runs.withColumn("micro_batch", micro)
        .withColumn("accumulation", accum)
        .withColumn("units_per_step", units)
        .withColumn("goal_steps", _per_step(goal, F.col("units_per_step")))
        .withColumn("eval_steps", _per_step(_of_goal(F.col("eval_interval"), goal), F.col("units_per_step")))
        .withColumn("save_steps", _per_step(_of_goal(F.col("save_interval"), goal), F.col("units_per_step")))
        .withColumn("warmup_steps", _per_step(_of_goal(F.col("warmup_period"), goal), F.col("units_per_step")))
        .withColumn("decay_steps", _per_step(decay, F.col("units_per_step")))
        .withColumn("valid", F.coalesce(consistent, F.lit(False)))
    )


def run_coverage(plans: DataFrame, stats: DataFrame, split: str = "train") -> DataFrame:
    """Steps per epoch, epochs needed and tokens seen for each planned run; invalid runs have nulls.

    ``stats`` has one row per split and block size; Spark broadcasts it as long as it is small.
    """
    corpus = stats.filter(F.col("split") == split).select(
        F.col("block_size").cast("long").alias("block_size"), F.col("blocks").alias("corpus_blocks")
    )
    batch = F.col("batch_size").cast("long")
    per_epoch = F.ceil(F.col("corpus_blocks") / batch).cast("long")
    return (
        plans.withColumn("block_size", F.col("block_size").cast("long"))
        .withColumn("goal_steps", F.when(F.col("valid"), F.col("goal_steps")))
        .join(corpus, "block_size", "left")
        .withColumn("steps_per_epoch", per_epoch)
        .withColumn(
            "epochs",
            F.round(F.col("goal_steps") / F.when(F.col("steps_per_epoch") > 0, F.col("steps_per_epoch")), 6),
        )
        .withColumn("tokens_seen", F.col("goal_steps") * batch * F.col("block_size"))
    )


def with_defaults(options: DataFrame, run: str = "run_id") -> DataFrame:
    """One row of typed options per run from ``(run, key, value)``, defaults where a key is not set.

    Unknown keys are ignored; the result is what ``run_plan`` takes.
    """
    known = options.filter(F.col("key").isin(*DEFAULTS))
    picked = known.groupBy(run).agg(
        *[F.max(F.when(F.col("key") == k, F.col("value").cast("string"))).alias(k) for k in DEFAULTS]
    )
    typed = options.select(run).distinct().join(picked, run, "left")
    for key, value in DEFAULTS.items():
        kind = "string" if isinstance(value, str) else "double" if key in FRACTIONS else "long"
        typed = typed.withColumn(key, F.coalesce(F.col(key).cast(kind), F.lit(value).cast(kind)))
    return typed


def layered_overrides(overrides: DataFrame) -> DataFrame:
    """The value of every option after defaults, configs in order and the command line.

    Takes ``(run_id, key, layer, seq, value)``; the last layer that sets a key wins.
    """
    return (
        overrides.groupBy("run_id", "key")
        .agg(F.max(F.struct("layer", "seq", "value")).alias("w"))
        .select("run_id", "key", "w.layer", "w.value")
    )

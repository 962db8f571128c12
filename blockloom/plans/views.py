"""Role views: the given tables read as documents, step logs, artifacts, runs and options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import int_div, round_up
from ..operators.artifacts import ITER_RANGE
from ..operators.ordering import dense_index, group_value, running_sum
from ..session import stored
from ..sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split() -> Column:
    return F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in two splits."""
    return table(spark, sf_dir, "documents").select("doc_id", _split().alias("split"), "text")


def spread_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs`` over all cores, for work on the text itself."""
    return spread(docs(spark, sf_dir), "doc_id")


def _micros(ts: str) -> Column:
    # Zone-free, so the session's time zone does not matter.
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def events_as_steps(events: DataFrame) -> DataFrame:
    """Row-wise part of ``steps``: works on a stream as well."""
    e = F.col("event_id")
    start = _micros("ts")
    return events.select(
        "event_id",
        (F.col("user_id") % 10).alias("run_id"),
        (e % 4).alias("rank"),
        F.when(F.dayofmonth("ts") > 15, 1).otherwise(0).alias("session"),
        F.when(F.col("event_type") == "view", "val").otherwise("train").alias("phase"),
        (e % 8 + 1).alias("batch_size"),
        round_up(F.get_json_object("props", "$.k").cast("long"), 8).alias("width"),
        F.lit(4).cast("long").alias("devices"),
        F.col("value").alias("loss"),
        start.alias("start_us"),
        (start + e % 60 * 1_000_000).alias("end_us"),
        (F.lit(1048576).cast("long") * (e % 97 + 1)).alias("peak_bytes"),
    )


def steps(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``events`` as a step log of ten runs on four ranks; four training passes make a step.

    ``batch_idx`` orders all rows of a rank, ``passes`` counts its training passes alone, and a
    validation belongs to the step that training has reached. Only ``columns`` are stored.
    """
    rows = events_as_steps(table(spark, sf_dir, "events"))
    trains = (F.col("phase") == "train").cast("long")
    one = F.lit(1).cast("long")
    counted = running_sum(rows, {"__all": one, "passes": trains}, F.col("event_id"), by=("run_id", "rank"))
    indexed = counted.withColumn("batch_idx", F.col("__all") - 1).withColumn(
        "step", int_div(F.col("passes") - trains, F.lit(4))
    )
    return stored(indexed.select(*(columns or indexed.drop("__all").columns)), "steps")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as checkpoints: a customer is a run, an order an artifact."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("artifact_id"),
        _micros("o_orderdate").alias("created_us"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"),
        (F.col("o_totalprice") / 1000).alias("val_loss"),
        (F.col("o_orderstatus") == "F").alias("kept"),
        (F.col("o_custkey") % 3).alias("cache_id"),
    )
    indexed = dense_index(rows, F.col("created_us"), by=("run_id",), tie=F.col("artifact_id"), out="iter")
    per_run = {"__last": (F.max, F.col("iter")), "__best": (F.min, F.struct("val_loss", "artifact_id"))}
    known = group_value(indexed, per_run, ("run_id",), int_div(F.col("iter"), F.lit(ITER_RANGE)))
    tags = F.array_compact(
        F.array(
            F.when(F.col("iter") == F.col("__last"), "latest"),
            F.when(F.col("artifact_id") == F.col("__best.artifact_id"), "best"),
            F.when(F.col("kept"), "keep"),
        )
    )
    return stored(known.withColumn("aliases", tags).drop("kept", "__last", "__best"), "artifacts")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as users write them, built from ``orders``; many repeat."""
    run = F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 4
    ref = (
        F.when(kind == 0, F.concat(F.lit("wandb:"), run))
        .when(kind == 1, F.concat(F.lit("wandb:"), run, F.lit(":best")))
        .when(kind == 2, F.concat(F.lit("wandb:"), run, F.lit(":keep")))
        .otherwise(F.concat(F.lit("out/"), F.col("o_orderkey").cast("string"), F.lit("/model.ckpt")))
    )
    return table(spark, sf_dir, "orders").select(ref.alias("ref"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as run options, valid and contradictory ones."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    price = F.round("o_totalprice").cast("long")
    unit = F.get(F.array(*[F.lit(u) for u in ("samples", "tokens", "optimizer-steps", "iters")]), (k % 4).cast("int"))
    third = (k % 3).cast("int")

    def pick(*values: float) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), third)

    return table(spark, sf_dir, "orders").select(
        k.alias("run_id"),
        unit.alias("base_unit"),
        F.when(k % 4 == 1, price * 100_000).otherwise(price).alias("training_goal"),
        pick(0.1, 0.05, 5000).alias("eval_interval"),
        pick(0.25, 10000, 0.1).alias("save_interval"),
        pick(0.005, 500, 0.01).alias("warmup_period"),
        pick(-1, 0.5, 90000).alias("lr_decay_period"),
        F.call_function("shiftleft", F.lit(512), (c % 3).cast("int")).cast("long").alias("block_size"),
        (c % 4 + 1).alias("__b"),
        (k % 4 + 1).alias("num_devices"),
        F.when(k % 5 == 0, 16).when(k % 5 == 1, 24).cast("long").alias("micro_batch_size"),
        F.when(k % 7 == 0, 2).otherwise(-1).cast("long").alias("gradient_accumulation_steps"),
    ).withColumn("batch_size", F.col("__b") * 64).drop("__b")


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as options set in layers; 99 is the command line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("k"), (F.col("l_partkey") % 5).cast("string")).alias("key"),
        F.when(F.col("l_linenumber") == 7, 99).otherwise(F.col("l_linenumber") - 1).cast("long").alias("layer"),
        F.col("l_suppkey").alias("seq"),
        F.col("l_extendedprice").alias("value"),
    )


def option_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as budget options set in layers, one or more per run."""
    kind = F.col("l_partkey") % 4
    key = F.get(
        F.array(*[F.lit(k) for k in ("training_goal", "batch_size", "micro_batch_size", "eval_interval")]), kind.cast("int")
    )
    value = (
        F.when(kind == 0, F.col("l_suppkey") * 1000 + 50)
        .when(kind == 1, (F.col("l_suppkey") % 8 + 1) * 16)
        .when(kind == 2, F.lit(16))
        .otherwise(F.col("l_suppkey") % 50 + 1)
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        key.alias("key"),
        F.when(F.col("l_linenumber") == 7, 99).otherwise(F.col("l_linenumber") - 1).cast("long").alias("layer"),
        F.col("l_suppkey").alias("seq"),
        value.cast("long").alias("value"),
    )


def cache_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as lookups of prepared datasets."""
    prints = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("base"),
        F.get(F.array(*[F.lit(p) for p in prints]), (F.col("c_custkey") % 5).cast("int")).alias("fingerprint"),
    )


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as datasets prepared before."""
    base = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        base.alias("base"),
        F.col("o_orderpriority").alias("fingerprint"),
        F.concat(base, F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderdate").alias("created"),
    )

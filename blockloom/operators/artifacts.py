"""Checkpoints and artifacts: names, retention, cache limits, references, aliases.

Deletions are reported as rows; nothing is deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fixed, int_div
from .ordering import group_value, running_sum

# Aliases that protect an artifact, and the prefix and form of references.
PROTECTED = ("best", "keep")
REF_PREFIX = "wandb:"
ARTIFACT_FORM = "model-%s:%s"

# Iterations of one run that are handled together.
ITER_RANGE = 65_536


def checkpoint_name(step: Column, samples: Column, tokens: Column, loss: Column) -> Column:
    """File name of a snapshot; counters are floats there."""
    return F.concat(
        F.lit("snap-"),
        step.cast("string"),
        F.lit("-samples-"),
        fixed(samples, 1),
        F.lit("-"),
        fixed(tokens, 1),
        F.lit("-loss-"),
        fixed(loss, 2),
    )


def _with_last(artifacts: DataFrame) -> DataFrame:
    # The largest iteration of the run, also for a run that saved a third of all checkpoints.
    span = int_div(F.col("iter"), F.lit(ITER_RANGE))
    return group_value(artifacts, {"__last": (F.max, F.col("iter"))}, ("run_id",), span)


def latest_only(artifacts: DataFrame) -> DataFrame:
    """Mark older checkpoints for deletion; the newest of each run stays."""
    return _with_last(artifacts).withColumn("delete", F.col("iter") < F.col("__last")).drop("__last")


def retention(artifacts: DataFrame, protected: Sequence[str] = PROTECTED) -> DataFrame:
    """Artifacts that carry none of the protecting aliases."""
    return artifacts.filter(~F.arrays_overlap("aliases", F.array(*[F.lit(a) for a in protected])))


def cache_trim(artifacts: DataFrame, limit_bytes: int, cache: str = "cache_id") -> DataFrame:
    """Keep the newest artifacts of each cache while their total stays within the limit."""
    newest_first = running_sum(
        artifacts,
        {"kept_bytes": F.col("size_bytes")},
        -F.col("created_us"),
        by=(cache,),
        tie=-F.col("artifact_id"),
    )
    return newest_first.withColumn("keep", F.col("kept_bytes") <= limit_bytes)


def parse_refs(refs: DataFrame, ref: str = "ref") -> DataFrame:
    """Split references into run and tag; plain paths pass through with neither."""
    parts = F.split(F.col(ref), ":")
    is_ref = F.col(ref).startswith(REF_PREFIX)
    tag = F.when(F.size(parts) == 3, F.get(parts, 2)).otherwise("latest")
    return (
        refs.dropDuplicates([ref])
        .withColumn("ref_run", F.when(is_ref, F.get(parts, 1)))
        .withColumn("ref_tag", F.when(is_ref, tag))
    )


def resolve_refs(refs: DataFrame, artifacts: DataFrame, ref: str = "ref") -> DataFrame:
    """Resolve each distinct reference once to the newest artifact with its run and tag."""
    by_alias = (
        artifacts.select("run_id", "artifact_id", "iter", F.explode("aliases").alias("ref_tag"))
        .groupBy(F.col("run_id").cast("string").alias("ref_run"), "ref_tag")
        .agg(F.max(F.struct("iter", "artifact_id")).alias("__hit"))
    )
    parsed = parse_refs(refs, ref)
    # Plain paths have no key; in the join they would all be one group.
    plain = parsed.filter(F.col("ref_run").isNull())
    found = parsed.filter(F.col("ref_run").isNotNull()).join(by_alias, ["ref_run", "ref_tag"], "left")
    named = found.select(
        ref,
        F.format_string(ARTIFACT_FORM, "ref_run", "ref_tag").alias("resolved"),
        F.col("__hit.artifact_id").alias("artifact_id"),
    )
    kind = by_alias.schema["__hit"].dataType["artifact_id"].dataType
    return named.unionByName(
        plain.select(ref, F.col(ref).alias("resolved"), F.lit(None).cast(kind).alias("artifact_id"))
    )


def final_aliases(artifacts: DataFrame) -> DataFrame:
    """Aliases after the end of a run: ``latest`` moves to the last checkpoint with ``train_end``."""
    last = F.col("iter") == F.col("__last")
    moved = F.when(last, F.array_union("aliases", F.array(F.lit("train_end"), F.lit("latest")))).otherwise(
        F.array_remove("aliases", "latest")
    )
    return _with_last(artifacts).withColumn("aliases", moved).drop("__last")

"""Collation: padding to the batch's width, labels of both objectives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import round_up
from ..functions.draws import draws, stream_id, threshold, uniform_id
from ..schemas import IGNORE_LABEL, SPECIALS

BATCH = ("split", "rank", "batch_idx")

# What filled positions hold, per column.
PAD_VALUES = {"input_ids": SPECIALS["pad"], "attention_mask": 0, "special_tokens_mask": 1, "labels": IGNORE_LABEL}

# Shares of the drawn positions, and the codes of what happens to them.
MASK_SHARE, RANDOM_SHARE = 0.8, 0.1
NONE, MASK, RANDOM, KEEP = 0, 1, 2, 3


def batch_width(df: DataFrame, length: Column, multiple: int | None = 8, by: Sequence[str] = BATCH) -> DataFrame:
    """Add ``width``: the longest row of the batch, rounded up to ``multiple`` if given.

    Meant for narrow rows of block ids and lengths, so that the blocks need not be brought
    together. A batch holds at most its batch size in rows, which bounds the window.
    """
    longest = F.max(length).over(Window.partitionBy(*by)).cast("long")
    return df.withColumn("width", round_up(longest, multiple) if multiple else longest)


def pad(df: DataFrame, columns: Sequence[str] = ("input_ids", "attention_mask", "special_tokens_mask")) -> DataFrame:
    """Fill list columns up to the row's ``width``."""
    for c in columns:
        gap = F.greatest(F.col("width") - F.size(c), F.lit(0)).cast("int")
        df = df.withColumn(c, F.concat(F.col(c), F.array_repeat(F.lit(PAD_VALUES[c]), gap)))
    return df


def labels_clm(df: DataFrame, pad_id: int = SPECIALS["pad"]) -> DataFrame:
    """Causal labels: the ids themselves, padding ignored."""
    labels = F.transform("input_ids", lambda x: F.when(x == pad_id, F.lit(IGNORE_LABEL)).otherwise(x))
    return df.withColumn("labels", labels)


def labels_mlm(
    df: DataFrame,
    vocab_size: int,
    p: float = 0.15,
    seed: int = 0,
    epoch: int = 0,
    keys: Sequence[str] = ("split", "shard", "batch", "blk"),
    mask_id: int = SPECIALS["mask"],
) -> DataFrame:
    """Masked objective: add ``labels`` and ``actions`` and replace ids, one draw per position.

    Draws depend on seed, epoch, block and position only: an epoch can be rebuilt exactly, two
    epochs differ, and no row moves. Arrays enter the functions zipped; one that is referred to
    from inside would be rebuilt for every position.
    """
    stream = stream_id(seed, epoch, *[F.col(k) for k in keys])
    special = F.col("special_tokens_mask")
    to_mask, to_random, to_keep = (
        F.lit(threshold(share * p)) for share in (MASK_SHARE, MASK_SHARE + RANDOM_SHARE, 1.0)
    )

    def act(c: Column) -> Column:
        untouched = (c["draw"] >= to_keep) | (c["special"] != 0)
        return F.when(untouched, NONE).when(c["draw"] < to_mask, MASK).when(c["draw"] < to_random, RANDOM).otherwise(KEEP)

    def label(x: Column, action: Column) -> Column:
        return F.when(action == NONE, F.lit(IGNORE_LABEL)).otherwise(x)

    def replace(c: Column, i: Column) -> Column:
        stays = (c["action"] == NONE) | (c["action"] == KEEP)
        return (
            F.when(stays, c["id"])
            .when(c["action"] == MASK, F.lit(mask_id))
            .otherwise(uniform_id(stream, i, vocab_size))
        )

    marked = F.arrays_zip(special.alias("special"), draws(stream, F.size(special)).alias("draw"))
    acted = df.withColumn("actions", F.transform(marked, act))
    changed = F.arrays_zip(F.col("input_ids").alias("id"), F.col("actions").alias("action"))
    return acted.withColumn("labels", F.zip_with("input_ids", "actions", label)).withColumn(
        "input_ids", F.transform(changed, replace)
    )


def mask_stats(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Positions per action, specials apart; counted inside each block, so no row is made per token."""
    codes = F.zip_with("actions", "special_tokens_mask", lambda a, s: a * 2 + s)
    coded = df.select(*by, codes.alias("codes"))

    def found(code: int) -> Column:
        return F.size(F.filter("codes", lambda c: c == code)).cast("long")

    sums = coded.groupBy(*by).agg(*[F.sum(found(code)).alias(f"c{code}") for code in range(8)])
    kinds = [
        F.struct(F.lit(c // 2).alias("action"), F.lit(c % 2).alias("special"), F.col(f"c{c}").alias("positions"))
        for c in range(8)
    ]
    return sums.select(*by, F.inline(F.array(*kinds))).filter("positions > 0")


def objective(df: DataFrame, name: str, **options) -> DataFrame:
    """Labels by the run's objective: ``clm`` or ``mlm``."""
    if name == "clm":
        return labels_clm(df)
    if name == "mlm":
        return labels_mlm(df, **options)
    raise ValueError(f"unknown objective {name!r}")

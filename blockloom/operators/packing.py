"""Packing: documents in row order → shards → batches of rows → blocks of equal length.

A batch of rows is a contiguous interval of the order key. A pass over the narrow key column
finds where the batches begin; documents then look their batch up, so the payload moves through
one shuffle only, by ``(split, shard, batch)``, which serves both the running offsets and the
assembly of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_split, int_div
from ..schemas import PACK_BATCH_ROWS
from .ordering import BUCKET, bucket_expr, cuts_of_sample, default_buckets, dense_index, running_sum, upper_bound

GROUP = ("split", "shard", "batch")

# Bounds of the batch lookup: about 64 MB in all, and short lists to search.
MAX_BROADCAST_STARTS = 2_000_000
MAX_STARTS_PER_BUCKET = 1024

# Tokens that are gathered in one piece before they are cut into blocks.
SPAN_TOKENS = 1 << 17


def shard_of(idx: Column, total: Column, n_shards: int) -> Column:
    """Contiguous shards, the first ``total % n`` of them one row longer; never more than rows."""
    n = F.least(F.lit(n_shards).cast("long"), F.greatest(total, F.lit(1)))
    small = int_div(total, n)
    extra = F.pmod(total, n)
    cut = extra * (small + 1)
    return (
        F.when(idx < cut, int_div(idx, small + 1))
        .otherwise(extra + int_div(idx - cut, F.greatest(small, F.lit(1))))
        .cast("long")
    )


def shard_start(shard: Column, total: Column, n_shards: int) -> Column:
    """Row position at which a shard begins."""
    n = F.least(F.lit(n_shards).cast("long"), F.greatest(total, F.lit(1)))
    small = int_div(total, n)
    extra = F.pmod(total, n)
    return shard * small + F.least(shard, extra)


def shard_contiguous(df: DataFrame, total: Column, n_shards: int, idx: str = "row_idx") -> DataFrame:
    """Add ``shard`` to indexed rows."""
    return df.withColumn("shard", shard_of(F.col(idx), total, n_shards))


def map_batches(
    df: DataFrame, total: Column, n_shards: int, batch_rows: int = PACK_BATCH_ROWS, idx: str = "row_idx"
) -> DataFrame:
    """Add ``batch``: runs of ``batch_rows`` rows within a shard, the last one possibly short."""
    start = shard_start(F.col("shard"), total, n_shards)
    return df.withColumn("batch", int_div(F.col(idx) - start, F.lit(batch_rows)))


def _key_stats(df: DataFrame, key: str, buckets: int | None) -> tuple[dict[str, int], list]:
    """Rows per split and shared cut points of the key, from counts and a bounded sample."""
    counts = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    n = buckets or default_buckets(df.sparkSession, rows)
    return counts, cuts_of_sample(df.select(key), 1, n, rows)[0] if n > 1 else []


def index_batches(
    df: DataFrame, key: str, n_shards: int, batch_rows: int = PACK_BATCH_ROWS, buckets: int | None = None
) -> DataFrame:
    """``(split, key, row_idx, shard, batch)`` for every row; narrow, no payload."""
    totals, cuts = _key_stats(df, key, buckets)
    return _index_narrow(df, key, n_shards, batch_rows, totals, cuts).drop(BUCKET + "_k")


def _index_narrow(df, key, n_shards, batch_rows, totals, cuts) -> DataFrame:
    narrow = df.select("split", key).withColumn(BUCKET + "_k", bucket_expr(F.col(key), cuts))
    idx = dense_index(narrow, F.col(key), by=("split",), bucket=F.col(BUCKET + "_k"))
    total = by_split(F.col("split"), totals)
    return map_batches(shard_contiguous(idx, total, n_shards), total, n_shards, batch_rows)


def assign_batches(
    df: DataFrame, key: str, n_shards: int, batch_rows: int = PACK_BATCH_ROWS, buckets: int | None = None
) -> DataFrame:
    """Add ``shard`` and ``batch`` to whole documents without moving them.

    ``key`` is a unique numeric order key. The lookup table has one row per ``(split, bucket)``
    with the batches that begin in it. The row counts tell its size beforehand: within fixed
    bounds it is broadcast and documents stay where they are; beyond them (very small batches)
    documents are joined with the narrow index by key.
    """
    totals, cuts = _key_stats(df, key, buckets)
    index = _index_narrow(df, key, n_shards, batch_rows, totals, cuts)
    starts = sum(n // batch_rows + n_shards + len(cuts) + 1 for n in totals.values())
    if starts > min(MAX_BROADCAST_STARTS, MAX_STARTS_PER_BUCKET * (len(cuts) + 1) * max(len(totals), 1)):
        return df.join(index.select("split", key, "shard", "batch"), ["split", key])
    lookup = (
        index.groupBy("split", BUCKET + "_k", "shard", "batch")
        .agg(F.min(key).alias("first_key"))
        .groupBy("split", F.col(BUCKET + "_k").alias(BUCKET))
        .agg(F.sort_array(F.collect_list(F.struct("first_key", "shard", "batch"))).alias("__starts"))
    )
    hit = F.get(F.col("__starts"), upper_bound(F.col(key), F.col("__starts"), field="first_key") - 1)
    return (
        df.withColumn(BUCKET, bucket_expr(F.col(key), cuts))
        .join(F.broadcast(lookup), ["split", BUCKET])
        .withColumn("__hit", hit)
        .withColumn("shard", F.col("__hit.shard"))
        .withColumn("batch", F.col("__hit.batch"))
        .drop(BUCKET, "__starts", "__hit")
    )


def pack(
    df: DataFrame,
    block_size: int,
    order: str,
    columns: Sequence[str] = ("input_ids",),
    by: Sequence[str] = GROUP,
) -> DataFrame:
    """Concatenate list columns over each batch and cut them into blocks.

    The unfilled tail of a batch is dropped, except that a batch shorter than one block gives one
    short block. Returns ``by``, ``blk`` and the cut columns; all of them are cut alike.

    Pieces of documents are gathered per span of many blocks and the span is cut: documents are
    rarely cut twice, and a span stays at a few hundred kilobytes, however large the batch is.
    """
    if block_size <= 0:
        raise ValueError("block_size must be positive")
    size = F.lit(block_size).cast("long")
    span = max(1, SPAN_TOKENS // block_size)
    reach = F.lit(block_size * span).cast("long")
    running = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        df.select(*by, order, *columns)
        .withColumn("__n", F.size(columns[0]).cast("long"))
        .withColumn("__end", F.sum("__n").over(running))
        .withColumn("__start", F.col("__end") - F.col("__n"))
        # After the window: below it, the filter would evaluate the tokenizer a second time.
        .filter("__end > __start")
    )
    pieces = placed.select(
        *by,
        *columns,
        "__start",
        "__end",
        F.explode(F.sequence(int_div(F.col("__start"), reach), int_div(F.col("__end") - 1, reach))).alias("__span"),
    )
    lo = F.greatest(F.col("__start"), F.col("__span") * reach)
    hi = F.least(F.col("__end"), (F.col("__span") + 1) * reach)
    skip = (lo - F.col("__start") + 1).cast("int")
    take = (hi - lo).cast("int")
    cut = pieces.select(
        *by,
        "__span",
        take.alias("__take"),
        F.struct(lo.alias("lo"), *[F.slice(c, skip, take).alias(c) for c in columns]).alias("__piece"),
    )
    joined = cut.groupBy(*by, "__span").agg(
        F.sort_array(F.collect_list("__piece")).alias("__pieces"), F.sum("__take").alias("__len")
    )
    # Only the last block of a batch can be short; it is kept iff it is the only one.
    blocks = F.when(F.col("__len") >= size, int_div(F.col("__len"), size)).otherwise(F.lit(1)).cast("int")
    kept = joined.filter((F.col("__len") >= size) | (F.col("__span") == 0))
    flat = kept.select(
        *by, "__span", blocks.alias("__blocks"), *[F.flatten(F.col(f"__pieces.{c}")).alias(c) for c in columns]
    )
    numbered = flat.select(
        *by, "__span", *columns, F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__k")
    )
    return numbered.select(
        *by,
        (F.col("__span") * span + F.col("__k")).alias("blk"),
        *[F.slice(c, F.col("__k") * block_size + 1, block_size).alias(c) for c in columns],
    )


def batch_totals(df: DataFrame, n_tokens: str = "n_tokens", by: Sequence[str] = GROUP) -> DataFrame:
    """Rows and tokens per batch, summed before the shuffle."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.col(n_tokens).cast("long")).alias("tokens"),
        F.min(n_tokens).cast("long").alias("min_len"),
        F.max(n_tokens).cast("long").alias("max_len"),
    )


def blocks_in(tokens: Column, block_size: Column | int) -> Column:
    """Number of blocks that packing makes of a batch total."""
    size = F.lit(block_size).cast("long") if isinstance(block_size, int) else block_size
    return F.when(tokens >= size, int_div(tokens, size)).when(tokens > 0, 1).otherwise(0).cast("long")


def pack_loss(totals: DataFrame, block_size: int, by: Sequence[str] = GROUP) -> DataFrame:
    """Tokens that packing drops, per batch."""
    size = F.lit(block_size).cast("long")
    lost = F.when(F.col("tokens") >= size, F.pmod(F.col("tokens"), size)).otherwise(0).cast("long")
    return totals.select(*by, "tokens", blocks_in(F.col("tokens"), block_size).alias("blocks"), lost.alias("dropped"))


def pack_validate(blocks: DataFrame, columns: Sequence[str], by: Sequence[str] = ("split",)) -> DataFrame:
    """Histogram of block lengths, and how many blocks have columns of unequal length."""
    length = F.size(columns[0])
    uneven = F.lit(False)
    for c in columns[1:]:
        uneven = uneven | (F.size(c) != length)
    return (
        blocks.groupBy(*by, length.cast("long").alias("length"))
        .agg(F.count(F.lit(1)).alias("blocks"), F.sum(uneven.cast("long")).alias("uneven"))
    )


def _first_block(totals: DataFrame, block_size: int) -> DataFrame:
    # Blocks are numbered by shard, batch and place in the batch, as the shards are written. The
    # count is carried from shard to shard, so no task sees the batches of a whole split.
    counted = totals.withColumn("__blocks", blocks_in(F.col("tokens"), block_size))
    upto = running_sum(counted, {"__upto": F.col("__blocks")}, F.col("batch"), by=("split",), bucket=F.col("shard"))
    return upto.withColumn("__first", F.col("__upto") - F.col("__blocks"))


def index_blocks(totals: DataFrame, block_size: int) -> DataFrame:
    """One narrow row per block: dense ``block_idx`` in the split and ``length``, from totals alone."""
    size = F.lit(block_size).cast("long")
    placed = _first_block(totals, block_size).filter("__blocks > 0")
    rows = placed.select(
        *GROUP, "tokens", "__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("blk")
    )
    return rows.select(
        *GROUP,
        "blk",
        (F.col("__first") + F.col("blk")).alias("block_idx"),
        F.least(size, F.col("tokens") - F.col("blk") * size).alias("length"),
    )


def block_counts(totals: DataFrame, block_size: int) -> DataFrame:
    """Blocks per split, as ``n``."""
    return totals.groupBy("split").agg(F.sum(blocks_in(F.col("tokens"), block_size)).alias("n"))


def number_rows(narrow: DataFrame) -> DataFrame:
    """Add ``block_idx`` to narrow block rows ``(GROUP, blk, …)`` from their own counts per batch."""
    counts = narrow.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("__blocks"))
    upto = running_sum(counts, {"__upto": F.col("__blocks")}, F.col("batch"), by=("split",), bucket=F.col("shard"))
    first = upto.select(*GROUP, (F.col("__upto") - F.col("__blocks")).alias("__first"))
    return narrow.join(first, list(GROUP)).withColumn("block_idx", F.col("__first") + F.col("blk")).drop("__first")


def number_blocks(blocks: DataFrame, totals: DataFrame, block_size: int) -> DataFrame:
    """Add ``block_idx`` to packed blocks, joined on the keys that already place them."""
    first = _first_block(totals, block_size).select(*GROUP, "__first")
    return blocks.join(first, list(GROUP)).withColumn("block_idx", F.col("__first") + F.col("blk")).drop("__first")

"""Packing a stream as if it were one batch: the open remainder of every shard is kept as state.

A shard's documents are concatenated in the order in which they arrive, within a micro-batch by key, and
cut into blocks. What does not fill a block stays in the state store, with the number of the next block, and
the next micro-batch goes on from there. State and output commit together: after a restart from the same checkpoint
nothing is lost or repeated, and however the documents were dealt to micro-batches, the blocks are
those of one batch job over all of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.tokens import tokenize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ("input_ids", "special_tokens_mask")
# As they are held until a shard is cut.
KINDS = (np.int32, np.int8)
OPEN = "blk long, input_ids array<int>, special_tokens_mask array<int>"
BLOCKS = "split string, shard long, blk long, input_ids array<int>, special_tokens_mask array<int>"
# State stores that can keep arbitrary state.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Blocks handed to Spark at a time.
BATCH_BLOCKS = 256


class CarryPacker(StatefulProcessor):
    """Cuts one ``(split, shard)`` into blocks and keeps what is left over."""

    def __init__(self, block_size: int):
        self.block_size = block_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        blk, held = 0, [np.zeros(0, np.int32) for _ in COLUMNS]
        if self.open.exists():
            blk, *held = self.open.get()
        # The documents of one shard in one micro-batch, five bytes a token: rows are let go as they come.
        orders, counts, flat = [], [], [[np.asarray(h, t)] for h, t in zip(held, KINDS)]
        for some in rows:
            orders.append(some["order"].reset_index(drop=True))
            counts.append(some[COLUMNS[0]].map(len).to_numpy(np.int64))
            for column, kind, name in zip(flat, KINDS, COLUMNS):
                column.append(np.concatenate([np.zeros(0, kind), *some[name]]).astype(kind))
        place = pd.concat(orders, ignore_index=True).sort_values(kind="stable").index.to_numpy()
        # What was open comes first.
        count = np.concatenate([[len(flat[0][0])], np.concatenate(counts)[place]])
        begin = np.concatenate([[len(flat[0][0])], np.concatenate(counts)])
        begin = np.concatenate([[0], (np.cumsum(begin) - begin)[1:][place]])
        ends = np.cumsum(count)
        for i, pieces in enumerate(flat):
            # One column after the other, so that only one is there twice.
            flat[i] = np.concatenate(pieces)

        def cut(low: int, high: int) -> list[np.ndarray]:
            """The tokens ``low … high - 1`` of the shard, in order."""
            first, last = np.searchsorted(ends, [low, high - 1], side="right") if low < high else (0, -1)
            docs = np.arange(first, last + 1)
            start = np.maximum(low - (ends[docs] - count[docs]), 0)
            size = np.minimum(ends[docs], high) - (ends[docs] - count[docs]) - start
            at = np.repeat(begin[docs] + start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            return [x[at].astype(np.int32) for x in flat]

        size, total = self.block_size, int(ends[-1])
        full = total // size
        self.open.update((int(blk) + full, *[x.tolist() for x in cut(full * size, total)]))
        for low in range(0, full, BATCH_BLOCKS):
            n = min(BATCH_BLOCKS, full - low)
            blocks = [list(x.reshape(n, size)) for x in cut(low * size, (low + n) * size)]
            numbers = [int(blk) + low + i for i in range(n)]
            yield pd.DataFrame({"split": key[0], "shard": key[1], "blk": numbers, **dict(zip(COLUMNS, blocks))})

    def close(self) -> None:
        pass


def shard_by_key(key: Column, n_shards: int) -> Column:
    """A shard that does not depend on how many documents there will be."""
    return F.pmod(key, F.lit(n_shards)).cast("long")


def stream_pack_carry(
    docs: DataFrame, vocab: pa.Table, out: str, checkpoint: str, block_size: int, n_shards: int, key: str = "doc_id"
) -> StreamingQuery:
    """Pack a stream ``(split, key, text)``; only full blocks are written, each once.

    A shard's rows of one micro-batch are held by one task, at five bytes a token: more shards or smaller micro-batches
    make them fewer.
    A null split is a split of its own, documents without a key share shard 0.
    """
    if block_size <= 0 or n_shards <= 0:
        raise ValueError("block_size and n_shards must be positive")
    placed = docs.select(
        "split", F.coalesce(shard_by_key(F.col(key), n_shards), F.lit(0).cast("long")).alias("shard"), F.col(key).alias("order"), "text"
    )
    tokens = tokenize(placed, vocab).select("split", "shard", "order", *COLUMNS)
    blocks = tokens.groupBy("split", "shard").transformWithStateInPandas(
        CarryPacker(block_size), outputStructType=BLOCKS, outputMode="Append", timeMode="None"
    )
    conf = docs.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        writer = blocks.writeStream.format("parquet").outputMode("append").option("path", out)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def open_remainders(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(split, shard, blk, input_ids, special_tokens_mask)``: what no block holds yet, read from the state."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return state.select("key.split", "key.shard", "value.*")


def finished_blocks(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """All blocks of a stream that has ended: as in a batch job, a remainder is a short block if it is
    all that its shard has, and is dropped otherwise."""
    full = spark.read.schema(BLOCKS).parquet(out)
    alone = open_remainders(spark, checkpoint).filter((F.col("blk") == 0) & (F.size("input_ids") > 0))
    return full.unionByName(alone.select(*full.columns))

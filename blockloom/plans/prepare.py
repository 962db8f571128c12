"""The preparation job: named inputs to a prepared, reusable dataset of blocks."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import int_div
from ..operators import collate, loading
from ..operators.packing import GROUP, assign_batches, number_rows, pack
from ..operators.tokens import attention_mask, tokenize, tokenize_with_file
from ..schemas import PACK_BATCH_ROWS, SPECIALS
from ..session import stored
from ..sources.prepared import (
    cache_key,
    find_prepared,
    fingerprint,
    input_entries,
    input_identity,
    load_prepared,
    save_prepared,
)
from ..sources.readers import named_splits, read_corpus, spread
from ..sources.store import PreparedStore

COLUMNS = ("input_ids", "special_tokens_mask")


def pack_documents(
    docs: DataFrame,
    tokenizer: pa.Table | str,
    key: str,
    block_size: int,
    n_shards: int,
    batch_rows: int = PACK_BATCH_ROWS,
    bos: int | None = SPECIALS["bos"],
    eos: int | None = SPECIALS["eos"],
) -> DataFrame:
    """Documents ``(split, key, text)`` to blocks; the tokenizer is a vocabulary or a JSON text.

    ``bos`` and ``eos`` belong to a vocabulary; a serialized tokenizer has its own.
    """
    placed = spread(assign_batches(docs.select("split", key, "text"), key, n_shards, batch_rows), key)
    return _pack_placed(placed, tokenizer, block_size, key, bos, eos)


def _pack_placed(
    placed: DataFrame,
    tokenizer: pa.Table | str,
    block_size: int,
    key: str,
    bos: int | None = SPECIALS["bos"],
    eos: int | None = SPECIALS["eos"],
) -> DataFrame:
    """``(split, shard, batch, key, text)`` to blocks."""
    if isinstance(tokenizer, str):
        return pack(tokenize_with_file(placed, tokenizer), block_size, key, COLUMNS)
    tokens = tokenize(placed, tokenizer, bos=bos, eos=eos)
    added = [i for i in (bos, eos) if i is not None]
    if pc.any(pc.is_in(tokenizer["id"], pa.array(added, pa.int32()))).as_py():
        return pack(tokens, block_size, key, COLUMNS)
    # No word has the id of a special token, so the mask follows from the ids: it need not be
    # shuffled and sorted along with them.
    blocks = pack(tokens, block_size, key, COLUMNS[:1])
    mask = F.transform("input_ids", lambda x: x.isin(added).cast("int") if added else F.lit(0))
    return blocks.withColumn("special_tokens_mask", mask)


def prepare(
    spark: SparkSession,
    inputs: dict[str, str],
    root: str,
    tokenizer: pa.Table | str,
    tokenizer_name: str,
    block_size: int,
    n_shards: int | None = None,
    batch_rows: int = PACK_BATCH_ROWS,
    force_rebuild: bool = False,
    prepare_only: bool = False,
) -> DataFrame | None:
    """Reuse or build the prepared dataset of these inputs and return it.

    ``force_rebuild`` ignores what is stored and makes a new version beside it, which takes its place when it is
    complete; ``prepare_only`` stops after the data is in place.
    """
    n_shards = n_shards or spark.sparkContext.defaultParallelism
    content = tokenizer if isinstance(tokenizer, str) else tokenizer.to_pydict()
    key = cache_key(
        fingerprint(tokenizer=content),
        inputs=inputs,
        block_size=block_size,
        tokenizer_name=tokenizer_name,
        n_shards=n_shards,
        batch_rows=batch_rows,
        identity=input_identity(spark, inputs),
    )
    path, _ = (None, False) if force_rebuild else find_prepared(spark, root, key)
    if path is None:
        path = f"{root.rstrip('/')}/{key}"
        blocks = pack_documents(named_splits(spark, inputs), tokenizer, "row_idx", block_size, n_shards, batch_rows)
        save_prepared(blocks, path, overwrite=True)
    if prepare_only:
        return None
    return load_prepared(spark, path)


def prepare_incremental(
    spark: SparkSession,
    inputs: dict[str, str],
    root: str,
    tokenizer: pa.Table | str,
    tokenizer_name: str,
    block_size: int,
    batch_rows: int = PACK_BATCH_ROWS,
    fmt: str | None = None,
    force_rebuild: bool = False,
    prepare_only: bool = False,
) -> DataFrame | None:
    """Prepare what was added or changed since the last call, and return the whole dataset.

    An input is a folder; each file or folder in it is an *entry*, packed by itself: ``shard`` is its number in the
    dataset and batches are runs of its rows, so its blocks depend on nothing else. New and changed entries are
    packed in one job, entries that are gone are left out, and one commit changes from the old version to
    the new one. Entries are some hundreds per call; rows are not limited.
    """
    content = tokenizer if isinstance(tokenizer, str) else tokenizer.to_pydict()
    applied = dict(inputs=inputs, block_size=block_size, tokenizer_name=tokenizer_name, batch_rows=batch_rows, n_shards=0)
    key = cache_key(fingerprint(tokenizer=content), incremental=True, **applied)
    store = PreparedStore(spark, f"{root.rstrip('/')}/{key}")
    before = store.manifest()
    held = {(e["split"], e["entry"]): e for e in before["entries"]} if before else {}
    there = input_entries(spark, inputs)
    stale = sorted(k for k, digest in there.items() if force_rebuild or k not in held or held[k]["digest"] != digest)
    if before is None or stale or set(held) - set(there):
        # An entry keeps its number for good.
        free = max([e["shard"] for e in held.values()], default=-1) + 1
        number = {k: held[k]["shard"] if k in held else free + i for i, k in enumerate(sorted(stale, key=lambda k: k in held))}
        docs = [
            read_corpus(spark, path, fmt).select(
                F.lit(split).alias("split"),
                F.lit(number[split, path]).cast("long").alias("shard"),
                int_div(F.col("row_idx"), F.lit(batch_rows)).alias("batch"),
                "row_idx",
                "text",
            )
            for split, path in stale
        ]
        entries = [e for k, e in held.items() if k in there and k not in number]
        schema = StructType.fromJson(before["schema"]) if before else None
        if docs:
            blocks = _pack_placed(reduce(DataFrame.unionByName, docs), tokenizer, block_size, "row_idx")
            blocks = blocks.withColumn("length", F.size("input_ids").cast("long"))
            schema = blocks.schema
            part = store.write(blocks, ("split", "shard"))
            folder = part["folder"]
            rows = spark.read.schema(schema).parquet(f"{store.path}/{folder}")
            counts = {r["shard"]: r for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t")).collect()}
            for split, path in stale:
                shard = number[split, path]
                known = counts.get(shard)
                entries.append({
                    "split": split, "entry": path, "digest": there[split, path], "shard": shard,
                    "folder": f"{folder}/split={split}/shard={shard}" if known else None,
                    "blocks": known["n"] if known else 0, "tokens": known["t"] if known else 0,
                })
        if schema is not None:
            store.commit(entries, schema, before["version"] if before else None)
    return None if prepare_only else store.load()


def store_blocks(spark: SparkSession, blocks: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Store packed blocks with their length, once and where packing left them.

    They are clustered by ``(split, shard, batch)``, as packing has them already, so writing moves nothing. What feeds
    a consumer starts from here: positions are worked out on narrow columns, and neither texts nor blocks
    are read for them. What was observed while writing is in the manifest.
    """
    store = PreparedStore(spark, path)
    sized = blocks.withColumn("length", F.size("input_ids").cast("long"))
    entry = store.write_clustered(sized, GROUP, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    store.commit([entry], sized.schema, None)
    return store.load()


def feed(
    blocks: DataFrame,
    seed: int,
    epoch: int,
    world: int,
    micro: int,
    objective: str | None = None,
    multiple: int | None = 8,
    **options,
) -> DataFrame:
    """Batches of every rank for both splits, padded and, with an objective, labelled.

    ``train`` comes in the order of the epoch, every other split in its own. Numbers, order, ranks and
    widths are worked out on narrow rows and brought to the stored blocks where these are: broadcast if they are
    few; otherwise they go to the blocks' buckets, if the session lets joins use a part of their keys
    (``spark.sql.requireAllClusterKeysForCoPartition`` off).
    """
    keys = [*GROUP, "blk"]
    # Read several times below, so it is written down once: five numbers a block.
    narrow = stored(number_rows(blocks.select(*keys, "length")), "block-numbers")
    train = loading.shuffle(narrow.filter(F.col("split") == "train"), seed, epoch)
    rest = narrow.filter(F.col("split") != "train").withColumn("pos", F.col("block_idx"))
    counts = narrow.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    dealt = loading.shard_by_rank(train.unionByName(rest, allowMissingColumns=True), world, counts=counts)
    placed = collate.batch_width(loading.batches(dealt, micro), F.col("length"), multiple)
    wide = blocks.drop("length").join(placed.select(*keys, "rank", "batch_idx", "slot", "width"), keys)
    padded = collate.pad(wide.withColumn("attention_mask", attention_mask(F.col("input_ids"))))
    if objective == "mlm":
        options = {"seed": seed, "epoch": epoch} | options
    return collate.objective(padded, objective, **options) if objective else padded

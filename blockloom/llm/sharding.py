"""Shards by a hierarchical weighted hash tree.

The tree has regions, racks and shards, each with the weight of what lies below it. A row descends
from the top: at every level each child draws an exponential number with its weight as the rate, from a
hash of the row's key and the child's own path, and the smallest one wins. So a child gets rows in
proportion to its weight, and the draws of one child do not depend on any other. If weights below one
region change, rows only move into or out of that region, or inside it; the same holds for racks.

A shard that is added as a *graft* draws against the regions at the top. Its own draw is the only new
one, so it takes rows only into itself, whatever else the tree looks like. Trees are values that fit
into a plan: some thousand shards at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from ..session import stored
from .rows import ROW

# Bits of a draw, and bytes that one file of a shard should hold.
DRAW_BITS = 60
FILE_BYTES = 512 << 20
NO_KEY = -(2**63)


@dataclass(frozen=True)
class ShardTree:
    """``weights[region][rack][shard]``, numbers from 0 in this order, and grafts numbered after them.

    Weights are 0 or more and one must be above 0. A weight of 0 keeps a number without giving it rows.
    """

    weights: tuple[tuple[tuple[float, ...], ...], ...]
    grafts: tuple[float, ...] = ()

    def __post_init__(self):
        every = [*(w for region in self.weights for rack in region for w in rack), *self.grafts]
        if any(not 0 <= w < float("inf") for w in every) or not any(w > 0 for w in every):
            raise ValueError("weights must be finite and 0 or more, and one of them above 0")

    @staticmethod
    def even(regions: int, racks: int, shards: int, weight: float = 1.0) -> ShardTree:
        return ShardTree((((weight,) * shards,) * racks,) * regions)

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region) + len(self.grafts)

    def with_shard(self, weight: float = 1.0) -> ShardTree:
        """The tree with one more shard, numbered last: rows move only into it."""
        return replace(self, grafts=(*self.grafts, weight))

    def with_weight(self, region: int, rack: int, shard: int, weight: float) -> ShardTree:
        """The tree with another weight of one shard: rows move only into or out of, or inside, its region."""
        changed = [[list(k) for k in r] for r in self.weights]
        changed[region][rack][shard] = weight
        return replace(self, weights=tuple(tuple(tuple(k) for k in r) for r in changed))

    def place(self, key: Column) -> Column:
        """The shard number of a key; keys of any type count by their text, a null key as the empty text."""
        text = F.coalesce(key.cast("string"), F.lit(""))
        weights = [[[float(w) for w in rack] for rack in region] for region in self.weights]
        sums = [[sum(rack) for rack in region] for region in weights]
        first, at = [], 0
        for region in self.weights:
            first.append([])
            for rack in region:
                first[-1].append(at)
                at += len(rack)
        top = [*map(sum, sums), *map(float, self.grafts)]
        names = [*(str(i) for i in range(len(sums))), *(f"+{i}" for i in range(len(self.grafts)))]
        region = _winner(text, _array(top), lambda i: F.get(_array(names), i))
        rack = _winner(text, F.get(_array(sums), region), lambda i: F.concat_ws(".", region, i))
        below = F.get(F.get(_array(weights), region), rack)
        shard = _winner(text, below, lambda i: F.concat_ws(".", region, rack, i))
        graft = region - len(sums) + at
        return F.when(region >= len(sums), graft).otherwise(F.get(F.get(_array(first), region), rack) + shard).cast("int")


def _array(values: Sequence) -> Column:
    if isinstance(values, (list, tuple)):
        return F.array(*[_array(v) for v in values])
    return F.lit(values)


def _winner(key: Column, weights: Column, path) -> Column:
    """The child whose exponential draw is smallest; children without weight do not draw."""

    def draw(w: Column, i: Column) -> Column:
        digest = F.md5(F.concat_ws("|", key, path(i)))
        u = (F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long") + 0.5) / F.lit(float(1 << DRAW_BITS))
        return F.when(w > 0, F.struct((-F.ln(u) / w).alias("draw"), i.alias("child")))

    return F.array_min(F.transform(weights, draw))["child"]


def text_size(text: Column) -> Column:
    """Bytes of a text in UTF-8, none for null, plus 16 for its row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def assign_shards(docs: DataFrame, tree: ShardTree, grown: ShardTree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, crc, shard, slot, grown)`` per row.

    ``slot`` numbers the rows of a shard from 0 without gaps, by key and then in the order of the
    input; ``grown`` is the shard in another tree, null without one.

    Nulls: a null key is placed like the empty text and numbered first; a null text has no bytes and the
    checksum of none. Rows with the same key share a shard (key and tree alone decide); repeated rows get
    slots of their own. Very long texts are read for their size and checksum only. Other columns, also
    ones with the names of new ones, are ignored. An empty table gives an empty one.
    """
    at = tree.place(F.col(key))
    after = grown.place(F.col(key)) if grown else F.lit(None).cast("int")
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(
        F.monotonically_increasing_id().alias(ROW), F.col(key).alias("key"), text_size(F.col(text)).alias("size"),
        crc.alias("crc"), at.alias("shard"), after.alias("grown"),
    )
    # Narrow rows; ids of rows settle equal keys, so they are written down before they are sorted.
    narrow = stored(rows, "shard-rows")
    order = F.coalesce(F.col("key"), F.lit(NO_KEY)) if dict(rows.dtypes)["key"] == "bigint" else F.xxhash64("key")
    numbered = dense_index(narrow, order, by=["shard"], tie=F.col(ROW), out="slot")
    return numbered.select(F.col("key").alias(key), "size", "crc", "shard", "slot", "grown")


def movement(assigned: DataFrame) -> DataFrame:
    """``(shard, grown, n_rows, n_bytes)``: what moves between two trees, and what stays."""
    return assigned.groupBy("shard", "grown").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))


def write_shards(docs: DataFrame, path: str, tree: ShardTree, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write whole rows as Parquet into one folder per shard, about ``file_bytes`` of text per file.

    Rows of a shard are dealt to its files by their place in the input, so that no key fills one file. Rows
    keep all columns; one named ``shard`` is replaced. An empty table gives an empty folder.
    """
    total = docs.agg(F.sum(text_size(F.col(text)))).first()[0] or 0
    files = max(1, -(-total // (file_bytes * tree.shards)))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files))
    placed = docs.withColumn("shard", tree.place(F.col(key))).withColumn(ROW, part)
    dealt = placed.repartition(tree.shards * files, "shard", ROW).drop(ROW)
    dealt.write.partitionBy("shard").parquet(path)

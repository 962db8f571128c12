"""Exact dedup by a minimal perfect hash over the distinct digests of earlier texts.

The store of earlier texts is cut into shards by digest. A shard is one row: a minimal perfect
hash (levels of bit maps) over its digests, and slots that hold the full digest, the winner's
locator and the number of copies. New rows are grouped by digest first, so a text that a third of
all rows share is one row; a lookup then compares all 32 bytes of the digest in the slot it
arrives at. Members join the group in the slot, nonmembers are grouped by themselves.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Digests per shard: a shard of the store is about 60 bytes times as large.
SHARD_DIGESTS = 1 << 16
# Bits per key of a level; more bits, fewer levels.
GAMMA = 2
MAX_LEVELS = 64


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of the first 16 bytes of each digest, another one for every level."""
    with np.errstate(over="ignore"):
        h = keys[:, 0] ^ (keys[:, 1] * np.uint64(2 * level + 1)) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def _keys(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :16]).view(np.uint64).reshape(-1, 2)


def build_hash(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit maps of the levels, and the digests in the order of their slots.

    On each level a key that is alone at its bit sets it; the others go on to the next level. The
    slot of a key is the number of set bits before its own, so n keys fill exactly n slots.
    ``digests`` are distinct rows of 32 bytes. Keys left after the last level (equal in their
    first 16 bytes, or very unlucky) follow in the last slots and are compared one by one.
    """
    left, levels, placed = np.arange(len(digests)), [], []
    for level in range(MAX_LEVELS):
        if not len(left):
            break
        size = max(64, GAMMA * len(left))
        at = _mix(_keys(digests[left]), level) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        hit = alone[at.astype(np.int64)]
        levels.append(np.packbits(alone, bitorder="little"))
        chosen = left[hit]
        placed.append(chosen[np.argsort(at[hit], kind="stable")])
        left = left[~hit]
    placed.append(left)
    return levels, np.concatenate(placed).astype(np.int64) if placed else left


def find_slots(levels: list[np.ndarray], slots: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Slot of every digest, -1 where its bytes are not those in the slot."""
    found = np.full(len(digests), -1, np.int64)
    left, base, keys = np.arange(len(digests)), 0, _keys(digests)
    for level, packed in enumerate(levels):
        bits = np.unpackbits(packed, bitorder="little")
        n_keys = int(bits.sum())
        size = max(64, GAMMA * (len(slots) - base))
        at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at] == 1
        rank = np.cumsum(bits, dtype=np.int64)
        slot = base + rank[at[hit]] - 1
        same = (slots[slot] == digests[left[hit]]).all(axis=1)
        found[left[hit][same]] = slot[same]
        left, base = left[~hit], base + n_keys
    for slot in range(base, len(slots)):
        found[left[(digests[left] == slots[slot]).all(axis=1)]] = slot
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


class DigestStore:
    """The stored groups of earlier texts: one row per shard, read and replaced as a table.

    ``winner`` is any ordered type: the locator of the row that stays.
    """

    def __init__(self, table: DataFrame, shards: int):
        self.table, self.shards = table, shards

    @staticmethod
    def build(groups: DataFrame, shard_digests: int = SHARD_DIGESTS, asked: int = 0) -> DigestStore:
        """From ``(digest, winner, copies)`` with distinct digests; no rows give an empty store.

        ``asked`` is how many digests will be looked up: a shard is to hold few of these, too.
        """
        shards = max(1, -(-max(groups.count(), asked) // shard_digests))
        winner = groups.schema["winner"].dataType
        schema = T.StructType(
            [
                T.StructField("shard", T.IntegerType()),
                T.StructField("levels", T.ArrayType(T.BinaryType())),
                T.StructField("digests", T.BinaryType()),
                T.StructField("winners", T.ArrayType(winner)),
                T.StructField("copies", T.ArrayType(T.LongType())),
            ]
        )

        def make(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            digests = _matrix(table["digest"])
            levels, order = build_hash(digests)
            chosen = table.take(pa.array(order))
            return pa.table(
                {
                    "shard": chosen["shard"][:1],
                    "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())),
                    "digests": pa.array([digests[order].tobytes()], pa.binary()),
                    "winners": pa.array([chosen["winner"].to_pylist()], pa.list_(chosen["winner"].type)),
                    "copies": pa.array([chosen["copies"].to_pylist()], pa.list_(pa.int64())),
                }
            )

        rows = groups.select(_shard(F.col("digest"), shards).alias("shard"), "digest", "winner", "copies")
        return DigestStore(stored(rows.groupBy("shard").applyInArrow(make, schema), "digest-store"), shards)

    def groups(self) -> DataFrame:
        """``(digest, winner, copies)`` read out of the slots."""
        at = F.sequence(F.lit(0), F.size("winners") - 1)
        slots = self.table.select("digests", "winners", "copies", F.explode(at).alias("slot"))
        return slots.select(
            F.substring("digests", F.col("slot") * 32 + 1, F.lit(32)).alias("digest"),
            F.get("winners", F.col("slot")).alias("winner"),
            F.get("copies", F.col("slot")).alias("copies"),
        )

    def lookup(self, groups: DataFrame) -> DataFrame:
        """``(digest, winner, copies, member, old_winner, old_copies)`` for distinct digests.

        ``old_*`` come from the slot; they are null for nonmembers.
        """
        winner = groups.schema["winner"].dataType.simpleString()
        schema = (
            f"digest binary, winner {winner}, copies long, member boolean, old_winner {winner}, old_copies long"
        )

        def find(new: pa.Table, shard: pa.Table) -> pa.Table:
            kind = new.schema.field("winner").type
            new = new.combine_chunks()
            slot = np.full(new.num_rows, -1, np.int64)
            winners, copies = pa.array([], kind), pa.array([], pa.int64())
            if shard.num_rows and new.num_rows:
                row = shard.combine_chunks()
                slots = np.frombuffer(row["digests"][0].as_py(), np.uint8).reshape(-1, 32)
                levels = [np.frombuffer(x, np.uint8) for x in row["levels"][0].as_py()]
                slot = find_slots(levels, slots, _matrix(new["digest"]))
                winners, copies = row["winners"].chunk(0).flatten(), row["copies"].chunk(0).flatten()
            at = pa.array(slot, mask=slot < 0)
            return pa.table(
                {
                    "digest": new["digest"],
                    "winner": new["winner"],
                    "copies": new["copies"],
                    "member": pa.array(slot >= 0),
                    "old_winner": winners.take(at),
                    "old_copies": copies.take(at),
                }
            )

        rows = groups.select(_shard(F.col("digest"), self.shards).alias("shard"), "digest", "winner", "copies")
        return rows.groupBy("shard").cogroup(self.table.groupBy("shard")).applyInArrow(find, schema)


def group_digests(rows: DataFrame) -> DataFrame:
    """``(digest, winner, copies)`` of ``(digest, key)``: the largest key stays, nulls lose."""
    return rows.groupBy("digest").agg(F.max("key").alias("winner"), F.count(F.lit(1)).alias("copies"))


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", history: Column | None = None
) -> DataFrame:
    """``(key, digest, winner, copies)`` per row: the group of equal texts that the row is in.

    ``history`` marks the rows that were ingested before the others; without it there are none,
    and all rows are new. The result does not depend on it.

    Nulls: a null text counts as empty; a null key loses against any other and stays only in
    a group without keys; a null mark means new. Repeated rows count as copies. Other columns are
    ignored. An empty table gives an empty one.
    """
    old = F.coalesce(history, F.lit(False)) if history is not None else F.lit(False)
    src = docs.select(F.col(key).alias("key"), text_digest(F.col(text)).alias("digest"), old.alias("old"))
    rows = stored(src, "digests")
    new = stored(group_digests(rows.filter(~F.col("old"))), "new-groups")
    before = DigestStore.build(stored(group_digests(rows.filter("old")), "earlier-groups"), asked=new.count())
    fresh = stored(before.lookup(new), "lookups")
    # Repeats are settled by their slot; texts that the store does not know make their own groups.
    repeats = fresh.filter("member").select(
        "digest",
        F.greatest("winner", "old_winner").alias("winner")
        if not isinstance(rows.schema["key"].dataType, T.StructType)
        else F.when(F.col("winner") > F.col("old_winner"), F.col("winner")).otherwise(F.col("old_winner")).alias("winner"),
        (F.col("copies") + F.col("old_copies")).alias("copies"),
    )
    unseen = fresh.filter(~F.col("member")).select("digest", "winner", "copies")
    untouched = before.groups().join(repeats.select("digest"), "digest", "left_anti")
    groups = stored(untouched.unionByName(repeats).unionByName(unseen), "text-groups")
    return rows.join(groups, "digest").select(F.col("key").alias(key), "digest", "winner", "copies")

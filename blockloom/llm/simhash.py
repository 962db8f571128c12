"""SimHash near-duplicates by anchor points of a covering code.

Two fingerprints that differ in at most three of 64 bits differ in at most one bit of one of two
31-bit blocks. The anchors of a block are the words of the Hamming code of that length: every
word lies within one bit of exactly one of them, its *home*. A fingerprint is therefore copied
to all anchors within 1 + 1 bits (one or sixteen of them), and one of any two linked
fingerprints meets the other at its home. The work is on distinct fingerprints only: copies of a
text, however many, are one row.

An anchor that is home to very many fingerprints is split by pieces of the other bits: of four
pieces one is equal in both of a linked pair, so each row goes to four smaller groups and no
link is lost. Groups are streamed through numpy, which gives back the edges of a spanning forest,
never all pairs of a group.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import connected_components
from .rows import add_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SEED, THRESHOLD = 3, 42, 3
WIDTH = 31
BLOCK_MASK = (1 << WIDTH) - 1
# Homes at one anchor beyond which it is split.
HOT_HOMES = 20_000
# Pairs compared at a time.
CHUNK_PAIRS = 1 << 18
CHUNK_SHINGLES = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, repeats included, as a signed number: bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK_SHINGLES):
        some = np.ascontiguousarray(hashes[at : at + CHUNK_SHINGLES])
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _kernel():
    from xxhash import xxh64_intdigest

    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

    def fingerprint(text: str) -> int:
        words = text.encode("utf-8").translate(lower).split()
        if not words:
            return 0
        joined = b" ".join(words)
        n = max(1, len(words) - SHINGLE + 1)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
        ends = ends[min(SHINGLE, len(words)) - 1 :].tolist()
        ones = np.zeros(64, np.int64)
        for at in range(0, n, CHUNK_SHINGLES):
            spans = zip(starts[at : at + CHUNK_SHINGLES], ends[at : at + CHUNK_SHINGLES])
            hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in spans], np.uint64)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])

    return lambda texts: [[fingerprint(t) for t in texts]]


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the 64-bit fingerprint as a signed long; texts without words, nulls too, give zero."""
    return add_columns(docs, text, f"{out} long", _kernel)


def _syndrome(word: Column) -> Column:
    # Position p of a word, counted from 1, is its bit p - 1; the syndrome is the sum of the set
    # positions in GF(2), that is, the position to flip to reach the code word.
    res = F.lit(0)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, WIDTH + 1) if p >> j & 1)
        res = res + (F.bit_count(word.bitwiseAND(F.lit(mask))) % 2) * (1 << j)
    return res.cast("int")


def _flip(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position - 1)


def _home(word: Column, syndrome: Column) -> Column:
    return F.when(syndrome == 0, word).otherwise(word.bitwiseXOR(_flip(syndrome)))


def _others(word: Column, syndrome: Column) -> Column:
    # Code words two bits away: both positions sum to the syndrome. None for a code word.
    def partner(p):
        return p.bitwiseXOR(syndrome)

    first = F.filter(
        F.sequence(F.lit(1), F.lit(WIDTH)), lambda p: (partner(p) > p) & (syndrome != 0) & (p != syndrome)
    )
    return F.transform(first, lambda p: word.bitwiseXOR(_flip(p)).bitwiseXOR(_flip(partner(p))))


def _pieces(fp: Column, block: Column) -> Column:
    """The 33 bits outside a block in four pieces."""
    low = F.shiftrightunsigned(fp, WIDTH)
    high = fp.bitwiseAND(F.lit(BLOCK_MASK)).bitwiseOR(
        F.call_function("shiftleft", F.shiftrightunsigned(fp, 2 * WIDTH), F.lit(WIDTH))
    )
    rest = F.when(block == 0, low).otherwise(high)
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("piece"),
                F.shiftrightunsigned(rest, 8 * i).bitwiseAND(F.lit(255 if i < 3 else 511)).alias("value"),
            )
            for i in range(4)
        ]
    )


def anchor_rows(distinct: DataFrame, hot_homes: int = HOT_HOMES) -> DataFrame:
    """``(block, anchor, piece, value, away, fp)``: every fingerprint at each anchor it can meet a partner at."""
    words = F.array(
        *[
            F.struct(
                F.lit(b).alias("block"),
                F.shiftrightunsigned("fp", WIDTH * b).bitwiseAND(F.lit(BLOCK_MASK)).alias("word"),
            )
            for b in range(2)
        ]
    )
    placed = distinct.select("fp", F.explode(words).alias("w")).select(
        "fp", "w.block", "w.word", _syndrome(F.col("w.word")).alias("s")
    )
    placed = placed.select("fp", "block", "word", "s", _home(F.col("word"), F.col("s")).alias("home"))
    crowded = placed.groupBy("block", "home").count().filter(F.col("count") > hot_homes)
    hot = stored(crowded.select("block", "home"), "hot-anchors")
    placed = placed.join(hot.withColumn("crowded", F.lit(True)), ["block", "home"], "left")
    anchors = F.concat(
        F.array(F.struct(F.col("home").alias("anchor"), F.lit(0).alias("away"))),
        F.transform(_others(F.col("word"), F.col("s")), lambda a: F.struct(a.alias("anchor"), F.lit(1).alias("away"))),
    )
    rows = placed.select("fp", "block", "crowded", F.explode(anchors).alias("a")).select(
        "fp", "block", "crowded", "a.anchor", "a.away"
    )
    split = hot.select("block", F.col("home").alias("anchor"), F.lit(True).alias("split"))
    rows = rows.join(split, ["block", "anchor"], "left")
    # A fingerprint from a crowded home meets its partners there; elsewhere it would only add rows.
    rows = rows.filter((F.col("away") == 0) | F.col("crowded").isNull() | F.col("split").isNotNull())
    whole = F.array(F.struct(F.lit(-1).alias("piece"), F.lit(0).cast("long").alias("value")))
    groups = F.when(F.col("split"), _pieces(F.col("fp"), F.col("block"))).otherwise(whole)
    rows = rows.select("block", "anchor", "away", "fp", F.explode(groups).alias("g"))
    return rows.select("block", "anchor", "g.piece", "g.value", "away", "fp")


def _join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of ``a[i]`` and ``b[i]``; ``label`` holds the smallest member of each set."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]


def _forest(group: np.ndarray, away: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the linked rows of whole groups; homes come first in a group."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(fp)]]))
    first, count = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    homes = np.flatnonzero((away == 0) & (count > 1))
    label = np.arange(len(fp))
    if len(homes):
        pairs = np.cumsum(count[homes])
        cuts = np.searchsorted(pairs, np.arange(CHUNK_PAIRS, pairs[-1] + CHUNK_PAIRS, CHUNK_PAIRS), side="right")
        begin = 0
        for end in np.unique(np.maximum(cuts, 1)):
            part = homes[begin:end]
            begin = end
            if not len(part):
                continue
            n = count[part]
            left = np.repeat(part, n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            right = np.repeat(first[part], n) + offset
            near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= threshold
            label = _join_up(label, left[near], right[near])
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def links(distinct: DataFrame, threshold: int = THRESHOLD, hot_homes: int = HOT_HOMES) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints within ``threshold`` bits of each other.

    Not every pair is listed: within a group the edges form a forest with the same components.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"two blocks of this code cover thresholds up to {THRESHOLD}")
    keys = ["block", "anchor", "piece", "value"]
    rows = anchor_rows(distinct, hot_homes)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "away")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(parts, last):
            columns = [np.concatenate(c) for c in zip(*parts)]
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)])
            end = len(new) if last else np.flatnonzero(new)[-1]
            a, b = _forest(np.cumsum(new[:end]), columns[4][:end], columns[5][:end], threshold) if end else ([], [])
            done = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            return [[c[end:] for c in columns]], done

        held, rows_held, wait = [], 0, 1
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows_held += batch.num_rows
            # A group that fills several batches is looked at again when it has doubled.
            if rows_held >= wait:
                held, done = cut(held, False)
                rows_held = len(held[0][0])
                wait = 2 * rows_held
                yield done
        if rows_held:
            yield cut(held, True)[1]

    return rows.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, hot_homes: int = HOT_HOMES
) -> DataFrame:
    """``(key, fp, component)`` per row: rows whose fingerprints are linked, directly or over
    others, share a component, named by its smallest key.

    Nulls: a null text counts as empty; a null key never names a component, and a component
    without any key has a null name. Texts without words have fingerprint zero and are linked like
    others. Repeated rows are kept, each with the same component. Other columns are ignored. An
    empty table gives an empty one. ``key`` may be any type with an order, structs included.
    """
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = stored(fingerprints(src).select("key", "fp"), "fingerprints")
    distinct = stored(known.groupBy("fp").agg(F.min("key").alias("first")), "distinct-fingerprints")
    stars = connected_components(links(distinct.select("fp"), threshold, hot_homes))
    linked = stored(stars.withColumnRenamed("node", "fp").join(distinct, "fp"), "linked")
    names = stored(linked.groupBy("root").agg(F.min("first").alias("component")), "components")
    named = linked.join(names, "root").select("fp", "component", F.lit(True).alias("named"))
    label = F.when(F.col("named"), F.col("component")).otherwise(F.col("first"))
    labels = stored(distinct.join(named, "fp", "left").select("fp", label.alias("component")), "labels")
    return known.join(labels, "fp").select(F.col("key").alias(key), "fp", "component")

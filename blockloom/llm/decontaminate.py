"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark are normalised word n-grams. Their hashes, checked to be few, become
a hash set inside the scan: every window of a document is hashed and looked up where the words
are, without a shuffle. The windows that hit carry their words on and are verified against the
benchmark by an ordinary join on the words. A benchmark too large for the set is joined by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .exact_dedup import text_digest
from .rows import ROW, small_side, snapshot

WINDOW = 10
# Window hashes that may go into the plan as a set: 8 bytes each, sent to every task.
MAX_SET = 50_000
# What separates words. Every character from U+0080 on belongs to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    split = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(split, lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """``(window, size, items)``: every distinct window of the benchmark and the items that hold it.

    An item of fewer than ``n`` words, but not none, is one window.
    """
    parsed = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w"))
    size = F.least(F.size("w"), F.lit(n))
    at = parsed.filter(F.size("w") > 0).select(
        "item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at")
    )
    window = F.array_join(F.slice(F.col("w"), F.col("at"), F.col("size")), " ")
    # An item without an id still contaminates; it just cannot be named.
    return (
        at.select(window.alias("window"), "size", "item")
        .groupBy("window", "size")
        .agg(F.collect_set("item").alias("items"))
    )


def _hash(at: Column, size: int) -> Column:
    return F.xxhash64(F.slice(F.col("w"), at, F.lit(size)))


def _window_hash(window: Column) -> Column:
    return F.xxhash64(F.split(window, " "))


def _starts(size: int) -> Column:
    count = F.size("w") - size + 1
    return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def _with_hash(size: int):
    return lambda at: F.struct(at.alias("at"), _hash(at, size).alias("h"))


def _with_words(size: int):
    def spans(at: Column) -> Column:
        window = F.array_join(F.slice(F.col("w"), at, F.lit(size)), " ")
        return F.struct(at.alias("at"), F.lit(size).alias("size"), window.alias("window"))

    return spans


def _scan_set(docs: DataFrame, hashes: dict[int, list[int]]) -> DataFrame:
    """``(row, n_words, candidates)`` by a set inside the scan."""
    found = F.array().cast("array<struct<at:int,size:int,window:string>>")
    for size, values in hashes.items():
        # As text, so that thousands of values are one expression and not as many calls.
        listed = ",".join(f"{v}L" if v != -(2**63) else f"CAST({v} AS BIGINT)" for v in values)
        hits = F.expr(
            f"filter(IF(size(w) >= {size}, sequence(1, size(w) - {size - 1}), CAST(array() AS array<int>)),"
            f" i -> xxhash64(slice(w, i, {size})) IN ({listed}))"
        )
        found = F.concat(found, F.transform(hits, _with_words(size)))
    return docs.select(ROW, F.size("w").cast("long").alias("n_words"), found.alias("candidates"))


def _scan_join(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The same by a join on hashes, for a benchmark that is not small."""
    wanted = windows.select("size", _window_hash(F.col("window")).alias("h")).distinct()
    hashed = None
    for size in sizes:
        pairs = F.transform(_starts(size), _with_hash(size))
        rows = docs.select(ROW, F.explode(pairs).alias("p")).select(ROW, F.lit(size).alias("size"), "p.at", "p.h")
        hashed = rows if hashed is None else hashed.unionByName(rows)
    hits = hashed.join(wanted, ["size", "h"]).groupBy(ROW).agg(F.collect_list(F.struct("at", "size")).alias("hits"))
    window = F.transform(
        F.coalesce("hits", F.array().cast("array<struct<at:int,size:int>>")),
        lambda x: F.struct(x["at"], x["size"], F.array_join(F.slice(F.col("w"), x["at"], x["size"]), " ").alias("window")),
    )
    counted = docs.join(hits, ROW, "left")
    return counted.select(ROW, F.size("w").cast("long").alias("n_words"), window.alias("candidates"))


def scan(rows: DataFrame, windows: DataFrame, text: str = "text", max_set: int = MAX_SET) -> DataFrame:
    """``(row, n_words, candidates)`` of rows with ids: windows whose hash is in the benchmark."""
    docs = rows.select(ROW, words(F.col(text)).alias("w"))
    sizes = [r[0] for r in windows.select("size").distinct().collect()]
    # One row more than the bound tells whether the set is small enough.
    few = windows.select("size", _window_hash(F.col("window")).alias("h")).distinct().limit(max_set + 1).collect()
    if len(few) > max_set:
        return _scan_join(docs, windows, sizes)
    by_size: dict[int, list[int]] = {}
    for size, h in few:
        by_size.setdefault(size, []).append(h)
    return _scan_set(docs, by_size)


def contamination(
    rows: DataFrame, benchmark: DataFrame, text: str = "text", n: int = WINDOW, max_set: int = MAX_SET
) -> DataFrame:
    """``(row, n_words, n_hit, n_items, items, hits)`` for every row of a snapshot.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` are the ids of the items
    that own them, as sorted strings, and ``hits`` the spans of words, from 1.

    Nulls: a null text has no words, in documents and items alike; an item with a null id
    contaminates but is neither counted nor named. Repeated rows are looked at one by one. An
    empty benchmark hits nothing; an empty table gives an empty one.
    """
    windows = stored(benchmark_windows(benchmark, text="text", n=n), "windows")
    scanned = stored(scan(rows, windows, text, max_set), "window-scan")
    # The verifying join: equal hashes of different words end here.
    spans = scanned.select(ROW, F.explode("candidates").alias("c")).select(ROW, "c.at", "c.size", "c.window")
    verified = spans.join(windows, ["window", "size"])
    per_row = verified.groupBy(ROW).agg(
        F.collect_set(F.struct("at", "size")).alias("hits"), F.collect_set("items").alias("owners")
    )
    hit_words = F.array_distinct(
        F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1)))
    )
    items = F.array_sort(F.array_distinct(F.flatten("owners")))
    found = per_row.select(ROW, "hits", F.size(hit_words).cast("long").alias("n_hit"), items.alias("items"))
    none = F.array().cast("array<string>")
    return scanned.select(ROW, "n_words").join(found, ROW, "left").select(
        ROW,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("hits", F.array().cast("array<struct<at:int,size:int>>")).alias("hits"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = WINDOW) -> DataFrame:
    """The documents without any hit, columns unchanged.

    A null text has no words and stays, and so do all rows if the benchmark is empty. Repeated rows share their
    fate: texts are told apart by their digests, and documents stay where they are while those that go are
    few. An empty table gives an empty one.
    """
    digest = text_digest(F.col(text))
    rows = docs.select(digest.alias(ROW), F.col(text).alias("text"))
    hit = contamination(rows, benchmark, "text", n).filter("n_hit > 0")
    hit = stored(hit.select(F.col(ROW).alias("__bl_digest")).distinct(), "contaminated-texts")
    marked = docs.withColumn(ROW, digest)
    return marked.join(small_side(hit), F.col(ROW) == F.col("__bl_digest"), "left_anti").drop(ROW)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = WINDOW) -> DataFrame:
    """All documents, those with hits rewritten as their other words, joined by spaces.

    Documents without hits keep their text as it is, nulls included.
    """
    rows = snapshot(docs, "decontaminate")
    hits = contamination(rows, benchmark, text, n).filter("n_hit > 0").select(ROW, F.col("hits").alias("__bl_hits"))
    covered = F.array_distinct(
        F.flatten(F.transform("__bl_hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1)))
    )
    # Both sides are sets of positions, so what is left keeps its order.
    left = F.array_except(F.sequence(F.lit(1), F.size(words(F.col(text)))), covered)
    others = F.transform(left, lambda i: F.get(words(F.col(text)), i - 1))
    joined = rows.join(hits, ROW, "left")
    cut = F.when(F.col("__bl_hits").isNull(), F.col(text)).otherwise(F.array_join(others, " "))
    return joined.withColumn(text, cut).select(*docs.columns)

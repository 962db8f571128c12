"""Which sources of a language differ, and by which terms.

Terms are counted inside the tasks of the scan, packed by length: terms of up to 8 bytes are one
64-bit word and of up to 16 bytes two, sorted by radix and counted in runs; longer ones go into
buckets of byte strings by width. Rows of a batch are put in the order of their groups first, and the
sorts are stable, so one pass over a run gives occurrences and documents per group. Spark adds these up.

All arithmetic is on integers. A group's share of a term is smoothed with one occurrence of every
kept term and scaled; the divergence of two shares is their squared difference over the reference.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .rows import parts
from .terms import Terms, byte_class, radix_order, split

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LETTERS = byte_class((ord("A"), ord("Z")), (ord("a"), ord("z")))
MIN_DOCS, TOP = 3, 200
# Shares are in parts of this. Its steps are by thousands, so products stay below 64 bits for counts up to 9e15.
SCALE_STEPS, STEP = 3, 1000
# Groups that every task gets the totals of; their pairs, the result, would be far more.
MAX_GROUPS = 1_000_000
# Sources whose pairs a task adds up together, and cells looked at a time.
TILE, CELLS = 256, 1 << 20


def _buckets(terms: Terms) -> Iterator[np.ndarray]:
    """Terms in sorted order with equal ones together, one bucket of lengths at a time."""
    size = terms.size
    for words, low, high in ((1, 1, 8), (2, 9, 16)):
        which = np.flatnonzero((size >= low) & (size <= high))
        packed = [terms.word(which, at) for at in range(words)]
        order = radix_order(packed)
        packed = [w[order] for w in packed]
        new = np.zeros(len(which), bool)
        for w in packed:
            new[1:] |= w[1:] != w[:-1]
        yield which[order], new
    width = 32
    while (size > width // 2).any():
        which = np.flatnonzero((size > width // 2) & (size <= width))
        if width == 32:
            which = which[size[which] > 16]
        if len(which):
            texts = terms.padded(which, width)
            order = np.argsort(texts, kind="stable")
            texts = texts[order]
            yield which[order], np.concatenate([[False], texts[1:] != texts[:-1]])
        width *= 2


def count_runs(terms: Terms, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(first, n, rows)`` per bucket of lengths: a term of every run, its occurrences and its rows.

    ``group`` is the group of every row, ascending; runs are of one term and one group.
    """
    found = []
    for which, new in _buckets(terms):
        if not len(which):
            continue
        row = terms.row[which]
        new_group = np.concatenate([[True], group[row[1:]] != group[row[:-1]]]) | new
        new_group[0] = True
        new_row = np.concatenate([[True], row[1:] != row[:-1]]) | new_group
        starts = np.flatnonzero(new_group)
        n = np.diff(np.concatenate([starts, [len(which)]]))
        found.append((which[starts], n, np.add.reduceat(new_row.astype(np.int64), starts)))
    return found


def count_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, n_docs)`` of ``(lang, source, text)`` without nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                lang, source = (part.column(i).dictionary_encode() for i in (0, 1))
                code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                terms = split(part.column(2).take(pa.array(order)), LETTERS)
                code = code[order]
                for first, n, rows in count_runs(terms, code):
                    at = code[terms.row[first]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            lang.dictionary.take(pa.array(at // len(source.dictionary))),
                            source.dictionary.take(pa.array(at % len(source.dictionary))),
                            terms.strings(first), pa.array(n, pa.int64()), pa.array(rows, pa.int64()),
                        ],
                        ["lang", "source", "term", "n", "n_docs"],
                    )

    counted = docs.select("lang", "source", "text").mapInArrow(
        count, "lang string, source string, term string, n long, n_docs long"
    )
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * (count + 1) / total)``, by long division."""
    left = count + 1
    out, left = left // total, left % total
    for _ in range(SCALE_STEPS):
        left = left * STEP
        out, left = out * STEP + left // total, left % total
    return out + 1


def _share(count: str, total: str) -> Column:
    return F.expr(f"1 + (1000000000BD * cast({count} + 1 as decimal(19,0))) div cast({total} as decimal(19,0))")


def _pair_sums(kept: DataFrame, langs: dict[str, tuple[list[str], np.ndarray]]) -> DataFrame:
    """``(lang, source, item, value)``: divergences of pairs of sources, added up over the kept terms."""
    tiles = max((-(-len(names) // TILE) for names, _ in langs.values()), default=1)
    known = kept.sparkSession.sparkContext.broadcast(langs)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                names, totals = known.value[lang]
                values = pa.array(names, pa.string())
                some = batch.filter(pa.compute.equal(batch.column(0), lang))
                step = max(1, CELLS // len(names))
                for begin in range(0, some.num_rows, step):
                    piece = some.slice(begin, step)
                    held, tile = piece.column(1), piece.column(2).to_numpy()
                    at = pa.compute.index_in(held.flatten().field(0), value_set=values).to_numpy()
                    counts = np.zeros((piece.num_rows, len(names)), np.int64)
                    counts[pa.compute.list_parent_indices(held).to_numpy(), at] = held.flatten().field(1).to_numpy()
                    p = shares(counts, totals)
                    for t in np.unique(tile):
                        q = p[tile == t]
                        mine = q[:, t * TILE : (t + 1) * TILE]
                        if not mine.shape[1]:
                            continue
                        total = sums.setdefault((lang, int(t)), np.zeros((mine.shape[1], len(names)), np.int64))
                        for a in range(mine.shape[1]):
                            off = mine[:, a : a + 1] - q
                            total[a] += (off * off // q).sum(axis=0)
        for (lang, t), total in sums.items():
            names = known.value[lang][0]
            for a, row in enumerate(total):
                others = [i for i in range(len(names)) if i != t * TILE + a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(others), pa.string()), pa.array([names[t * TILE + a]] * len(others), pa.string()),
                        pa.array([names[i] for i in others], pa.string()), pa.array(row[others], pa.int64()),
                    ],
                    ["lang", "source", "item", "value"],
                )

    at = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))) if tiles > 1 else F.lit(0)
    rows = kept.select("lang", "held", at.alias("tile"))
    found = rows.mapInArrow(add, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair`` has every other source of the language with the divergence of the two, part ``term``
    the ``top`` kept terms that the group has more of than its language. A language keeps the terms in
    ``min_docs`` of its rows. Equal values rank by the item's bytes.

    Nulls in text, language and source count as empty texts. Repeated rows count each, also as
    documents. Groups without terms are in every pair; a language without kept terms has pairs of value 0,
    one of a single source no pairs. Very long terms are terms. Other columns, whatever their names, are
    ignored. An empty table gives an empty one.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = count_terms(docs).groupBy("lang", "term").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"),
        # As many entries as the language has sources.
        F.collect_list(F.struct("source", "n")).alias("held"),
    )
    kept = stored(counted.filter(F.col("n_docs") >= min_docs).select("lang", "term", "n", "held"), "kept-terms")
    sizes = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("total"))
    wholes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("whole"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(wholes, "lang", "left")
    groups = stored(groups.na.fill(0), "source-totals")
    known = groups.limit(MAX_GROUPS + 1).collect()
    if len(known) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of language and source")
    langs: dict[str, tuple[list[str], list[int]]] = {}
    for r in sorted(known):
        names, totals = langs.setdefault(r["lang"], ([], []))
        names.append(r["source"])
        totals.append(r["total"] + r["terms"])
    sums = _pair_sums(kept, {k: (names, np.array(totals, np.int64)) for k, (names, totals) in langs.items()})
    names = groups.select("lang", "source")
    every = names.join(names.withColumnRenamed("source", "item"), "lang").filter("source != item")
    pairs = every.join(stored(sums, "pair-sums"), ["lang", "source", "item"], "left").na.fill(0, ["value"])
    terms = kept.select("lang", "term", F.col("n").alias("in_lang"), F.explode("held").alias("h"))
    terms = terms.select("lang", "term", "in_lang", "h.source", "h.n").join(groups, ["lang", "source"])
    terms = terms.withColumns({"p": _share("n", "(total + terms)"), "q": _share("in_lang", "(whole + terms)")}).filter("p > q")
    terms = terms.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best).alias("rank")
    ranked = terms.select("*", rank).filter(F.col("rank") <= top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    first = pairs.select("*", rank).withColumn("part", F.lit("pair")).select(*columns)
    return first.unionByName(ranked.withColumn("part", F.lit("term")).select(*columns))

"""Ranked lexical search over bit-sliced Bloom signatures.

An index row is a block of documents of similar length. Its bit matrix has a row per position of the
Bloom filters and a column per document, so the rows of a term, taken together by AND, are the
documents that may hold it: too many at times, never too few. Besides its presence every term is entered
once more for each frequency step that it reaches, which bounds its frequency from above.

A query adds up the weights of its terms over these bitmaps. The sums are upper bounds of the scores. The best
bounds are scored on the texts first and give each query a score that its last result has at least; then
every document whose bound reaches it is scored on its text. All others are provably not in the result, so it
equals a search of every text.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .rows import parts
from .terms import Terms, byte_class, mixed, split

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMBER = byte_class((ord("0"), ord("9")), (ord("A"), ord("Z")), (ord("a"), ord("z")))
TOP = 20
# Positions per entry, and the share of set bits in the longest document of a block.
PROBES, DENSITY = 6, 0.25
# A term is entered for each step that its frequency reaches.
STEPS = (1, 2, 4, 8)
# Documents of a block, all with at least this share of the entries of the longest one.
BLOCK, ALIKE = 512, 0.6
# Bounds per query that are scored first.
FIRST = 64
# Parts that the rows of a query are ranked in before they are ranked together.
SALT = 32
# Text of the queries that are looked for in one pass, and candidates up to which they are broadcast.
QUERY_BYTES, BROADCAST_PAIRS = 32 << 20, 2_000_000

BLOCKS = "keys array<long>, sizes array<int>, width int, bits binary"


def _positions(hashes: np.ndarray, step: int, width: int) -> np.ndarray:
    """Rows of the bit matrix for every hash, ``PROBES`` each."""
    with np.errstate(over="ignore"):
        probe = hashes[:, None] + np.arange(step * PROBES + 1, (step + 1) * PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed(probe) % np.uint64(width)).astype(np.int64)


def _entries(terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, hash, n)``: the terms of every text once, with their frequency."""
    hashes = terms.hashes()
    order = np.lexsort((hashes, terms.row))
    row, hashes = terms.row[order], hashes[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return row[first], hashes[first], np.diff(np.concatenate([first, [len(row)]]))


def signature_blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, bytes]]:
    """``(rows, sizes, width, bits)`` per block: which texts it holds and how many terms they have."""
    terms = split(texts, MEMBER)
    size = np.bincount(terms.row, minlength=len(texts))
    row, hashes, n = _entries(terms)
    load = np.zeros(len(texts), np.int64)
    for step in STEPS:
        load += np.bincount(row[n >= step], minlength=len(texts))
    by_load = np.argsort(-load, kind="stable")[: np.count_nonzero(size)]
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    begin = 0
    while begin < len(by_load):
        end = begin + int(np.searchsorted(-load[by_load[begin : begin + BLOCK]], -ALIKE * load[by_load[begin]], side="right"))
        # Columns are full bytes.
        end = min(max(end, begin + 8), len(by_load))
        rows = by_load[begin:end]
        columns = -(-len(rows) // 8) * 8
        width = max(64, math.ceil(load[rows[0]] * PROBES / -math.log(1 - DENSITY)))
        bits = np.zeros(width * columns, bool)
        counts = first[rows + 1] - first[rows]
        at = np.repeat(first[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        column = np.repeat(np.arange(len(rows)), counts)
        for i, step in enumerate(STEPS):
            often = n[at] >= step
            bits[(_positions(hashes[at[often]], i, width) * columns + column[often, None]).ravel()] = True
        yield rows, size[rows], width, np.packbits(bits).tobytes()
        begin = end


@dataclass
class SignatureIndex:
    """Blocks of signatures, the number of documents with terms and of their terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int

    @staticmethod
    def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> SignatureIndex:
        """An index of every document with a term. Keys are longs; they may repeat or be null."""

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in parts(batch, 1):
                    keys = part.column(0)
                    for rows, sizes, width, bits in signature_blocks(part.column(1)):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([keys.take(pa.array(rows)).to_pylist()], pa.list_(pa.int64())),
                                pa.array([sizes], pa.list_(pa.int32())), pa.array([width], pa.int32()), pa.array([bits], pa.binary()),
                            ],
                            ["keys", "sizes", "width", "bits"],
                        )

        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        blocks = stored(rows.mapInArrow(build, BLOCKS), "signatures")
        terms = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        n_docs, n_terms = blocks.agg(F.sum(F.size("keys")), F.sum(terms)).first()
        return SignatureIndex(blocks, n_docs or 0, n_terms or 0)


class QuerySet:
    """Queries as counted terms: what travels to the tasks."""

    def __init__(self, texts: list[str]):
        found = split(pa.array(texts, pa.string()), MEMBER)
        words = found.strings(np.arange(len(found.start))).to_pylist()
        per_query = [Counter() for _ in texts]
        for q, w in zip(found.row.tolist(), words):
            per_query[q][w] += 1
        known = sorted(set(words))
        self.seed = 0
        while True:
            self.terms = split(pa.array(known, pa.string()), MEMBER)
            self.hashes = self.terms.hashes(self.seed)
            if len(np.unique(self.hashes)) == len(known):
                break
            self.seed += 1
        order = np.argsort(self.hashes)
        self.hashes, self.known = self.hashes[order], [known[i] for i in order]
        every = np.arange(len(known))
        # Signatures use the hash without a seed.
        self.signed = self.terms.hashes()[order]
        self.size = self.terms.size[order]
        self.words = [self.terms.word(every, at)[order] if len(known) else np.zeros(0, np.uint64) for at in (0, 1)]
        self.possible = np.zeros(1 << 16, bool)
        self.possible[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        number = {w: i for i, w in enumerate(self.known)}
        self.queries = [
            (np.array([number[w] for w in c], np.int64), np.array(list(c.values()), np.int64)) for c in per_query
        ]

    def __len__(self) -> int:
        return len(self.queries)

    def find(self, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        """``(row, term)`` of every occurrence of a term of the queries, compared byte by byte."""
        if not self.known or not len(terms.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = terms.hashes(self.seed)
        which = np.flatnonzero(self.possible[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.hashes, hashes[which]), len(self.known) - 1)
        same = (self.hashes[term] == hashes[which]) & (self.size[term] == terms.size[which])
        which, term = which[same], term[same]
        same = (terms.word(which, 0) == self.words[0][term]) & (
            (self.size[term] <= 8) | (terms.word(which, 1) == self.words[1][term])
        )
        for i in np.flatnonzero(same & (self.size[term] > 16)):
            begin = terms.start[which[i]]
            same[i] = terms.data[begin : begin + terms.size[which[i]]].tobytes() == self.known[term[i]].encode()
        return terms.row[which[same]], term[same]


def length_part(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a document's length in its scores, 100 for the average one; without overflow at any size."""
    values, at = np.unique(sizes, return_inverse=True)
    return np.array([75 + 25 * int(x) * n_docs // n_terms for x in values], np.int64)[at]


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def bounds(queries: QuerySet, weights: np.ndarray, n_docs: int, n_terms: int, sizes: np.ndarray, width: int, bits: bytes) -> np.ndarray:
    """Upper bounds of the scores of a block, one row per query and one column per document."""
    columns = -(-len(sizes) // 8)
    matrix = np.frombuffer(bits, np.uint8).reshape(width, columns)
    m, tf = length_part(sizes, n_docs, n_terms), sizes.astype(np.int64)
    held, level, before = None, [], np.zeros(len(sizes), np.int64)
    for i, _ in enumerate(STEPS):
        here = np.bitwise_and.reduce(matrix[_positions(queries.signed, i, width)], axis=1)
        held = here if held is None else held & here
        most = np.minimum(STEPS[i + 1] - 1, tf) if i + 1 < len(STEPS) else tf
        now = gain(most, m)
        level.append((np.unpackbits(held, axis=1)[:, : len(sizes)], now - before))
        before = now
    out = np.zeros((len(queries), len(sizes)), np.int64)
    for q, (term, times) in enumerate(queries.queries):
        for bitmap, more in level:
            some = bitmap[term]
            # Steps that no document of the block reaches add nothing.
            any_ = some.any(axis=1)
            if not any_.any():
                break
            out[q] += ((times * weights[term])[any_] @ some[any_].astype(np.int64)) * more
    return out


def document_frequencies(docs: DataFrame, queries: QuerySet, text: str = "text") -> np.ndarray:
    """How many texts hold each term of the queries: one row per term and task reaches the shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(queries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value.known), np.int64)
        for batch in batches:
            for part in parts(batch, 0):
                row, term = known.value.find(split(part.column(0), MEMBER))
                pairs = np.unique(row * len(total) + term)
                total += np.bincount(pairs % max(len(total), 1), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(len(queries.known), np.int64)
    found = docs.select(F.col(text).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n"))
    for term, n in found.collect():
        out[term] = n
    return out


def _best_bounds(index: SignatureIndex, known, weights: np.ndarray) -> DataFrame:
    """``(key, queries)``: per query the documents with the best bounds."""
    n_docs, n_terms = index.n_docs, index.n_terms

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = known.value
        top = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)] for _ in range(len(queries))]
        for keys, sizes, width, bits in _blocks(batches):
            found = bounds(queries, weights, n_docs, n_terms, sizes, width, bits)
            missing = np.array(keys.is_null())
            key = keys.fill_null(0).to_numpy()
            for q in range(len(queries)):
                kept = top[q]
                least = kept[0].min() if len(kept[0]) >= FIRST else 0
                some = np.flatnonzero(found[q] > least)
                if len(some):
                    kept = [np.concatenate(x) for x in zip(kept, (found[q][some], key[some], missing[some]))]
                    order = np.argsort(-kept[0], kind="stable")[:FIRST]
                    top[q] = [x[order] for x in kept]
        for q, (bound, key, missing) in enumerate(top):
            if len(bound):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bound), q), pa.int32()), pa.array(bound), pa.array(key, mask=missing)], ["q", "bound", "key"]
                )

    rows = index.blocks.mapInArrow(best, "q int, bound long, key long")
    kept = _leading(rows, [F.desc("bound"), F.col("key")], FIRST)
    return kept.groupBy("key").agg(F.collect_set("q").alias("queries"))


def _leading(rows: DataFrame, order: list, n: int, out: str = "place") -> DataFrame:
    """The first ``n`` rows per query with their place: first within parts of a query, so that none is sorted as a whole."""
    part = F.pmod(F.xxhash64("key"), F.lit(SALT))
    inside = F.row_number().over(Window.partitionBy("q", part).orderBy(*order))
    some = rows.withColumn(out, inside).filter(F.col(out) <= n)
    return some.withColumn(out, F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col(out) <= n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            sizes = batch.column(1)[i].values.to_numpy()
            yield batch.column(0)[i].values, sizes, batch.column(2)[i].as_py(), batch.column(3)[i].as_buffer()


def candidates(index: SignatureIndex, known, weights: np.ndarray, least: np.ndarray) -> DataFrame:
    """``(key, queries)``: every document with the queries whose bound is not below ``least``."""
    n_docs, n_terms = index.n_docs, index.n_terms

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, width, bits in _blocks(batches):
            column, q = np.nonzero((bounds(known.value, weights, n_docs, n_terms, sizes, width, bits) >= np.maximum(least, 1)[:, None]).T)
            if len(column):
                first = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
                offsets = np.concatenate([first, [len(q)]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(q, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(column[first])), lists], ["key", "queries"])

    rows = index.blocks.mapInArrow(choose, "key long, queries array<int>")
    # A set per key, however many documents share it.
    return rows.select("key", F.explode("queries").alias("q")).groupBy("key").agg(F.collect_set("q").alias("queries"))


def score_texts(docs: DataFrame, wanted: DataFrame, known, weights: np.ndarray, index: SignatureIndex, least: np.ndarray) -> DataFrame:
    """``(q, key, score)``: exact scores of ``(key, text)`` for ``wanted(key, queries)``, those of at least ``least``."""
    n_docs, n_terms = index.n_docs, index.n_terms
    pairs = wanted.agg(F.sum(F.size("queries"))).first()[0] or 0
    # Twelve bytes a pair and some for a key: a broadcast of known size; beyond it Spark sorts and merges.
    small = F.broadcast(wanted) if pairs <= BROADCAST_PAIRS else wanted
    small = small.withColumnRenamed("key", "wanted")
    joined = docs.join(small, F.col("key").eqNullSafe(F.col("wanted"))).select("key", "text", "queries")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = known.value
        starts = np.cumsum([0, *(len(t) for t, _ in queries.queries)])
        terms_of = np.concatenate([t for t, _ in queries.queries]) if len(queries) else np.zeros(0, np.int64)
        times_of = np.concatenate([n for _, n in queries.queries]) if len(queries) else np.zeros(0, np.int64)
        wide = max(len(queries.known), 1)
        for batch in batches:
            for part in parts(batch, 1):
                terms = split(part.column(1), MEMBER)
                m = length_part(np.bincount(terms.row, minlength=part.num_rows), n_docs, n_terms)
                row, term = queries.find(terms)
                seen, tf = np.unique(row * wide + term, return_counts=True)
                of_row = pa.compute.list_parent_indices(part.column(2)).to_numpy()
                q = part.column(2).flatten().to_numpy()
                count = starts[q + 1] - starts[q]
                pair = np.repeat(np.arange(len(q)), count)
                at = np.repeat(starts[q] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                wanted_key = of_row[pair] * wide + terms_of[at]
                place = np.minimum(np.searchsorted(seen, wanted_key), max(len(seen) - 1, 0))
                hit = seen[place] == wanted_key if len(seen) else np.zeros(len(at), bool)
                pair, at, place = pair[hit], at[hit], place[hit]
                value = weights[terms_of[at]] * times_of[at] * gain(tf[place], m[of_row[pair]])
                total = np.zeros(len(q), np.int64)
                np.add.at(total, pair, value)
                good = np.flatnonzero(total >= np.maximum(least[q], 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q[good], pa.int32()), part.column(0).take(pa.array(of_row[good])), pa.array(total[good])], ["q", "key", "score"]
                )

    return joined.mapInArrow(score, "q int, key long, score long")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    return _leading(scored, [F.desc("score"), F.asc_nulls_last("key")], top, "rank")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, index: SignatureIndex | None = None, item: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(item, rank, key, score)``: the ``top`` best documents of every query with a score above 0.

    Ties rank by ascending key, null keys last. An index of the same documents may be given, else one is built.

    Nulls: null texts have no terms; null keys are results like others. Repeated documents are results
    each; equal rows of the queries count once, and queries with the same item and other texts, null items too,
    are ranked each. Texts may be of any length. Other columns, whatever their names, are ignored. Without
    documents or queries there are no rows.
    """
    spark = docs.sparkSession
    index = index or SignatureIndex.build(docs, key, text)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    asked = queries.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // QUERY_BYTES))
    kind = asked.schema["item"].dataType
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item", kind)])
    found = []
    for i in range(slices):
        some = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == i).collect()
        found.append(_search_slice(spark, index, rows, [r["text"] for r in some], top).join(
            F.broadcast(spark.createDataFrame([(n, r["item"]) for n, r in enumerate(some)], schema)), "q"
        ))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _search_slice(spark, index: SignatureIndex, rows: DataFrame, texts: list[str], top: int) -> DataFrame:
    queries = QuerySet(texts)
    none = spark.createDataFrame([], "q int, key long, score long, rank int")
    if not queries.known or not index.n_docs:
        return none
    held = document_frequencies(rows, queries)
    weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * int(n) + 1))) for n in held], np.int64)
    known = spark.sparkContext.broadcast(queries)
    first = stored(_best_bounds(index, known, weights), "best-bounds")
    least = np.zeros(len(queries), np.int64)
    sure = _ranked(score_texts(rows, first, known, weights, index, least), top).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    for r in sure.filter(F.col("n") == top).collect():
        least[r["q"]] = r["s"]
    wanted = stored(candidates(index, known, weights, least), "search-candidates")
    return _ranked(score_texts(rows, wanted, known, weights, index, least), top)

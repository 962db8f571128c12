"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of a lower-cased text, hashed into a fixed number of buckets.
How often each occurs per class is counted over *all* labelled rows in Spark. The buckets whose
log-count ratio is most significant become features, valued at that ratio; a logistic regression
over them is fitted on the driver from a bounded sample of the labelled rows, of which only the
features that are present are sent. Scoring is one pass over whole texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .rows import add_columns, parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAMS = (3, 4, 5)
BUCKETS = 1 << 20
FEATURES = 8192
# Labelled rows that the regression is fitted on; the counts take all of them.
SAMPLE_ROWS = 30_000
L2 = 1.0
STEPS = 200
# Sampled rows that the regression goes through at a time.
CHUNK_ROWS = 2_000
THRESHOLD = 0.7


def gram_kernel():
    """A function from a text to the distinct buckets of its n-grams."""
    seen = np.zeros(BUCKETS, np.int64)
    factors = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]

    def buckets(text: str) -> np.ndarray:
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = codes.astype(np.uint64)
        found = []
        rolled = codes
        for n in range(2, max(GRAMS) + 1):
            if len(codes) < n:
                break
            rolled = rolled[:-1] * factors[0] + codes[n - 1 :]
            if n in GRAMS:
                mixed = (rolled ^ (rolled >> np.uint64(29))) * factors[1]
                found.append((mixed >> np.uint64(64 - 20)).astype(np.int64))
        if not found:
            return np.zeros(0, np.int64)
        at = np.concatenate(found)
        # The last position that writes a bucket keeps it: distinct without a sort.
        place = np.arange(len(at))
        seen[at] = place
        return at[seen[at] == place]

    return buckets


def class_counts(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """``(bucket, ones, zeros)``: rows of each class that hold a bucket, over all rows.

    A task adds its rows up before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = gram_kernel()
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in parts(batch, 0):
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counts[int(y)][buckets(t or "")] += 1
        hit = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(hit), 1 << 16):
            some = hit[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, counts[1][some], counts[0][some])], ["bucket", "ones", "zeros"])

    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("int").alias("y"))
    per_task = rows.mapInArrow(count, "bucket long, ones long, zeros long")
    return per_task.groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


@dataclass
class ToxicityModel:
    """``weight`` per bucket (ratio times coefficient, 0 for those that are not features) and ``bias``."""

    weight: np.ndarray
    bias: float

    def score(self, docs: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """Add the probability of label 1; every text has one, the empty text too."""
        weight, bias = self.weight, self.bias
        # Bounded by BUCKETS: four bytes each.
        shared = docs.sparkSession.sparkContext.broadcast(weight.astype(np.float32))

        def kernel():
            buckets, w = gram_kernel(), shared.value

            def run(texts: list[str]) -> list[list]:
                raw = np.array([float(w[buckets(t)].sum(dtype=np.float64)) for t in texts]) + bias
                return [(1 / (1 + np.exp(-np.clip(raw, -500, 500)))).tolist()]

            return run

        return add_columns(docs, text, f"{out} double", kernel)


def _fit(flat: np.ndarray, offsets: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with ridge penalty, both classes weighing the same, by accelerated descent.

    Row ``i`` has the features ``flat[offsets[i]:offsets[i + 1]]``. Rows are gone through in chunks, so
    that besides the sample itself only a chunk is held.
    """
    n, size = len(y), len(ratio)
    scale = max(1e-9, np.abs(ratio).max())
    value = ratio / scale
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def forward(w: np.ndarray) -> np.ndarray:
        z, weighted = np.empty(n), value * w
        for a in range(0, n, CHUNK_ROWS):
            b = min(n, a + CHUNK_ROWS)
            sums = np.concatenate([[0.0], np.cumsum(weighted[flat[offsets[a] : offsets[b]]])])
            at = offsets[a : b + 1] - offsets[a]
            z[a:b] = sums[at[1:]] - sums[at[:-1]]
        return z

    def backward(g: np.ndarray) -> np.ndarray:
        total = np.zeros(size)
        for a in range(0, n, CHUNK_ROWS):
            b = min(n, a + CHUNK_ROWS)
            spread = np.repeat(g[a:b], np.diff(offsets[a : b + 1]))
            total += np.bincount(flat[offsets[a] : offsets[b]], spread, size)
        return total * value

    # Lipschitz bound of the gradient from a few power iterations.
    v, norm = np.ones(size), 1.0
    for _ in range(20):
        v = backward(share * forward(v))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    penalty = L2 / max(1, n)
    rate = 1 / (0.25 * (norm + 1) + penalty)
    w, b = np.zeros(size), 0.0
    pw, pb = w, b
    for step in range(STEPS):
        m = step / (step + 3)
        lw, lb = w + m * (w - pw), b + m * (b - pb)
        g = share * (1 / (1 + np.exp(-np.clip(forward(lw) + lb, -500, 500))) - y)
        pw, pb = w, b
        w = lw - rate * (backward(g) + penalty * lw)
        b = lb - rate * g.sum()
    return w / scale, b


def _totals(rows: DataFrame, label: str) -> tuple[int, int]:
    counted = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    return counted.get(0, 0), counted.get(1, 0)


def _drawn(order: Column, total: int, sample_rows: int) -> Column:
    # Rows below a hash value, so that a draw never sorts all rows. It aims a little under the bound.
    cut = int(-(2**63) + min(1.0, 0.97 * sample_rows / total) * (2**64 - 1)) if total > sample_rows else 2**63 - 1
    return F.xxhash64(order) <= F.lit(cut)


def _constant(zeros: int, ones: int) -> ToxicityModel:
    side = 0.0 if not zeros and not ones else (2.0 if ones else -2.0)
    return ToxicityModel(np.zeros(BUCKETS, np.float32), side)


def _fit_drawn(
    counts: DataFrame, sample: DataFrame, zeros: int, ones: int, text: str, label: str, features: int, sample_rows: int
) -> ToxicityModel:
    """The model of the counts over all rows and of the drawn rows."""
    p, q = (F.col("ones") + 1) / (ones + 2), (F.col("zeros") + 1) / (zeros + 2)
    ratio = F.log(p / (1 - p)) - F.log(q / (1 - q))
    # Ratio over its standard error: rare buckets with large ratios by chance come last.
    error = F.sqrt(
        1 / (F.col("ones") + 1) + 1 / (ones - F.col("ones") + 1) + 1 / (F.col("zeros") + 1) + 1 / (zeros - F.col("zeros") + 1)
    )
    ranked = counts.select("bucket", ratio.alias("ratio"), F.abs(ratio / error).alias("z"))
    chosen = ranked.orderBy(F.desc("z"), "bucket").limit(features).collect()
    index = np.full(BUCKETS, -1, np.int32)
    index[[r["bucket"] for r in chosen]] = np.arange(len(chosen))
    ratios = np.array([r["ratio"] for r in chosen])

    def kernel():
        buckets = gram_kernel()

        def run(texts: list[str]) -> list[list]:
            res = []
            for t in texts:
                at = index[buckets(t)]
                res.append(at[at >= 0].tolist())
            return [res]

        return run

    drawn = sample.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    rows = stored(add_columns(drawn, "t", "present array<int>", kernel).select("present", "y"), "toxicity-sample")
    # Only rows with very many copies of a key go over the bound; a limit puts all rows into one task.
    if rows.count() > sample_rows:
        rows = rows.limit(sample_rows)
    # As Arrow, four bytes a feature: rows of Python objects would be ten times as large.
    found = rows.toArrow().combine_chunks()
    y = found["y"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(ones / zeros)))
    sizes = pa.compute.list_value_length(found["present"]).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    flat = pa.compute.list_flatten(found["present"]).to_numpy()
    w, bias = _fit(flat, offsets, y, ratios)
    weight = np.zeros(BUCKETS, np.float32)
    weight[[r["bucket"] for r in chosen]] = w * ratios
    return ToxicityModel(weight, float(bias))


def fit(
    labelled: DataFrame,
    text: str = "text",
    label: str = "label",
    order: Column | None = None,
    features: int = FEATURES,
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Fit on rows with labels 0 and 1; rows with a null label are left out, null texts are empty.

    ``order`` is the key of the sample: about ``sample_rows`` rows of smallest hash, never more, are
    drawn, so it repeats exactly. Without rows of both classes the score is 0.5 or, with one class,
    the side of it that the class is on.
    """
    src = labelled.filter(F.col(label).isNotNull())
    zeros, ones = _totals(src, label)
    if not zeros or not ones:
        return _constant(zeros, ones)
    sample = src.filter(_drawn(order if order is not None else F.col(text), zeros + ones, sample_rows))
    return _fit_drawn(class_counts(src, text, label), sample, zeros, ones, text, label, features, sample_rows)


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def known_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, label)``, one row per key, of the labels 0 and 1 that are not held out."""
    known = labels.select(F.col(key).alias(key), F.col("toxic").alias("label")).filter("label in (0, 1)")
    return known.filter(~held_out(F.col(key))).groupBy(key).agg(F.max("label").alias("label"))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, label)`` of the labelled documents that are not held out.

    Documents or labels without a key are never joined, and neither are labels other than 0 and 1.
    """
    src = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    # Labels grow with the corpus: the join is the same at every size.
    return src.join(known_labels(labels, key).hint("merge"), key)


def fit_on(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    features: int = FEATURES,
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """``fit`` on the training rows of ``docs``; texts are shuffled once, for the counts.

    Totals come from keys alone. The sample is drawn among the keys, too: at most twice its bound,
    they are broadcast to the documents.
    """
    keys = docs.select(F.col(key).alias(key)).join(known_labels(labels, key), key)
    zeros, ones = _totals(keys, "label")
    if not zeros or not ones:
        return _constant(zeros, ones)
    drawn = keys.filter(_drawn(F.col(key), zeros + ones, sample_rows)).distinct().limit(2 * sample_rows)
    drawn = stored(drawn, "toxicity-drawn")
    sample = docs.select(F.col(key).alias(key), F.col(text).alias("text")).join(F.broadcast(drawn), key)
    counts = class_counts(training_rows(docs, labels, key, text), "text", "label")
    return _fit_drawn(counts, sample, zeros, ones, "text", "label", features, sample_rows)

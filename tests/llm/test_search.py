"""Ranked search against scoring every document, and bounds against scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import lower
from pyspark.sql import functions as F

from blockloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [lower(w) for w in TERM.findall(text or "")]


def scores(docs, text):
    """Scores of all documents for one query."""
    every = [Counter(words(t)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, every)), sum(sum(c.values()) for c in every)
    df = Counter(t for c in every for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for c in every:
        m = 75 + 25 * sum(c.values()) * n_docs // n_terms if n_terms else 0
        out.append(sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c))
    return out


def ranked(docs, items, top=20):
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        found = sorted((-s, d is None, d or 0, d) for (d, _), s in zip(docs, scores(docs, text)) if s > 0)
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(found[:top], 1)]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé日1") for _ in range(rng.choice([1, 2, 4, 6, 8, 9, 13, 16, 17, 30, 70]))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=int(rng.paretovariate(0.7) * 3) % 900))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(50)] + [(None, docs[3][1]), (None, None), (2000, ""), (5, docs[9][1]), (5, docs[9][1])]
    docs += [(2001, (vocab[0] + " ") * 40_000 + vocab[350]), (2002, "z" * 100_000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 40))) + (" " + vocab[2].upper()) * (i % 3)) for i in range(12)]
    items += [(50, docs[7][1]), (51, None), (52, "nothing-such"), (53, "z" * 100_000), (None, vocab[1]), (3, vocab[5]), (50, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    table = table.withColumns({c: F.lit(1) for c in ("key", "q", "score", "rank", "queries", "item", "item_id", "wanted")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = search.search(table, asked).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == ranked(docs, items)


def test_slices_and_joins_give_the_same(spark, monkeypatch):
    docs, items = corpus(3, 150)
    monkeypatch.setattr(search, "QUERY_BYTES", 400)
    monkeypatch.setattr(search, "BROADCAST_PAIRS", 0)
    items = [i for i in items if i[0] != 53]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = search.search(table, spark.createDataFrame(items, "item_id long, text string"), top=5).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == ranked(docs, items, 5)


def test_search_of_nothing(spark):
    docs, items = corpus(1, 20)
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert search.search(table.limit(0), asked).collect() == []
    assert search.search(table, asked.limit(0)).collect() == []


def test_bounds_are_never_below_scores_and_mostly_close():
    docs, items = corpus(4)
    texts = [t for _, t in items]
    queries = search.QuerySet(["" if t is None else t for t in texts])
    exact = np.array([scores(docs, t) for t in texts])
    every = [set(words(t)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, every)), sum(len(words(t)) for _, t in docs)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in e for e in every) + 1))) for t in queries.known])
    seen, close, total = set(), 0, 0
    for rows, sizes, width, bits in search.signature_blocks(pa.array([t for _, t in docs])):
        found = search.bounds(queries, weights, n_docs, n_terms, sizes.astype(np.int32), width, bits)
        assert (found >= exact[:, rows]).all()
        close += int((found <= exact[:, rows] * 1.05).sum())
        total += found.size
        seen.update(rows.tolist())
        assert np.unpackbits(np.frombuffer(bits, np.uint8)).mean() <= search.DENSITY + 0.05
    assert seen == {i for i, e in enumerate(every) if e}
    assert close > 0.5 * total


def test_terms_are_compared_byte_by_byte():
    queries = search.QuerySet(["abc abcdefgh abcdefghi " + "x" * 30])
    texts = pa.array(["abc ab abcd", "abcdefgh abcdefghi abcdefghj", "x" * 30 + " " + "x" * 29 + "y " + "x" * 31])
    row, term = queries.find(search.split(texts, search.MEMBER))
    assert [(r, queries.known[t]) for r, t in zip(row, term)] == [(0, "abc"), (1, "abcdefgh"), (1, "abcdefghi"), (2, "x" * 30)]


def test_an_index_serves_many_searches(spark):
    docs, items = corpus(5, 100)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    index = search.SignatureIndex.build(table)
    for some in (items[:4], items[4:8]):
        got = search.search(table, spark.createDataFrame(some, "item_id long, text string"), index=index).collect()
        assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == ranked(docs, some)

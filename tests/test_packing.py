"""Packing against a literal model: shards → batches of rows → concatenate → cut."""

import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import packing as P


def model_shards(n, k):
    k = max(1, min(k, n))
    sizes = [n // k + (1 if s < n % k else 0) for s in range(k)]
    bounds, at = [], 0
    for size in sizes:
        bounds.append((at, at + size))
        at += size
    return bounds


def model(docs, n_shards, batch_rows, block):
    """docs: list of token lists in order → {(shard, batch, blk): tokens}"""
    blocks = {}
    for shard, (lo, hi) in enumerate(model_shards(len(docs), n_shards)):
        part = docs[lo:hi]
        for batch in range(0, len(part), batch_rows):
            joined = [t for d in part[batch : batch + batch_rows] for t in d]
            total = len(joined)
            if total >= block:
                total = total // block * block
            for at in range(0, total, block):
                blocks[shard, batch // batch_rows, at // block] = joined[at : at + block]
    return blocks


def corpus(spec):
    """spec: {split: [lengths]} → rows with increasing, gappy keys, and the token lists."""
    rows, lists, key = [], {}, 3
    for split, lengths in spec.items():
        lists[split] = []
        for n in lengths:
            tokens = [key * 1000 + i for i in range(n)]
            rows.append((split, key, tokens))
            lists[split].append(tokens)
            key += random.Random(key).randrange(1, 9)
    return rows, lists


def run(spark, rows, n_shards, batch_rows, block, buckets=None):
    df = spark.createDataFrame(rows, "split string, key long, input_ids array<int>").repartition(3)
    df = df.withColumn("other", F.transform("input_ids", lambda x: -x))
    placed = P.assign_batches(df, "key", n_shards, batch_rows, buckets=buckets)
    return P.pack(placed, block, "key", ("input_ids", "other"))


def check(spark, spec, n_shards, batch_rows, block, buckets=None):
    rows, lists = corpus(spec)
    got = {}
    for r in run(spark, rows, n_shards, batch_rows, block, buckets).collect():
        assert r["other"] == [-x for x in r["input_ids"]]
        got[r["split"], r["shard"], r["batch"], r["blk"]] = list(r["input_ids"])
    want = {}
    for split, docs in lists.items():
        for k, v in model(docs, n_shards, batch_rows, block).items():
            want[(split, *k)] = v
    assert got == want


def lengths(seed, n, hi):
    rnd = random.Random(seed)
    return [rnd.choice([0, rnd.randrange(hi), rnd.randrange(3)]) for _ in range(n)]


CASES = {
    "plain": ({"train": lengths(1, 60, 40), "val": lengths(2, 9, 40)}, 4, 7, 16, 5),
    "one row per batch": ({"train": lengths(3, 30, 40)}, 3, 1, 8, 4),
    "more shards than rows": ({"train": lengths(4, 5, 30)}, 9, 2, 8, 3),
    "block beyond every batch": ({"train": lengths(5, 20, 10)}, 2, 3, 1000, 3),
    "exact multiple": ({"train": [8, 8, 16, 4, 4]}, 1, 10, 8, 1),
    "one long document": ({"train": [3, 400, 2]}, 1, 10, 16, 2),
    "empty token lists": ({"train": [0, 0, 0], "val": [0, 5]}, 1, 2, 4, 2),
    "uneven splits": ({"a": lengths(6, 50, 20), "b": [7], "c": lengths(7, 3, 90)}, 4, 5, 11, 16),
}


@pytest.mark.parametrize("case", CASES)
def test_pack_equals_model(spark, case):
    check(spark, *CASES[case])


@pytest.mark.parametrize("case", ["plain", "uneven splits"])
def test_pack_with_join_by_key(spark, monkeypatch, case):
    monkeypatch.setattr(P, "MAX_BROADCAST_STARTS", 0)
    check(spark, *CASES[case])


@pytest.mark.parametrize("case", ["plain", "one long document"])
def test_pack_over_many_spans(spark, monkeypatch, case):
    monkeypatch.setattr(P, "SPAN_TOKENS", 33)
    check(spark, *CASES[case])


def test_empty_corpus(spark):
    assert run(spark, [], 4, 10, 8).count() == 0


def test_partitions_do_not_matter(spark):
    rows, _ = corpus(CASES["plain"][0])
    results = []
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(map(str, run(spark, rows, 4, 7, 16).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


@pytest.mark.parametrize("n,k", [(10, 3), (3, 10), (1, 1), (12, 4), (7, 2)])
def test_shards(spark, n, k):
    idx = spark.range(n).withColumnRenamed("id", "row_idx")
    df = P.map_batches(P.shard_contiguous(idx, F.lit(n).cast("long"), k), F.lit(n).cast("long"), k, 2)
    want = {i: (s, (i - lo) // 2) for s, (lo, hi) in enumerate(model_shards(n, k)) for i in range(lo, hi)}
    assert {r["row_idx"]: (r["shard"], r["batch"]) for r in df.collect()} == want


def test_tokens_in_are_kept_or_dropped(spark):
    rows, lists = corpus(CASES["plain"][0])
    _, n_shards, batch_rows, block, _ = CASES["plain"]
    df = spark.createDataFrame(rows, "split string, key long, input_ids array<int>")
    placed = P.assign_batches(df, "key", n_shards, batch_rows)
    totals = P.batch_totals(placed.withColumn("n_tokens", F.size("input_ids")))
    loss = P.pack_loss(totals, block).agg(F.sum("tokens"), F.sum("dropped")).first()
    blocks = P.pack(placed, block, "key")
    kept = blocks.agg(F.sum(F.size("input_ids"))).first()[0]
    assert loss[0] == sum(len(d) for docs in lists.values() for d in docs) == kept + loss[1]
    histogram = P.pack_validate(P.pack(placed, block, "key"), ("input_ids",)).collect()
    assert sum(r["blocks"] for r in histogram) == blocks.count()
    assert all(r["uneven"] == 0 for r in histogram)
    numbered = P.number_blocks(blocks, totals, block)
    indexed = {tuple(r[:5]): r["length"] for r in P.index_blocks(totals, block).collect()}
    got = {
        (r["split"], r["shard"], r["batch"], r["blk"], r["block_idx"]): len(r["input_ids"]) for r in numbered.collect()
    }
    assert got == indexed
    per_split = {}
    for split, *_, i in got:
        per_split.setdefault(split, []).append(i)
    assert all(sorted(v) == list(range(len(v))) for v in per_split.values())
    counts = {r["split"]: r["n"] for r in P.block_counts(totals, block).collect()}
    assert counts == {s: len(v) for s, v in per_split.items()}


def test_bad_block_size(spark):
    with pytest.raises(ValueError):
        P.pack(spark.range(1), 0, "id")

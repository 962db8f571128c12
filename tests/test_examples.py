"""Epoch positions, ranks, steps, padding and labels."""

import math

import pytest
from pyspark.sql import functions as F

from blockloom.functions import draws as D
from blockloom.functions.permute import Permutation
from blockloom.operators import collate as C
from blockloom.operators import loading as L


def blocks(spark, n, split="train"):
    return spark.range(n).select(F.lit(split).alias("split"), F.col("id").alias("block_idx")).repartition(3)


def positions(df):
    return {r["block_idx"]: r["pos"] for r in df.collect()}


def test_shuffle_is_a_repeatable_permutation(spark):
    df = blocks(spark, 300)
    first = positions(L.shuffle(df, 7, 0))
    assert sorted(first.values()) == list(range(300))
    assert first == positions(L.shuffle(df.repartition(2), 7, 0))
    assert first != positions(L.shuffle(df, 7, 1))
    assert first != positions(L.shuffle(df, 8, 0))
    assert first != {i: i for i in range(300)}


@pytest.mark.parametrize("n,world", [(10, 4), (8, 4), (3, 8), (1, 5), (7, 1)])
def test_ranks_get_equal_slices(spark, n, world):
    df = blocks(spark, n).withColumn("pos", F.col("block_idx"))
    dealt = L.shard_by_rank(df, world).collect()
    padded = math.ceil(n / world) * world
    want = sorted((p % world, p // world, p % n, p >= n) for p in range(padded))
    assert sorted((r["rank"], r["pos"], r["block_idx"], r["is_pad"]) for r in dealt) == want


def test_given_counts_replace_counting(spark):
    df = blocks(spark, 10).withColumn("pos", F.col("block_idx"))
    counts = spark.createDataFrame([("train", 10)], "split string, n long")
    assert sorted(map(str, L.shard_by_rank(df, 4, counts=counts).collect())) == sorted(
        map(str, L.shard_by_rank(df, 4).collect())
    )


def test_batches_limit_and_steps(spark):
    df = L.batches(blocks(spark, 11).withColumn("pos", F.col("block_idx")), 4)
    sizes = {r["batch_idx"]: r["count"] for r in df.groupBy("batch_idx").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 3}
    assert L.limit_eval(df, -1, 4).count() == 11
    assert L.limit_eval(df, 9, 4).count() == 8
    assert L.limit_eval(df, 3, 4).count() == 0
    steps = L.check_steps(L.accumulate(df, 2), 8).collect()
    assert {(r["step"], r["rows"], r["full"]) for r in steps} == {(0, 8, True), (1, 3, False)}


def test_due_steps(spark):
    df = L.due_steps(spark.range(1, 25).withColumnRenamed("id", "passes"), 3, 2, 4).collect()
    # Four passes make a step: evaluations at steps 1 (first), 3 and 6, saves at 2, 4 and 6.
    assert [r["passes"] for r in df if r["eval_due"]] == [4, 12, 24]
    assert [r["passes"] for r in df if r["save_due"]] == [8, 16, 24]
    never = L.due_steps(spark.range(1, 9).withColumnRenamed("id", "passes"), 0, 0, 1, at_first=False).collect()
    assert not any(r["eval_due"] or r["save_due"] for r in never)


def test_pad_to_the_longest_of_the_batch(spark):
    rows = [(0, [5, 6, 7]), (0, [5]), (1, list(range(5, 14))), (2, [])]
    df = spark.createDataFrame(rows, "batch_idx long, input_ids array<int>")
    df = df.withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))
    df = df.withColumn("special_tokens_mask", F.transform("input_ids", lambda x: F.lit(0)))
    for multiple, widths in ((8, {0: 8, 1: 16, 2: 0}), (None, {0: 3, 1: 9, 2: 0})):
        wide = C.batch_width(df, F.size("input_ids"), multiple, by=("batch_idx",))
        for r in C.pad(wide).collect():
            n = sum(r["attention_mask"])
            assert r["width"] == widths[r["batch_idx"]] == len(r["input_ids"]) == len(r["attention_mask"])
            assert r["input_ids"][n:] == [0] * (r["width"] - n)
            assert r["special_tokens_mask"] == [0] * n + [1] * (r["width"] - n)


def test_causal_labels(spark):
    df = spark.createDataFrame([([7, 0, 8, 0],)], "input_ids array<int>")
    assert C.labels_clm(df).first()["labels"] == [7, -100, 8, -100]


def masked(spark, p, seed=1, epoch=0, special=0, n=5000):
    df = spark.range(4).select(
        F.col("id").alias("block"),
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i + 100).alias("input_ids"),
        F.array_repeat(F.lit(special), n).alias("special_tokens_mask"),
    )
    return C.labels_mlm(df, 50_000, p, seed, epoch, keys=("block",))


def flat(df):
    rows = df.orderBy("block").collect()
    return [x for r in rows for x in zip(r["input_ids"], r["labels"], r["actions"])]


def test_masking_rates_and_consistency(spark):
    cells = flat(masked(spark, 0.15))
    share = [sum(a == k for *_, a in cells) / len(cells) for k in range(4)]
    assert share == pytest.approx([0.85, 0.12, 0.015, 0.015], abs=0.01)
    for at, (new, label, action) in enumerate(cells):
        old = at % 5000 + 100
        assert label == (-100 if action == C.NONE else old)
        if action in (C.NONE, C.KEEP):
            assert new == old
        if action == C.MASK:
            assert new == 4
    drawn = [new for new, _, a in cells if a == C.RANDOM]
    assert min(drawn) >= 0 and max(drawn) < 50_000 and len(set(drawn)) > 0.9 * len(drawn)


def test_masking_extremes(spark):
    assert {a for *_, a in flat(masked(spark, 0.0, n=50))} == {C.NONE}
    assert C.NONE not in {a for *_, a in flat(masked(spark, 1.0, n=50))}
    assert {a for *_, a in flat(masked(spark, 1.0, special=1, n=50))} == {C.NONE}
    assert flat(masked(spark, 0.5, n=1)) and len(flat(masked(spark, 0.5, n=3))) == 12


def test_epochs_differ_and_repeat(spark):
    first = flat(masked(spark, 0.15, epoch=0, n=200))
    assert first == flat(masked(spark, 0.15, epoch=0, n=200))
    assert first != flat(masked(spark, 0.15, epoch=1, n=200))


def test_empty_row_is_left_alone(spark):
    df = spark.createDataFrame([(1, [], [])], "block long, input_ids array<int>, special_tokens_mask array<int>")
    row = C.labels_mlm(df, 10, keys=("block",)).first()
    assert row["labels"] == row["input_ids"] == row["actions"] == []


def test_objective_dispatch(spark):
    df = spark.createDataFrame([(1, [0, 5], [0, 0])], "block long, input_ids array<int>, special_tokens_mask array<int>")
    assert C.objective(df, "clm").first()["labels"] == [-100, 5]
    assert "actions" in C.objective(df, "mlm", vocab_size=9, keys=("block",)).columns
    with pytest.raises(ValueError):
        C.objective(df, "other")


def test_thresholds():
    assert D.threshold(0) == "00000000"
    assert D.threshold(0.5) == "80000000"
    assert D.threshold(1.0) > "ffffffff"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 16, 17, 99, 1000, 12_345])
def test_permutation_meets_every_block_once_and_turns_back(spark, n):
    order = Permutation(n, 5, 2)
    df = spark.range(n).select("id", order.block_at(F.col("id")).alias("b"))
    rows = df.select("id", "b", order.position_of(F.col("b")).alias("back")).collect()
    assert sorted(r["b"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)
    if n >= 99:
        other = [r[0] for r in spark.range(n).select(Permutation(n, 5, 3).block_at(F.col("id"))).collect()]
        assert sum(a == r["b"] for a, r in zip(other, rows)) < n / 10
        assert sum(r["id"] == r["b"] for r in rows) < n / 10


def test_a_resumed_epoch_is_the_rest_of_the_whole_one(spark):
    order = Permutation(103, 1, 0)
    whole = L.resume_epoch(spark, order, 4, 3, 2)
    rows = whole.collect()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert sorted(r["block_idx"] for r in rows if not r["is_pad"]) == list(range(103)) and len(rows) == 104
    assert all(0 <= r["slot"] < 3 and r["step"] == r["batch_idx"] // 2 for r in rows)
    for step in (1, 3, 50):
        rest = L.resume_epoch(spark, order, 4, 3, 2, step).collect()
        assert sorted(map(tuple, rest)) == sorted(tuple(r) for r in rows if r["step"] >= step)
    assert L.resume_epoch(spark, Permutation(0, 1, 0), 4, 3, 2).collect() == []

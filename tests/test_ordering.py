"""Order-sensitive operators against plain Python, with one hot group and repeated keys."""

import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import ordering as O


def rows(seed, n=400):
    rnd = random.Random(seed)
    res = []
    for i in range(n):
        group = "hot" if rnd.random() < 0.4 else f"g{rnd.randrange(12)}"
        # A third of all rows share one order value, told apart by the tie-breaker only.
        key = 500 if rnd.random() < 0.35 else rnd.randrange(1000)
        res.append((group, key, i, rnd.randrange(100), rnd.randrange(50) if rnd.random() < 0.5 else None))
    rnd.shuffle(res)
    return res


def frame(spark, data):
    return spark.createDataFrame(data, "g string, k long, id long, v long, opt long").repartition(5)


def ordered(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("seed,buckets", [(1, 7), (2, 1), (3, 40)])
def test_dense_index(spark, seed, buckets):
    data = rows(seed)
    df = O.dense_index(frame(spark, data), F.col("k"), by=("g",), tie=F.col("id"), buckets=buckets)
    got = {r["id"]: r["row_idx"] for r in df.collect()}
    want = {r[2]: i for group in ordered(data).values() for i, r in enumerate(group)}
    assert got == want


def test_dense_index_over_everything(spark):
    data = rows(4)
    df = O.dense_index(frame(spark, data), -F.col("k"), tie=-F.col("id"), buckets=9)
    got = {r["id"]: r["row_idx"] for r in df.collect()}
    want = {r[2]: i for i, r in enumerate(sorted(data, key=lambda r: (-r[1], -r[2])))}
    assert got == want


def test_hot_order_value_is_spread(spark):
    data = rows(5, 3000)
    df = O.with_bucket(frame(spark, data), F.col("k"), tie=F.col("id"), buckets=8)
    sizes = [r["count"] for r in df.groupBy(O.BUCKET).count().collect()]
    assert max(sizes) < len(data) * 0.2


@pytest.mark.parametrize("buckets", [1, 6])
def test_running_sum(spark, buckets):
    data = rows(6)
    df = O.running_sum(
        frame(spark, data), {"a": F.col("v"), "b": F.col("opt")}, F.col("k"), ("g",), F.col("id"), buckets=buckets
    )
    got = {r["id"]: (r["a"], r["b"]) for r in df.collect()}
    want = {}
    for group in ordered(data).values():
        a = b = 0
        for r in group:
            a, b = a + r[3], b + (r[4] or 0)
            want[r[2]] = (a, b)
    assert got == want


@pytest.mark.parametrize("buckets", [1, 6])
def test_forward_fill(spark, buckets):
    data = rows(7)
    df = O.forward_fill(frame(spark, data), {"f": F.col("opt")}, F.col("k"), ("g",), F.col("id"), buckets=buckets)
    want = {}
    for group in ordered(data).values():
        last = None
        for r in group:
            last = r[4] if r[4] is not None else last
            want[r[2]] = last
    assert {r["id"]: r["f"] for r in df.collect()} == want


@pytest.mark.parametrize("buckets", [1, 6])
def test_previous_value(spark, buckets):
    data = rows(8)
    df = O.previous_value(frame(spark, data), F.col("v"), "p", F.col("k"), ("g",), F.col("id"), buckets=buckets)
    want = {}
    for group in ordered(data).values():
        last = None
        for r in group:
            want[r[2]], last = last, r[3]
    assert {r["id"]: r["p"] for r in df.collect()} == want


def test_group_value(spark):
    data = rows(9)
    values = {"hi": (F.max, F.col("k")), "all": (F.sum, F.col("v"))}
    df = O.group_value(frame(spark, data), values, ("g",), F.pmod(F.col("id"), F.lit(5)))
    groups = ordered(data)
    for r in df.collect():
        group = groups[r["g"]]
        assert (r["hi"], r["all"]) == (max(x[1] for x in group), sum(x[3] for x in group))
    assert df.count() == len(data)


def test_upper_bound(spark):
    values = [2, 5, 5, 9]
    df = spark.range(12).select(
        "id", O.upper_bound(F.col("id"), F.array(*[F.lit(v) for v in values]), len(values)).alias("n")
    )
    assert {r["id"]: r["n"] for r in df.collect()} == {i: sum(v <= i for v in values) for i in range(12)}

"""The hash tree against a plain descent, and what moves when weights change."""

import math
import zlib
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from blockloom.llm import sharding
from blockloom.llm.sharding import ShardTree


def descend(tree, key):
    text = "" if key is None else str(key)

    def winner(weights, names):
        draws = []
        for i, (w, name) in enumerate(zip(weights, names)):
            u = (int(md5(f"{text}|{name}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60
            if w > 0:
                draws.append((-math.log(u) / w, i))
        return min(draws)[1]

    regions = tree.weights
    top = [sum(map(sum, r)) for r in regions] + list(tree.grafts)
    r = winner(top, [*range(len(regions)), *(f"+{i}" for i in range(len(tree.grafts)))])
    base = sum(len(k) for x in regions for k in x)
    if r >= len(regions):
        return base + r - len(regions)
    k = winner([sum(x) for x in regions[r]], [f"{r}.{i}" for i in range(len(regions[r]))])
    s = winner(regions[r][k], [f"{r}.{k}.{i}" for i in range(len(regions[r][k]))])
    return sum(len(x) for y in regions[:r] for x in y) + sum(len(x) for x in regions[r][:k]) + s


UNEVEN = ShardTree((((1, 2.5), (0, 4, 1)), ((3,), (0.5, 0)), ((0, 0),)))


@pytest.mark.parametrize("tree", [ShardTree.even(2, 4, 5).with_shard(), UNEVEN, UNEVEN.with_shard(2).with_shard(0), ShardTree.even(1, 1, 1)])
def test_placement_equals_plain_descent(spark, tree):
    keys = [*range(-3, 1500), None, 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", tree.place(F.col("k")).alias("s"))
    assert {r["k"]: r["s"] for r in df.collect()} == {k: descend(tree, k) for k in keys}


def placed(spark, tree, n=20_000):
    return [r[0] for r in spark.range(n).select(tree.place(F.col("id"))).collect()]


def test_rows_follow_the_weights(spark):
    counts = Counter(placed(spark, UNEVEN))
    flat = [w for r in UNEVEN.weights for k in r for w in k]
    for shard, w in enumerate(flat):
        want = 20_000 * w / sum(flat)
        assert abs(counts[shard] - want) <= 5 * math.sqrt(want)


def test_a_new_shard_takes_rows_only_into_itself(spark):
    tree = ShardTree.even(2, 4, 5)
    for grown in (tree.with_shard(), tree.with_shard().with_shard(3.0)):
        before, after = placed(spark, tree), placed(spark, grown)
        moved = [(a, b) for a, b in zip(before, after) if a != b]
        assert moved and all(b >= 40 for _, b in moved)
        assert abs(len(moved) - 20_000 * sum(grown.grafts) / (40 + sum(grown.grafts))) < 200


@pytest.mark.parametrize("weight", [0.0, 3.0])
def test_movement_stays_in_the_subtrees_that_change(spark, weight):
    tree = ShardTree.even(3, 2, 4)
    before, after = placed(spark, tree), placed(spark, tree.with_weight(1, 0, 2, weight))
    changed = range(8, 16)
    for a, b in zip(before, after):
        if a != b:
            # Growing takes rows into the region or moves them inside, shrinking gives them away.
            assert b in changed if weight > 1 else a in changed
            assert weight < 1 or (a not in range(8, 12)) or b == 10 or b in range(8, 12)
    assert sum(a != b for a, b in zip(before, after)) < 20_000 / 5


def test_assignment(spark, docs, texts, empty):
    tree = ShardTree.even(2, 4, 5)
    clashing = docs.withColumns({c: F.lit("x") for c in ("shard", "slot", "size", "grown", "key", "crc", "__bl_row")})
    got = sharding.assign_shards(clashing, tree, tree.with_shard()).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), descend(tree, i), descend(tree.with_shard(), i)) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["crc"], r["shard"], r["grown"]) for r in got) == want
    for shard in range(40):
        rows = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
        assert ids == sorted(ids)
    assert sharding.assign_shards(empty, tree).collect() == []
    moved = sharding.movement(sharding.assign_shards(docs, tree, tree.with_shard())).collect()
    assert sum(r["n_rows"] for r in moved) == len(texts) and all(r["shard"] == r["grown"] or r["grown"] == 40 for r in moved)


def test_a_key_of_many_rows_still_has_gapless_slots(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.assign_shards(rows.repartition(4), ShardTree.even(1, 2, 2))
    per = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    assert all(r["n"] == r["d"] == r["hi"] + 1 and r["lo"] == 0 for r in per.collect())


def test_written_shards_hold_every_row(spark, docs, texts, empty, tmp_path):
    tree = ShardTree.even(1, 2, 3)
    sharding.write_shards(docs.withColumn("shard", F.lit("old")), str(tmp_path / "out"), tree, file_bytes=20_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in back.collect()) == Counter((i, t, descend(tree, i)) for i, t in texts)
    sharding.write_shards(empty, str(tmp_path / "none"), tree)


def test_weights_are_checked():
    for bad in ((((-1,),),), (((0,),),), (((float("nan"),),),), ()):
        with pytest.raises(ValueError):
            ShardTree(bad)

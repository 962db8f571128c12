"""Versions of prepared datasets: what a reader sees while writers come, fail and meet."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from blockloom.operators import tokens as T
from blockloom.plans.prepare import prepare, prepare_incremental
from blockloom.sources import prepared as S
from blockloom.sources.store import OtherWriter, PreparedStore


@pytest.fixture(scope="module")
def vocab(spark):
    return T.load_vocab(T.build_vocab(spark.createDataFrame([("a b c d e f g h . ,",)], "text string"), 50))


def rows(spark, n):
    ids = F.transform(F.sequence(F.lit(1), F.col("id") % 3 + 1), lambda x: x.cast("int"))
    return spark.range(n).select(F.lit("train").alias("split"), "id", ids.alias("input_ids"), ids.alias("special_tokens_mask"))


def test_a_writer_that_breaks_off_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "p")
    S.save_prepared(rows(spark, 30), path)
    reader = S.load_prepared(spark, path)
    failing = rows(spark, 40).withColumn("id", F.when(F.col("id") == 35, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(PySparkException):
        S.save_prepared(failing.repartition(4), path, overwrite=True)
    assert S.load_prepared(spark, path).count() == reader.count() == 30
    store = PreparedStore(spark, path)
    assert store.versions() == [0] and len(store.unused()) <= 1
    # A manifest that was cut off counts for nothing, and its number is not used again.
    with open(f"{path}/commits/00000001.json", "w") as f:
        f.write('{"version": 1, "entries": []')
    assert S.load_prepared(spark, path).count() == 30
    S.save_prepared(rows(spark, 7), path, overwrite=True)
    assert PreparedStore(spark, path).versions() == [0, 2]
    assert S.load_prepared(spark, path).count() == 7
    # Who reads the old version goes on reading it.
    assert reader.count() == 30 == PreparedStore(spark, path).load(0).count()


def test_of_two_writers_one_wins(spark, tmp_path):
    store = PreparedStore(spark, str(tmp_path / "p"))
    df = rows(spark, 5)
    first, second = store.write(df), store.write(df)
    assert store.commit([first], df.schema, None) == 0 and [f"data/{f}" for f in store.unused()] == [second["folder"]]
    with pytest.raises(OtherWriter):
        store.commit([second], df.schema, None)
    assert store.load().count() == 5 and store.commit([first, second], df.schema, 0) == 1
    assert store.load().count() == 10 and store.unused() == []


def test_what_is_observed_while_writing(spark, tmp_path):
    df = rows(spark, 9).withColumn("special_tokens_mask", F.when(F.col("id") == 4, F.array(F.lit(0))).otherwise(F.col("special_tokens_mask")))
    noted = PreparedStore(spark, str(tmp_path / "p")).write(df.repartition(3))["observed"]
    assert noted == {"blocks": 9, "tokens": 18, "shortest": 1, "longest": 3, "uneven": 1}


def test_an_empty_dataset(spark, tmp_path):
    path = str(tmp_path / "p")
    S.save_prepared(rows(spark, 0), path)
    assert S.load_prepared(spark, path).collect() == [] and S.load_prepared(spark, path).columns == rows(spark, 0).columns


def test_rebuild_beside_the_version_in_force(spark, tmp_path, vocab):
    (tmp_path / "train.txt").write_text("a b c\nd e\n" * 20)
    args = (spark, {"train": str(tmp_path / "train.txt")}, str(tmp_path / "out"), vocab, "words", 8)
    before = prepare(*args, n_shards=2, batch_rows=10)
    want = sorted(map(str, before.collect()))
    after = prepare(*args, n_shards=2, batch_rows=10, force_rebuild=True)
    assert sorted(map(str, after.collect())) == sorted(map(str, before.collect())) == want
    (group,) = os.listdir(tmp_path / "out")
    (one,) = os.listdir(tmp_path / "out" / group)
    assert PreparedStore(spark, str(tmp_path / "out" / group / one)).versions() == [0, 1]


def test_only_new_and_changed_entries_are_packed(spark, tmp_path, vocab):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(name, text):
        (source / name).write_text(text)

    def call(**how):
        found = prepare_incremental(spark, {"train": str(source)}, root, vocab, "words", 4, batch_rows=3, fmt="text", **how)
        (group,) = os.listdir(root)
        (one,) = os.listdir(f"{root}/{group}")
        return found, PreparedStore(spark, f"{root}/{group}/{one}")

    def blocks(df):
        return sorted((r["shard"], r["batch"], r["blk"], tuple(r["input_ids"])) for r in df.collect())

    put("a.txt", "a b c\nd e\n" * 5)
    put("b.txt", "f g\n")
    put("c.txt", "")
    assert call(prepare_only=True)[0] is None
    first, store = call()
    assert store.versions() == [0], "nothing changed, so nothing is committed"
    held = {e["entry"].rsplit("/", 1)[1]: e for e in store.manifest()["entries"]}
    assert [held[n]["blocks"] > 0 for n in ("a.txt", "b.txt", "c.txt")] == [True, True, False]
    alone = [b[1:] for b in blocks(first) if b[0] == held["a.txt"]["shard"]]

    put("b.txt", "h h h h h h\n" * 3)
    put("d.txt", "a b c\nd e\n" * 5)
    os.remove(source / "c.txt")
    second, _ = call()
    now = {e["entry"].rsplit("/", 1)[1]: e for e in store.manifest()["entries"]}
    assert set(now) == {"a.txt", "b.txt", "d.txt"} and now["a.txt"] == held["a.txt"]
    assert now["b.txt"]["shard"] == held["b.txt"]["shard"] and now["b.txt"]["folder"] != held["b.txt"]["folder"]
    # Equal entries have equal blocks, and the old version is still there.
    got = blocks(second)
    assert [b[1:] for b in got if b[0] == now["d.txt"]["shard"]] == alone == [b[1:] for b in got if b[0] == now["a.txt"]["shard"]]
    assert blocks(store.load(0)) == blocks(first) != got
    assert sum(e["blocks"] for e in now.values()) == len(got) and sum(e["tokens"] for e in now.values()) == sum(len(b[3]) for b in got)

    # Putting everything together at once gives the same blocks, up to the numbers of the entries.
    third, _ = call(force_rebuild=True)
    assert blocks(third) == got and store.versions() == [0, 1, 2]

import os
import warnings

import pytest
from pyspark.sql import functions as F

from blockloom.operators import tokens as T
from blockloom.plans import catalog
from blockloom.plans.prepare import prepare
from blockloom.session import scratch_dir, stored
from blockloom.sources import prepared as S
from blockloom.sources import readers as R


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_lines_of_a_file(spark, tmp_path):
    path = write(tmp_path / "a.txt", "a\nb\r\n\nc\rd\n\n")
    rows = R.read_lines(spark, path).orderBy("row_idx").collect()
    assert [r["text"] for r in rows] == ["a", "b", "", "c", "d", ""]
    assert [r["row_idx"] for r in rows] == list(range(6))


def test_lines_over_many_blocks_and_files(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    write(tmp_path / "b.txt", "\n".join(lines[1000:]) + "\n")
    write(tmp_path / "a.txt", "\n".join(lines[:1000]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = R.read_lines(spark, str(tmp_path / "*.txt")).orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["row_idx"] for r in rows] == list(range(3000))
    assert [r["text"] for r in rows] == lines


def test_lines_of_a_column(spark):
    df = spark.createDataFrame([(1, "a\nb\r\n\nc\rd"), (2, "")], "id long, text string")
    got = sorted((r["id"], r["line_no"], r["line"]) for r in R.explode_lines(df, "id").collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, ""), (1, 3, "c"), (1, 4, "d"), (2, 0, "")]


def test_formats_agree(spark, tmp_path):
    texts = ["one", 'two "quoted", more', "", "é – ü"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string").coalesce(1)
    want = list(enumerate(texts))
    paths = {
        "csv": lambda p: df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(p),
        "json": lambda p: df.write.json(p),
        "parquet": lambda p: df.write.parquet(p),
        "orc": lambda p: df.write.orc(p),
        "txt": lambda p: df.select("text").write.text(p),
    }
    for ext, save in paths.items():
        path = str(tmp_path / f"corpus.{ext}")
        save(path)
        rows = R.read_corpus(spark, path).orderBy("row_idx").collect()
        assert [(r["row_idx"], r["text"] or "") for r in rows] == want, ext


def test_unknown_format():
    with pytest.raises(ValueError):
        R.corpus_format("corpus.xyz")
    assert R.corpus_format("/data/train.raw") == "text"


def test_first_extension_counts_for_all_splits(spark, tmp_path):
    paths = {"train": write(tmp_path / "train.txt", "a\nb\n"), "val": write(tmp_path / "dev.csv", "text\nc\n")}
    rows = R.named_splits(spark, paths).collect()
    assert sorted((r["split"], r["row_idx"], r["text"]) for r in rows) == [
        ("train", 0, "a"),
        ("train", 1, "b"),
        ("val", 0, "text"),
        ("val", 1, "c"),
    ]
    with pytest.raises(ValueError):
        R.named_splits(spark, {})


def test_prepared_must_be_complete(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(4).withColumn("split", F.lit("train"))
    S.save_prepared(df, path)
    assert S.load_prepared(spark, path).count() == 4
    (part,) = os.listdir(os.path.join(path, "data"))
    assert os.path.isdir(os.path.join(path, "data", part, "split=train"))
    with pytest.raises(Exception):
        S.save_prepared(df, path)
    S.save_prepared(df.limit(1), path, overwrite=True)
    assert S.load_prepared(spark, path).count() == 1
    for name in os.listdir(os.path.join(path, "commits")):
        os.remove(os.path.join(path, "commits", name))
    with pytest.raises(FileNotFoundError):
        S.load_prepared(spark, path)
    with pytest.raises(FileNotFoundError):
        S.load_prepared(spark, str(tmp_path / "none"))


def test_cache_key_names_everything_applied():
    base = dict(
        inputs={"train": "/d/train.txt", "val": "/d/val.txt"},
        block_size=512,
        tokenizer_name="org/name",
        tokenizer_fingerprint="x",
        n_shards=4,
        batch_rows=100,
    )
    key = S.cache_key(**base)
    assert key.startswith("blocks512-") and key.count("/") == 1
    assert S.cache_key(**base) == key
    for change in (
        {"block_size": 256},
        {"tokenizer_fingerprint": "y"},
        {"n_shards": 5},
        {"batch_rows": 99},
        {"tokenizer_name": "org/other"},
        {"inputs": {"train": "/e/train.txt", "val": "/d/val.txt"}},
        {"identity": [("train", "/d/train.txt", 1, 2)]},
    ):
        other = S.cache_key(**{**base, **change})
        assert other != key
        # Only another content of the same tokenizer shares the folder that fallbacks look in.
        assert (other.split("/")[0] == key.split("/")[0]) == ("tokenizer_fingerprint" in change)


@pytest.fixture(scope="module")
def vocab(spark):
    df = spark.createDataFrame([("a b c d e f g h . ,",)], "text string")
    return T.load_vocab(T.build_vocab(df, 50))


def test_prepare_reuses_falls_back_and_rebuilds(spark, tmp_path, vocab):
    inputs = {
        "train": write(tmp_path / "train.txt", "a b c\nd e\n\nf g h .\n" * 20),
        "val": write(tmp_path / "val.txt", "a , b\n"),
    }
    root = str(tmp_path / "tokenized")
    args = (spark, inputs, root, vocab, "words", 8)

    def made():
        return sorted(f"{group}/{one}" for group in os.listdir(root) for one in os.listdir(f"{root}/{group}"))

    assert prepare(*args, n_shards=2, batch_rows=10, prepare_only=True) is None
    first = made()
    assert len(first) == 1
    blocks = prepare(*args, n_shards=2, batch_rows=10)
    assert made() == first
    sizes = {(r["split"], len(r["input_ids"])) for r in blocks.collect()}
    # The validation batch is shorter than one block and is kept as it is.
    assert sizes == {("train", 8), ("val", 5)}

    # Another content of the same tokenizer falls back, with a warning, unless told to rebuild.
    longer = T.load_vocab(T.build_vocab(spark.createDataFrame([("a b z",)], "text string"), 50))
    with pytest.warns(UserWarning, match="another tokenizer version"):
        prepare(spark, inputs, root, longer, "words", 8, n_shards=2, batch_rows=10, prepare_only=True)
    assert made() == first
    prepare(spark, inputs, root, longer, "words", 8, n_shards=2, batch_rows=10, force_rebuild=True, prepare_only=True)
    assert len(made()) == 2
    exact, same = S.find_prepared(spark, root, first[0])
    assert same and exact.endswith(first[0])
    assert S.find_prepared(spark, root, "other/1") == (None, False)


def test_other_inputs_are_never_taken(spark, tmp_path, vocab):
    """Equal file names elsewhere, other shards and a rewritten file all make their own datasets."""
    root = str(tmp_path / "tokenized")
    for name in "ab":
        os.makedirs(tmp_path / name)
        write(tmp_path / name / "train.txt", f"{name} {name}\n" * 30)

    def ids(folder, shards=2):
        inputs = {"train": str(tmp_path / folder / "train.txt")}
        with warnings.catch_warnings():
            warnings.simplefilter("error", UserWarning)
            return {i for r in prepare(spark, inputs, root, vocab, "words", 8, n_shards=shards).collect() for i in r["input_ids"]}

    assert ids("a") != ids("b")
    ids("a", 3)
    assert sum(len(os.listdir(f"{root}/{g}")) for g in os.listdir(root)) == 3
    before = ids("a")
    write(tmp_path / "a" / "train.txt", "c d\n" * 31)
    assert ids("a") != before


def test_unfinished_dataset_is_not_used(spark, tmp_path):
    os.makedirs(tmp_path / "base" / "1")
    assert S.find_prepared(spark, str(tmp_path), "base/1") == (None, False)
    assert S.find_prepared(spark, str(tmp_path), "base/2") == (None, False)


def test_positions_survive_another_split_of_the_scan(spark, tmp_path):
    """A scan that is cut otherwise when the rows are read than when the plan was made loses nothing."""
    path = write(tmp_path / "many.txt", "".join(f"line {i} of a file that is cut\n" for i in range(20_000)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for built, read in (("1m", "50k"), ("50k", "1m")):
            spark.conf.set(name, built)
            df = R.read_lines(spark, path)
            spark.conf.set(name, read)
            rows = sorted((r["row_idx"], r["text"]) for r in df.collect())
            assert rows == [(i, f"line {i} of a file that is cut") for i in range(20_000)]
    finally:
        spark.conf.set(name, before)


def test_parquet_positions_survive_it_too(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    ids = spark.range(3000).select(F.format_string("t%d", "id").alias("text")).repartitionByRange(3, "text")
    ids.write.option("parquet.block.size", 2000).parquet(path)
    df = R.read_corpus(spark, path)
    assert sorted(r["row_idx"] for r in df.collect()) == list(range(3000))
    assert df.filter("row_idx < 2").count() == 2


def test_spread_leaves_large_inputs_alone(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(100).repartition(40).write.parquet(path)
    df = spark.read.parquet(path)
    assert R.spread(df, "id") is df
    one = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(one)
    spread = R.spread(spark.read.parquet(one), "id")
    assert spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


class FakeSession:
    """A session with or without the cluster's setting."""

    def __init__(self, setting, master="local[2]"):
        self.setting, self.made, self.master = setting, None, master
        self.conf = self.sparkContext = self

    def get(self, name, default):
        assert name == "spark.checkpoint.dir"
        return self.setting or default

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, path):
        self.made = path


def test_scratch_folder_is_the_cluster_setting(tmp_path):
    shared = FakeSession(str(tmp_path))
    assert scratch_dir(shared, "x").startswith(f"{tmp_path}/x-")
    assert shared.made is None
    local = FakeSession(None)
    first, second = scratch_dir(local, "x"), scratch_dir(local, "x")
    assert first != second and os.path.dirname(first) == os.path.dirname(second) == local.made


def test_cluster_without_the_setting_is_an_error(tmp_path):
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(FakeSession(None, master), "x")
        assert scratch_dir(FakeSession(str(tmp_path), master), "x").startswith(str(tmp_path))


def test_stored_table_reads_back(spark):
    assert sorted(r["id"] for r in stored(spark.range(5), "x").collect()) == list(range(5))


def test_catalog_names_are_plain():
    assert all(name.replace("_", "").isalpha() for name in catalog.queries())

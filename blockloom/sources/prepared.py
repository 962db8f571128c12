"""The store of prepared datasets: keys, lookup, save and load."""

from __future__ import annotations

import hashlib
import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import PreparedStore


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished table of Spark's writers is at ``path``."""
    fs, hpath = _fs(spark, path.rstrip("/") + "/_SUCCESS")
    return bool(fs.exists(hpath))


def newest_first(spark: SparkSession, root: str, prefix: str = "stream_batch=") -> list[str]:
    """Folders of micro-batches under ``root``, the latest batch first."""
    fs, hpath = _fs(spark, root)
    names = [s.getPath().toString() for s in (fs.listStatus(hpath) if fs.exists(hpath) else [])]
    found = [p for p in names if p.rsplit("/", 1)[-1].startswith(prefix)]
    return sorted(found, key=lambda p: -int(p.rsplit("=", 1)[-1]))


def save_prepared(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write all splits, one folder per split, as a new version; an older one stays readable until then and after.

    Without ``overwrite`` a dataset that is there already is an error.
    """
    store = PreparedStore(df.sparkSession, path)
    held = store.versions()
    if held and not overwrite:
        raise FileExistsError(f"a prepared dataset is at {path}")
    store.commit([store.write(df)], df.schema, held[-1] if held else None)


def load_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Read a prepared dataset; a missing or unfinished one is an error."""
    return PreparedStore(spark, path).load()


def fingerprint(**applied) -> str:
    """Digest of everything that decides the content of a prepared dataset."""
    return hashlib.sha256(json.dumps(applied, sort_keys=True, default=str).encode()).hexdigest()[:32]


def input_identity(spark: SparkSession, inputs: dict[str, str]) -> list[tuple[str, str, int, int]]:
    """Split, path, length and modification time of every file of the inputs, in order."""
    found = []
    for split, path in inputs.items():
        fs, hpath = _fs(spark, path)
        files = fs.listFiles(hpath, True)
        while files.hasNext():
            status = files.next()
            found.append((split, status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def dataset_group(
    inputs: dict[str, str],
    block_size: int,
    tokenizer_name: str,
    n_shards: int,
    batch_rows: int,
    identity: list | None = None,
    **more,
) -> str:
    """Folder of the datasets that differ in the tokenizer's content only.

    Input paths, what the files are (``input_identity``) and every parameter of packing decide it, so
    a dataset of another corpus, or of the same file before it was rewritten, is never in it.
    """
    digest = fingerprint(
        inputs=inputs,
        identity=identity,
        block_size=block_size,
        tokenizer=tokenizer_name,
        n_shards=n_shards,
        batch_rows=batch_rows,
        **more,
    )
    return f"blocks{block_size}-{digest}"


def cache_key(tokenizer_fingerprint: str, **applied) -> str:
    """Folder of a dataset: its group and, below it, the digest of the tokenizer."""
    return f"{dataset_group(**applied)}/{fingerprint(tokenizer=tokenizer_fingerprint)}"


def input_entries(spark: SparkSession, inputs: dict[str, str]) -> dict[tuple[str, str], str]:
    """``(split, path) → digest`` of every file or folder right below each input, or of the input if it is a file.

    The digest covers path, length and modification time of all files below an entry.
    """
    found = {}
    for split, path in inputs.items():
        fs, hpath = _fs(spark, path)
        listed = [s.getPath() for s in fs.listStatus(hpath)]
        for entry in listed:
            if not entry.getName().startswith(("_", ".")):
                found[split, entry.toString()] = fingerprint(files=input_identity(spark, {split: entry.toString()}))
    return found


def find_prepared(spark: SparkSession, root: str, key: str) -> tuple[str | None, bool]:
    """Path of a finished dataset and whether its key matches exactly.

    Without an exact match the newest finished dataset of the same group is used, with a warning:
    it was made by another version of the tokenizer. Without either the path is ``None``.
    """
    exact = f"{root.rstrip('/')}/{key}"
    if PreparedStore(spark, exact).manifest() is not None:
        return exact, True
    fs, group = _fs(spark, exact.rsplit("/", 1)[0])
    found = fs.listStatus(group) if fs.exists(group) else []
    for status in sorted(found, key=lambda s: (-s.getModificationTime(), s.getPath().getName())):
        path = status.getPath().toString()
        if PreparedStore(spark, path).manifest() is not None:
            warnings.warn(f"no prepared dataset {key}; using {path}, made by another tokenizer version", stacklevel=2)
            return path, False
    return None, False


def lookup_prepared(requests: DataFrame, prepared: DataFrame) -> DataFrame:
    """Answer many lookups at once: ``requests(base, fingerprint)`` against a table of datasets.

    Datasets are reduced to the newest per key before the joins, so a base that was prepared
    very often still adds one row per request.
    """
    newest = F.struct("created", "path")
    exact = prepared.groupBy("base", "fingerprint").agg(F.max(newest).alias("__exact"))
    any_version = prepared.groupBy("base").agg(F.max(newest).alias("__any"))
    joined = requests.join(exact, ["base", "fingerprint"], "left").join(any_version, "base", "left")
    match = (
        F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__any").isNotNull(), "fallback").otherwise("build")
    )
    return (
        joined.withColumn("match", match)
        .withColumn("path", F.coalesce("__exact.path", "__any.path"))
        .drop("__exact", "__any")
    )

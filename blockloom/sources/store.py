"""Prepared datasets with versions: data is added beside the old, and one small file makes it count.

``data/part=…`` holds what a writer wrote, ``commits/`` one manifest per version that lists the folders in
force. A manifest is created exclusively and ends with a mark: a writer that breaks off leaves folders that no
manifest names, or a manifest without its mark, and readers go on with the version before. Nothing is
overwritten, so a version that is being read stays whole while the next one is made.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

END = "\n-- end of manifest --\n"


class OtherWriter(RuntimeError):
    """Another writer committed the version that this one was to become."""


def observed(columns: list[str]) -> dict[str, Column]:
    """What is noted of blocks on their way to storage: rows, tokens, lengths, and rows of uneven columns."""
    notes = {"blocks": F.count(F.lit(1))}
    arrays = [c for c in ("input_ids", "special_tokens_mask", "attention_mask") if c in columns]
    if arrays:
        size = F.size(arrays[0]).cast("long")
        uneven = F.lit(False)
        for c in arrays[1:]:
            uneven = uneven | (F.size(c) != size)
        notes |= {"tokens": F.sum(size), "shortest": F.min(size), "longest": F.max(size), "uneven": F.count_if(uneven)}
    return notes


class PreparedStore:
    """The dataset under ``path``, a folder of a store that Spark and its driver reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._at = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[int]:
        folder = self._at(f"{self.path}/commits")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        names = [s.getPath().getName() for s in found]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def _read(self, version: int) -> dict | None:
        stream = self._fs.open(self._at(f"{self.path}/commits/{version:08d}.json"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text[: -len(END)]) if text.endswith(END) else None

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return [v for v in self._names() if self._read(v) is not None]

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, the newest committed one by default; without any ``None``."""
        if version is not None:
            return self._read(version) if version in self._names() else None
        for v in reversed(self._names()):
            found = self._read(v)
            if found is not None:
                return found
        return None

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ("split",)) -> dict:
        """Write rows that no version names yet; the entry has their folder and what was observed of them."""
        name = f"data/part={uuid.uuid4().hex}"
        noted = Observation()
        # Right above the writer, where a task that is repeated is counted once.
        watched = df.observe(noted, *[c.alias(k) for k, c in observed(df.columns).items()])
        watched.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        return {"folder": name, "observed": dict(noted.get)}

    def write_clustered(self, df: DataFrame, keys: tuple[str, ...], buckets: int) -> dict:
        """The same in buckets by ``keys``: rows that are partitioned by them already are not moved, and joins on
        them will not move the stored rows either."""
        name = f"data/part={uuid.uuid4().hex}"
        noted = Observation()
        watched = df.observe(noted, *[c.alias(k) for k, c in observed(df.columns).items()])
        table = f"blockloom_{uuid.uuid4().hex}"
        watched.write.bucketBy(buckets, *keys).option("path", f"{self.path}/{name}").saveAsTable(table)
        # The catalog only knew where to write; rows are opened by their manifest.
        self.spark.sql(f"DROP TABLE {table}")
        return {"folder": name, "observed": dict(noted.get), "keys": list(keys), "buckets": buckets}

    def _clustered(self, entry: dict, schema: StructType) -> DataFrame:
        """An entry in buckets as a table of this session; only such a table tells Spark about buckets."""
        table = f"blockloom_{entry['folder'].split('=')[1]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({', '.join(entry['keys'])}) "
            f"INTO {entry['buckets']} BUCKETS LOCATION '{self.path}/{entry['folder']}'"
        )
        return self.spark.table(table)

    def commit(self, entries: list[dict], schema: StructType, after: int | None) -> int:
        """Make ``entries`` the dataset; ``after`` is the version they replace, ``None`` for the first one.

        A version made by another writer since then is an error and leaves everything as it is.
        """
        newest = self.versions()[-1:]
        if newest != ([] if after is None else [after]):
            raise OtherWriter(f"version {newest} is in force, not {after}")
        version = max(self._names(), default=-1) + 1
        text = json.dumps({"version": version, "schema": json.loads(schema.json()), "entries": entries}, sort_keys=True)
        self._fs.mkdirs(self._at(f"{self.path}/commits"))
        try:
            out = self._fs.create(self._at(f"{self.path}/commits/{version:08d}.json"), False)
        except Exception as e:
            raise OtherWriter(f"version {version} was committed meanwhile") from e
        out.write(bytearray((text + END).encode()))
        out.close()
        return version

    def load(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; a missing one is an error."""
        found = self.manifest(version)
        if found is None:
            raise FileNotFoundError(f"no prepared dataset at {self.path}; it should have been made before")
        schema = StructType.fromJson(found["schema"])
        if len(found["entries"]) == 1 and "buckets" in found["entries"][0]:
            return self._clustered(found["entries"][0], schema)
        folders = [f"{self.path}/{e['folder']}" for e in found["entries"] if e["folder"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.select(*schema.fieldNames())

    def unused(self) -> list[str]:
        """Folders of data that no committed version names: left by writers that broke off."""
        named = {e["folder"].split("/")[1] for v in self.versions() for e in self._read(v)["entries"] if e["folder"]}
        folder = self._at(f"{self.path}/data")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted(s.getPath().getName() for s in found if s.getPath().getName() not in named)

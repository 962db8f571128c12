"""Token counts as rollups that signed deltas keep up to date.

A store holds, per committed batch, the signed totals by source, language and tokenizer version,
and per document the counts that are in force. A batch of changes (insert, delete, revise) is
turned into signed rows by looking up the counts in force; totals are additive, so a reader sums
what all commits say. A batch writes under a new name and its commit is one file, named by its
number: applying a batch that is committed changes nothing, and a batch that broke off is not seen.

Every so many commits the ledger and the totals are merged into a snapshot, the ledger in buckets by
document. A batch reads the buckets of its own documents and the commits since the snapshot, never the
whole history.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer_version")
LEDGER = "doc_id long, tokenizer_version string, source string, lang string, n_tokens long, deleted boolean, seq long"
SNAPSHOT = f"{LEDGER}, bucket int"
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
# Ledgers and deltas of totals are merged into one snapshot every so many commits.
COMPACT_EVERY = 16
# Folders of a snapshot of the ledger: a batch reads only those its documents fall into.
BUCKETS = 256


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


class TokenRollup:
    """A rollup store under ``path``, a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _commits(self) -> list[dict]:
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        found = []
        for status in self._fs.listStatus(folder):
            if status.getPath().getName().endswith(".json"):
                stream = self._fs.open(status.getPath())
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                found.append(json.loads(text))
        return sorted(found, key=lambda c: c["seq"])

    def _commit(self, entry: dict) -> None:
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        name = self._path(f"{self.path}/commits/{entry['seq']:09d}.json")
        draft = self._path(f"{self.path}/commits/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        # Renaming does not replace: of two writers with the same number one fails.
        if not self._fs.rename(draft, name):
            raise RuntimeError(f"commit {entry['seq']} exists; another writer was faster")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _ledger(self, commits: list[dict], touched: list[int] | None = None) -> DataFrame:
        """Newest entry per document and tokenizer version, deletions too; ``touched`` names buckets to read."""
        start = max((c["seq"] for c in commits if c.get("snapshot")), default=-1)
        rows = self._read([c["ledger"] for c in commits if c["seq"] > start], LEDGER).withColumn("bucket", _bucket())
        for c in commits:
            if c["seq"] == start:
                rows = rows.unionByName(self.spark.read.schema(SNAPSHOT).parquet(c["snapshot"]))
        if touched is not None and len(touched) < BUCKETS:
            rows = rows.filter(F.col("bucket").isin(touched))
        newest = rows.groupBy("doc_id", "tokenizer_version").agg(
            F.max(F.struct("seq", "source", "lang", "n_tokens", "deleted")).alias("x")
        )
        return newest.select("doc_id", "tokenizer_version", "x.source", "x.lang", "x.n_tokens", "x.deleted", "x.seq")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``(action, doc_id, source, lang, tokenizer_version, n_tokens)`` once; False if it was before.

        ``insert`` of a document that is there and ``revise`` both put the new counts in force,
        ``delete`` takes them out; deleting what is not there, and an unknown or null action, does
        nothing. Sources and languages may be null and are totals of their own; so may versions.
        A null count is 0. Rows without a document id are ignored. Of several changes to one
        document and version in a batch a deletion counts if there is one, else the largest count
        (ties: the largest source, then language); repeated rows count once.
        """
        commits = self._commits()
        if any(c["batch"] == batch_id for c in commits):
            return False
        seq = len(commits)
        work = f"{self.path}/work/{uuid.uuid4().hex}"
        key = ("doc_id", "tokenizer_version")
        new = changes.filter(F.col("action").isin("insert", "revise", "delete") & F.col("doc_id").isNotNull()).select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("tokenizer_version").cast("string").alias("tokenizer_version"),
            F.struct(
                (F.col("action") == "delete").alias("deleted"),
                F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"),
                F.col("source").cast("string").alias("source"),
                F.col("lang").cast("string").alias("lang"),
            ).alias("x"),
        )
        new = new.groupBy(*key).agg(F.max("x").alias("new"))
        new.write.parquet(f"{work}/new")
        new = self.spark.read.parquet(f"{work}/new")
        touched = [r[0] for r in new.select(_bucket().alias("bucket")).distinct().collect()]
        old = self._ledger(commits, touched).filter("not deleted").select(
            F.col("doc_id").alias("d"),
            F.col("tokenizer_version").alias("v"),
            F.struct("source", "lang", "n_tokens").alias("old"),
        )
        here = (F.col("doc_id") == F.col("d")) & F.col("tokenizer_version").eqNullSafe(F.col("v"))
        joined = new.join(old, here, "left").filter(F.col("old").isNotNull() | ~F.col("new.deleted"))
        joined.select(*key, "new", "old").write.parquet(f"{work}/changes")
        joined = self.spark.read.parquet(f"{work}/changes")
        ledger = joined.select(
            *key, "new.source", "new.lang", "new.n_tokens", "new.deleted", F.lit(seq).cast("long").alias("seq"),
        )
        ledger.write.parquet(f"{work}/ledger")

        def signed(side: str, sign: int, keep) -> DataFrame:
            return joined.filter(keep).select(
                f"{side}.source", f"{side}.lang", "tokenizer_version",
                F.lit(sign).cast("long").alias("n_docs"), (F.col(f"{side}.n_tokens") * sign).alias("n_tokens"),
            )

        deltas = signed("new", 1, ~F.col("new.deleted")).unionByName(signed("old", -1, F.col("old").isNotNull()))
        totals = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        base, snapshot = None, None
        if (seq + 1) % COMPACT_EVERY == 0:
            totals, base, snapshot = self._sum(self.totals().unionByName(totals)), seq, f"{work}/snapshot"
            upto = [*commits, {"seq": seq, "ledger": f"{work}/ledger"}]
            whole = self._ledger(upto).filter("not deleted").withColumn("bucket", _bucket())
            whole.repartition("bucket").write.partitionBy("bucket").parquet(snapshot)
        totals.write.parquet(f"{work}/totals")
        entry = {"seq": seq, "batch": batch_id, "ledger": f"{work}/ledger", "totals": f"{work}/totals"}
        self._commit(entry | {"base": base, "snapshot": snapshot})
        return True

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer_version, n_docs, n_tokens)``; groups without documents are left out."""
        commits = self._commits()
        # The newest snapshot holds all before it.
        start = max((c["seq"] for c in commits if c["base"] is not None), default=0)
        rows = self._read([c["totals"] for c in commits if c["seq"] >= start], TOTALS)
        return self._sum(rows).filter("n_docs != 0 or n_tokens != 0")

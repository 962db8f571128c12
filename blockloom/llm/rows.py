"""Small helpers shared by the operators: Arrow kernels over a text column and row identity."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

# Kernels travel by value, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW = "__bl_row"

# Text that a kernel turns into Python objects at a time; those that add columns hold their results as well.
PART_BYTES, COLUMN_BYTES = 8 << 20, 2 << 20


def parts(batch: pa.RecordBatch, column: int, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of one string column, one row at least."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for at, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def add_columns(
    df: DataFrame,
    column: str,
    fields: str,
    kernel: Callable[[], Callable[[list[str]], list[list]]],
    limit: int = COLUMN_BYTES,
) -> DataFrame:
    """Add columns worked out from one text column; other columns pass through untouched.

    ``kernel()`` runs once per task and gives a function from a list of texts (nulls as ``""``) to
    one list or Arrow array per new field; it gets about ``limit`` bytes of text at a time. Columns of
    ``df`` with the name of a new field are replaced.
    """
    new = T._parse_datatype_string(fields)
    kept = [c for c in df.columns if c not in new.fieldNames()]
    source = kept.index(column)
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*df.schema.fields, *new.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = [to_arrow_schema(new).field(i).type for i in range(len(new))]
    names = [*kept, *new.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for part in parts(batch, source, limit):
                made = work([t or "" for t in part.column(source).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[v.cast(t) if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, arrow, strict=True)]],
                    names,
                )

    return df.mapInArrow(run, schema)


def snapshot(df: DataFrame, purpose: str) -> DataFrame:
    """A stored copy of ``df`` whose rows carry an id.

    Ids of rows are only the same in every later read, and after a lost executor, once they are
    written down; values of the data cannot serve, as rows may repeat.
    """
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), purpose)


# Rows of a narrow table up to which it is broadcast, at less than a hundred bytes each.
FEW_ROWS = 1_000_000


def small_side(rows: DataFrame) -> DataFrame:
    """A stored narrow table for the right side of a join: broadcast if its rows are few, else left to Spark."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def keep_decided(docs: DataFrame, decided: DataFrame, digest: Column, key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for every ``(key, text_digest, copies, keep)`` that is kept, columns unchanged.

    Rows are told apart by key and text (``digest`` works its digest out), so no copy of the texts is
    written. Only names that are dropped, or that have several rows, are looked up; where these are few,
    documents stay where they are.
    """
    marked = docs.withColumn(ROW, digest)
    touched = decided.filter(~F.col("keep") | (F.col("copies") > 1))
    touched = stored(touched.select(F.col(key).alias("__bl_key"), F.col("text_digest").alias("__bl_digest"), "keep"), "touched-names")
    here = F.col(key).eqNullSafe(F.col("__bl_key")) & (F.col(ROW) == F.col("__bl_digest"))
    others = marked.join(small_side(touched.drop("keep")), here, "left_anti")
    several = stored(touched.filter("keep").drop("keep"), "repeated-names")
    one_each = marked.join(small_side(several), here, "left_semi").dropDuplicates([key, ROW])
    return others.unionByName(one_each).drop(ROW)

"""Reading raw corpora: one document per line, or any table format with a ``text`` column.

Files have an order, Spark rows have none. Every reader here numbers its rows by place: file
name, then block of the file, then line in the block. Within one block a scan emits rows in file
order, so only the row counts per block have to be carried, never the rows.
"""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TEXT
from ..session import stored
from .line_source import RANGE_BYTES, can_open, is_compressed, list_files, read_ranges

# File extensions that mean "one document per line".
LINE_EXTENSIONS = ("txt", "raw")

TABLE_FORMATS = ("csv", "json", "orc", "parquet")


def corpus_format(path: str) -> str:
    """Format of a corpus file from its extension; unknown ones are an error."""
    ext = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if ext in LINE_EXTENSIONS or ext == "text":
        return "text"
    if ext in TABLE_FORMATS:
        return ext
    raise ValueError(f"no corpus format for extension {ext!r} of {path}")


def _scan(spark: SparkSession, path: str, fmt: str, multi_line: bool) -> DataFrame:
    if fmt == "text":
        return spark.read.text(path).withColumnRenamed("value", "text")
    if fmt == "csv":
        # Quoted text may hold line breaks; such files cannot be split over tasks.
        rows = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
        return rows.csv(path)
    return spark.read.schema(TEXT).format(fmt).load(path)


def file_place() -> list[Column]:
    """File and block of each scanned row."""
    return [
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
    ]


def with_file_position(df: DataFrame, out: str = "row_idx") -> DataFrame:
    """Add the dense position of every row of a file scan; must come right after the scan.

    How a file is cut into blocks depends on the cores at the time of planning, so two scans may
    differ. The scanned rows are therefore written to the shared scratch folder with their block
    and place, and both the counts per block and the rows come from that one copy.
    """
    known = df if "__file" in df.columns else df.select("*", *file_place())
    placed = stored(known.withColumn("__id", F.monotonically_increasing_id()), "placed-rows")
    per_block = placed.groupBy("__file", "__block").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    earlier_blocks = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    per_file = per_block.groupBy("__file").agg(F.sum("__n").alias("__file_n"))
    block_base = per_block.select(
        "__file", "__block", "__first", F.coalesce(F.sum("__n").over(earlier_blocks), F.lit(0)).alias("__bb")
    )
    base = stored(block_base.join(_file_bases(per_file), "__file"), "blocks")
    return (
        placed.join(base, ["__file", "__block"])
        .withColumn(out, F.col("__fb") + F.col("__bb") + F.col("__id") - F.col("__first"))
        .drop("__file", "__block", "__id", "__first", "__fb", "__bb")
    )


def _file_bases(per_file: DataFrame) -> DataFrame:
    """Rows in the files before each file; one row per file goes to one task."""
    earlier = Window.partitionBy(F.lit(0)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    return per_file.select("__file", F.coalesce(F.sum("__file_n").over(earlier), F.lit(0)).alias("__fb"))


def with_parquet_position(df: DataFrame, out: str = "row_idx") -> DataFrame:
    """The same for Parquet, whose scans know each row's place in its file: nothing is copied."""
    placed = df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")
    )
    per_file = df.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file")
    base = stored(_file_bases(per_file.agg(F.count(F.lit(1)).alias("__file_n"))), "files")
    return placed.join(base, "__file").withColumn(out, F.col("__fb") + F.col("__at")).drop("__file", "__at", "__fb")


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(row_idx, text)``: one row per line, blank lines kept.

    Files that the line source can open are read by it, in place. Compressed files, and stores that only the
    JVM reaches, go through Spark's own scan and one copy that fixes the place of each row.
    """
    files = list_files(spark, path)
    if files and all(map(can_open, {_store(p): p for p, _ in files}.values())) and not any(is_compressed(p) for p, _ in files):
        return read_ranges(spark, files, range_bytes)
    return with_file_position(_scan(spark, path, "text", False)).select("row_idx", "text")


def _store(path: str) -> str:
    parts = urlsplit(path)
    return f"{parts.scheme}://{parts.netloc}"


def read_corpus(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = True) -> DataFrame:
    """``(row_idx, text)`` from a file or folder; only the text column is read."""
    fmt = fmt or corpus_format(path)
    if fmt == "text":
        return read_lines(spark, path)
    rows = _scan(spark, path, fmt, multi_line)
    return (with_parquet_position(rows) if fmt == "parquet" else with_file_position(rows)).select("row_idx", "text")


def named_splits(
    spark: SparkSession, paths: dict[str, str], fmt: str | None = None, multi_line: bool = True
) -> DataFrame:
    """``(split, row_idx, text)`` over named inputs; the first input's extension counts for all."""
    if not paths:
        raise ValueError("no splits given")
    fmt = fmt or corpus_format(next(iter(paths.values())))
    parts = [
        read_corpus(spark, path, fmt, multi_line).select(F.lit(name).alias("split"), "row_idx", "text")
        for name, path in paths.items()
    ]
    res = parts[0]
    for part in parts[1:]:
        res = res.unionByName(part)
    return res


def split_lines(text: Column) -> Column:
    """Lines of a text held in a table; ``\\n``, ``\\r\\n`` and ``\\r`` end a line."""
    return F.split(text, "\r\n|\n|\r", -1)


def explode_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per line of a text column, with its line number."""
    return df.select(key, F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


def scan_tasks(df: DataFrame) -> int:
    """Into how many tasks the widest scan below ``df`` is cut. Nothing runs for it, also under adaptive execution."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    return max((leaves.apply(i).execute().getNumPartitions() for i in range(leaves.size())), default=0)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows over all cores when the scan has fewer splits than there are cores.

    A file with a single row group is read by one task, however many cores wait. Large inputs have
    many splits and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if scan_tasks(df) >= cores:
        return df
    return df.repartition(cores, key)


def corpus_preview(df: DataFrame, key: str, n: int = 2) -> DataFrame:
    """The first ``n`` rows of every split by ``key``, with their position as ``row_idx``.

    Splits are a handful of names. Each task keeps ``n`` rows of a split, and so does the last one;
    nothing is numbered but these.
    """
    names = [r[0] for r in df.select("split").distinct().collect()]
    first = None
    for name in names:
        some = df.filter(F.col("split").eqNullSafe(F.lit(name))).orderBy(key).limit(n)
        first = some if first is None else first.unionByName(some)
    if first is None:
        return df.withColumn("row_idx", F.lit(0).cast("long")).limit(0)
    rank = F.row_number().over(Window.partitionBy("split").orderBy(key))
    return first.withColumn("row_idx", (rank - 1).cast("long"))

"""Order-sensitive operators that never sort a whole key group in one task.

Spark rows have no position, and ``row_number()``, running sums, fills and lags over
``partitionBy(key)`` put each key into one task. Every operator here first cuts the order key
into *buckets* of similar size. A window runs inside ``(by, bucket)``, one small row per
``(by, bucket)`` carries the state from the buckets before, and a join on ``(by, bucket)`` puts
the two together. A key with a third of all rows is spread over all buckets.

Buckets are a pure function of the row's own values, with cut points fixed on the driver, so a
recomputed task always lands on the same answer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"
# Rows that a bucket holds at most on average; more rows make more buckets.
BUCKET_ROWS = 2_000_000
# Sampled rows per bucket that the cut points are taken from.
SAMPLE_PER_BUCKET = 64
_STEPS = [1 << p for p in range(20, -1, -1)]
MAX_CUTS = 2 * _STEPS[0] - 1


def default_buckets(spark: SparkSession, rows: int = 0) -> int:
    """As many buckets as the session has shuffle partitions, more if ``rows`` are many."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def upper_bound(key: Column, sorted_values: Column, max_size: int | None = None, field: str | None = None) -> Column:
    """How many entries of an ascending array are ``<= key`` (a binary search in the JVM).

    ``field`` names the key inside an array of structs.
    """
    steps = [s for s in _STEPS if max_size is None or s <= max_size]

    def advance(found: Column, step: Column) -> Column:
        ahead = found + step
        entry = F.get(sorted_values, ahead - 1)
        value = entry[field] if field else entry
        return F.when((ahead <= F.size(sorted_values)) & (value <= key), ahead).otherwise(found)

    if not steps:
        return F.lit(0)
    if max_size is not None and max_size > MAX_CUTS:
        raise ValueError(f"a search reaches {MAX_CUTS} entries, not {max_size}")
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)
    # Declared non-null, so that joins on it need no null filter and thus no second search.
    return F.coalesce(found, F.lit(0))


def _literal_array(values: Sequence, sql_type: str) -> Column:
    # One literal that the optimizer folds, in place of thousands of literal nodes.
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{sql_type}>")


def cut_points(df: DataFrame, keys: Sequence[Column], buckets: int) -> list[list]:
    """Cut points per key, at most ``buckets - 1`` each, from a sample of the rows.

    The sample has about ``SAMPLE_PER_BUCKET`` rows per bucket, however many rows there are, and no
    task sees more than its share of it; only a count of all rows comes before. Where the cut points
    lie decides how even the buckets are, never what an operator returns.
    """
    if buckets <= 1:
        return [[] for _ in keys]
    narrow = df.select(*[k.alias(f"c{i}") for i, k in enumerate(keys)])
    return cuts_of_sample(narrow, len(keys), buckets, narrow.count())


def cuts_of_sample(narrow: DataFrame, keys: int, buckets: int, rows: int) -> list[list]:
    """Cut points of the first ``keys`` columns of ``narrow``, which has ``rows`` rows."""
    wanted = SAMPLE_PER_BUCKET * buckets
    some = narrow if rows <= wanted else narrow.sample(wanted / rows, seed=17)
    # The bound holds on average; the limit makes it hard.
    drawn = some.limit(2 * wanted).collect()
    res = []
    for i in range(keys):
        values = sorted(r[i] for r in drawn if r[i] is not None)
        at = [values[len(values) * j // buckets] for j in range(1, buckets)] if values else []
        res.append(sorted(set(at)))
    return res


def bucket_expr(key: Column, cuts: Sequence, tie: Column | None = None, tie_cuts: Sequence = ()) -> Column:
    """Bucket number, increasing with ``(key, tie)``.

    Rows equal to a cut point get a bucket of their own, and that bucket is split further by
    the tie-breaker: one order value shared by a third of the rows is still spread out.
    """
    if not cuts:
        return F.lit(0).cast("long")
    sql_type = "double" if any(isinstance(c, float) for c in cuts) else "bigint"
    values = _literal_array(cuts, sql_type)
    pos = upper_bound(key, values, len(cuts))
    if tie is None or not tie_cuts:
        return pos.cast("long")
    on_cut = (pos > 0) & (F.get(values, pos - 1) == key)
    tie_type = "double" if any(isinstance(c, float) for c in tie_cuts) else "bigint"
    sub = upper_bound(tie, _literal_array(tie_cuts, tie_type), len(tie_cuts))
    width = len(tie_cuts) + 1
    return (
        (pos * 2 + F.when(on_cut, 0).otherwise(1)).cast("long") * width + F.when(on_cut, sub).otherwise(0)
    ).cast("long")


def with_bucket(
    df: DataFrame,
    key: Column,
    tie: Column | None = None,
    bucket: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add the bucket column; ``bucket`` gives it directly and saves the pass over the keys."""
    if bucket is not None:
        return df.withColumn(BUCKET, bucket.cast("long"))
    keys = [key] if tie is None else [key, tie]
    narrow = df.select(*[k.alias(f"c{i}") for i, k in enumerate(keys)])
    rows = narrow.count()
    n = buckets or default_buckets(df.sparkSession, rows)
    cuts = cuts_of_sample(narrow, len(keys), n, rows) if n > 1 else [[], []]
    return df.withColumn(BUCKET, bucket_expr(key, cuts[0], tie, cuts[1] if tie is not None else ()))


def _order(key: Column, tie: Column | None) -> list[Column]:
    return [key] if tie is None else [key, tie]


def _rank_key(key: Column, tie: Column | None) -> Column:
    return F.struct(*_order(key, tie))


def _carry_window(by: Sequence[str]):
    # Reads one row per (by, bucket): its size is the number of buckets, not of rows.
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(BUCKET)


def dense_index(
    df: DataFrame,
    key: Column,
    by: Sequence[str] = (),
    tie: Column | None = None,
    out: str = "row_idx",
    bucket: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Dense position 0, 1, 2 … of every row within ``by``, in order of ``(key, tie)``."""
    src = with_bucket(df, key, tie, bucket, buckets)
    at = [*by, BUCKET]
    inside = Window.partitionBy(*at).orderBy(*_order(key, tie))
    before = _carry_window(by).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        src.groupBy(*at)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*at, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    )
    return (
        src.withColumn("__rn", F.row_number().over(inside))
        .join(base, at)
        .withColumn(out, (F.col("__base") + F.col("__rn") - 1).cast("long"))
        .drop(BUCKET, "__rn", "__base")
    )


def running_sum(
    df: DataFrame,
    values: dict[str, Column],
    key: Column,
    by: Sequence[str] = (),
    tie: Column | None = None,
    bucket: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running totals within ``by``, one new column per entry of ``values``."""
    src = with_bucket(df, key, tie, bucket, buckets)
    for name, value in values.items():
        src = src.withColumn(f"__v_{name}", value)
    at = [*by, BUCKET]
    inside = Window.partitionBy(*at).orderBy(*_order(key, tie)).rowsBetween(Window.unboundedPreceding, 0)
    before = _carry_window(by).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        src.groupBy(*at)
        .agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
        .select(*at, *[F.sum(f"__s_{n}").over(before).alias(f"__b_{n}") for n in values])
    )
    res = src.select("*", *[F.sum(f"__v_{n}").over(inside).alias(f"__r_{n}") for n in values]).join(base, at)
    for name in values:
        total = F.coalesce(F.col(f"__b_{name}"), F.lit(0)) + F.coalesce(F.col(f"__r_{name}"), F.lit(0))
        res = res.withColumn(name, total)
    return res.drop(BUCKET, *[f"__{p}_{n}" for n in values for p in "vrb"])


def forward_fill(
    df: DataFrame,
    values: dict[str, Column],
    key: Column,
    by: Sequence[str] = (),
    tie: Column | None = None,
    bucket: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """As-of lookup: the last non-null value at or before each row, within ``by``."""
    src = with_bucket(df, key, tie, bucket, buckets)
    for name, value in values.items():
        src = src.withColumn(f"__v_{name}", value)
    at = [*by, BUCKET]
    inside = Window.partitionBy(*at).orderBy(*_order(key, tie)).rowsBetween(Window.unboundedPreceding, 0)
    before = _carry_window(by).rowsBetween(Window.unboundedPreceding, -1)

    def newest(name: str) -> Column:
        v = F.col(f"__v_{name}")
        return F.max_by(v, F.when(v.isNotNull(), _rank_key(key, tie))).alias(f"__s_{name}")

    base = (
        src.groupBy(*at)
        .agg(*[newest(n) for n in values])
        .select(*at, *[F.last(f"__s_{n}", ignorenulls=True).over(before).alias(f"__b_{n}") for n in values])
    )
    res = src.select(
        "*", *[F.last(f"__v_{n}", ignorenulls=True).over(inside).alias(f"__r_{n}") for n in values]
    ).join(base, at)
    for name in values:
        res = res.withColumn(name, F.coalesce(F.col(f"__r_{name}"), F.col(f"__b_{name}")))
    return res.drop(BUCKET, *[f"__{p}_{n}" for n in values for p in "vrb"])


def previous_value(
    df: DataFrame,
    value: Column,
    out: str,
    key: Column,
    by: Sequence[str] = (),
    tie: Column | None = None,
    bucket: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``lag(value, 1)`` within ``by``; null on the first row of each group."""
    src = with_bucket(df, key, tie, bucket, buckets).withColumn("__v", value)
    at = [*by, BUCKET]
    inside = Window.partitionBy(*at).orderBy(*_order(key, tie))
    base = (
        src.groupBy(*at)
        .agg(F.max_by("__v", _rank_key(key, tie)).alias("__last"))
        .select(*at, F.lag("__last").over(_carry_window(by)).alias("__carry"))
    )
    return (
        src.select("*", F.row_number().over(inside).alias("__rn"), F.lag("__v").over(inside).alias("__lag"))
        .join(base, at)
        .withColumn(out, F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__lag")))
        .drop(BUCKET, "__v", "__rn", "__lag", "__carry")
    )


def group_value(
    df: DataFrame,
    values: dict[str, tuple[Callable[[Column], Column], Column]],
    by: Sequence[str],
    bucket: Column,
) -> DataFrame:
    """Add an aggregate of the whole group to each of its rows.

    ``values`` maps a new column to ``(F.max | F.min | F.sum, expression)``. A plain join on
    ``by`` would send a group to one task; this one goes by ``(by, bucket)``.
    """
    src = df.withColumn(BUCKET, bucket.cast("long"))
    at = [*by, BUCKET]
    whole = Window.partitionBy(*by)
    partial = src.groupBy(*at).agg(*[fn(v).alias(f"__s_{n}") for n, (fn, v) in values.items()])
    total = partial.select(*at, *[fn(F.col(f"__s_{n}")).over(whole).alias(n) for n, (fn, _) in values.items()])
    return src.join(total, at).drop(BUCKET)

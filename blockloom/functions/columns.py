"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up(n: Column, k: Column | int) -> Column:
    """Smallest multiple of ``k`` that is ``>= n``; ``k`` must be positive."""
    if isinstance(k, int):
        if k <= 0:
            raise ValueError("round_up needs a positive multiple")
        k = F.lit(k)
        return n + F.pmod(k - F.pmod(n, k), k)
    safe = F.when(k > 0, k).otherwise(F.raise_error(F.lit("round_up needs a positive multiple")).cast("long"))
    return n + F.pmod(safe - F.pmod(n, safe), safe)


def fixed(x: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, exact half-even on the binary value.

    Diverged values are ``nan``, ``inf`` and ``-inf``.
    """
    v = x.cast("double")
    shown = F.call_function("format_number", v, F.lit("0." + "0" * digits))
    return (
        F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise(shown)
    )


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def format_elapsed(seconds: Column) -> Column:
    """Human-readable duration: ``0ms``, ``5.00s``, ``m:ssm``, ``h:mm:ssh``, ``d:hh:mm:ssd``.

    A duration that is not finite has no text: null.
    """
    s = seconds.cast("double")
    s = F.when(F.isnan(s) | (F.abs(s) == float("inf")), None).otherwise(s)
    # Every branch from one minute up is positive, so whole seconds carry all that is printed.
    whole = F.floor(s).cast("long")
    d = F.floor(whole / 86400).cast("string")
    h = F.pmod(F.floor(whole / 3600), F.lit(24))
    m = F.pmod(F.floor(whole / 60), F.lit(60))
    sec = _two(F.pmod(whole, F.lit(60)))
    return (
        F.when(s.isNull(), None)
        .when(s < 0.001, F.concat((s * 1000).cast("long").cast("string"), F.lit("ms")))
        .when(s < 60, F.concat(fixed(s, 2), F.lit("s")))
        .when(s < 3600, F.concat(m.cast("string"), F.lit(":"), sec, F.lit("m")))
        .when(s < 86400, F.concat_ws(":", h.cast("string"), _two(m), F.concat(sec, F.lit("h"))))
        .otherwise(F.concat_ws(":", d, _two(h), _two(m), F.concat(sec, F.lit("d"))))
    )


def last_path_part(name: Column) -> Column:
    """What follows the last ``/`` of a metric name."""
    return F.substring_index(name, "/", -1)


def by_split(split: Column, values: dict[str, int]) -> Column:
    """Look up a per-split constant known on the driver (a handful of named splits)."""
    expr = F.lit(None).cast("long")
    for name, value in values.items():
        expr = F.when(split == F.lit(name), F.lit(value).cast("long")).otherwise(expr)
    return expr


def int_div(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs."""
    return F.call_function("div", a.cast("long"), b.cast("long"))

"""Repeatable pseudo-random draws: digests of (seed, epoch, row, position).

``rand()`` depends on the partition and so changes when a lost task is rerun elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stream_id(seed: int, epoch: int, *keys: Column) -> Column:
    """Text that names one stream of draws."""
    return F.concat_ws("|", F.lit(f"{seed}|{epoch}"), *[k.cast("string") for k in keys])


def sort_draw(stream: Column) -> Column:
    """A 60-bit draw as a long, wide enough to make ties negligible at any corpus size."""
    return F.conv(F.substring(F.md5(stream), 1, 15), 16, 10).cast("long")


SORT_DRAW_BITS = 60


def sort_draw_bucket(draw: Column, buckets: int) -> Column:
    """Equal slices of the draw's range: the draws are uniform, so no quantile pass is needed."""
    bits = max(0, (buckets - 1).bit_length())
    return F.shiftright(draw, SORT_DRAW_BITS - bits)


def draws(stream: Column, n: Column) -> Column:
    """One draw per position ``0 … n-1``: eight hex digits, whose text order is their number order.

    A digest holds four draws, so hashing is paid once per four positions.
    """

    groups = F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / 4).cast("int"))
    digests = F.transform(groups, lambda j: F.md5(F.concat_ws("|", stream, j.cast("string"))))
    four = F.transform(digests, lambda d: F.array(*[F.substring(d, at, 8) for at in (1, 9, 17, 25)]))
    return F.slice(F.flatten(four), F.lit(1), n)


def threshold(p: float) -> str:
    """Hex text ``t`` such that a draw is ``< t`` with probability ``p``."""
    scaled = round(p * 2**32)
    if scaled >= 2**32:
        return "g"
    return f"{max(scaled, 0):08x}"


def uniform_id(stream: Column, i: Column, n: int) -> Column:
    """A uniform id in ``[0, n)`` for position ``i``, independent of ``draws``."""
    digest = F.md5(F.concat_ws("|", stream, F.lit("id"), i.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(n)).cast("int")

"""A keyed permutation of ``0 … n-1`` that is worked out value by value.

A number is split into two halves, ``x = left * b + right`` with ``left < a`` and ``right < b``, and each half in
turn is shifted by a digest of the other: a Feistel network, which can be run backwards. ``a * b`` may be a
little more than ``n``; a value that lands beyond ``n`` is sent through again, until it does not. So position
and block find each other without a sort, a shuffle or a table.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import int_div
from .draws import sort_draw, stream_id

ROUNDS = 6
# Walks beyond ``n`` that are followed. Fewer than ``a`` values lie there, so small sets need no more;
# of a thousand values or more, one in 31 to the power of this would.
MOST_WALKS = 40


@dataclass(frozen=True)
class Permutation:
    """The permutation of ``0 … n-1`` for one seed and epoch; the round functions are MD5 digests."""

    n: int
    seed: int
    epoch: int

    def __post_init__(self):
        if self.n < 0:
            raise ValueError("n must be 0 or more")

    @property
    def a(self) -> int:
        root = isqrt(max(self.n, 1))
        return root if root * root == self.n else root + 1

    @property
    def b(self) -> int:
        return -(-max(self.n, 1) // self.a)

    def _through(self, x: Column, backwards: bool) -> Column:
        sign = -1 if backwards else 1
        rounds = list(reversed(range(ROUNDS)) if backwards else range(ROUNDS))

        def shifted(half: Column, by: Column, number: Column, size: int) -> Column:
            digest = sort_draw(stream_id(self.seed, self.epoch, number, by))
            return F.pmod(half + sign * F.pmod(digest, F.lit(size)), F.lit(size))

        def turn(s: Column, number: Column) -> Column:
            even = number % 2 == 0
            return F.struct(
                F.when(even, shifted(s["l"], s["r"], number, self.a)).otherwise(s["l"]).alias("l"),
                F.when(even, s["r"]).otherwise(shifted(s["r"], s["l"], number, self.b)).alias("r"),
            )

        start = F.struct(int_div(x, F.lit(self.b)).alias("l"), F.pmod(x, F.lit(self.b)).cast("long").alias("r"))
        # The state is bound once a round; written out, it would double from round to round.
        return F.aggregate(F.array(*map(F.lit, rounds)), start, turn, lambda s: s["l"] * self.b + s["r"])

    def _walk(self, x: Column, backwards: bool) -> Column:
        if self.n <= 1:
            return F.lit(0).cast("long") + x * 0
        walks = F.sequence(F.lit(0), F.lit(min(self.a, MOST_WALKS)))

        def step(value: Column, i: Column) -> Column:
            return F.when((i > 0) & (value < self.n), value).otherwise(self._through(value, backwards))

        end = F.aggregate(walks, x.cast("long"), step)
        return F.when(end < self.n, end).otherwise(F.raise_error(F.lit("a walk did not come back")).cast("long"))

    def block_at(self, position: Column) -> Column:
        """The block at a position; positions are ``0 … n-1``."""
        return self._walk(position, backwards=False)

    def position_of(self, block: Column) -> Column:
        """The position of a block: the inverse of ``block_at``."""
        return self._walk(block, backwards=True)


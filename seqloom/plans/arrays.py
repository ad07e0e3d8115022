"""Windows as array expressions: a sequence is taken in overlapping pieces, nothing is shuffled or sorted.

Arrays of a piece are small, so temporary memory is bounded whatever the sequence's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows of a piece at least; where windows are long, a piece has four times their length.
PIECE = 1 << 10


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with ``x`` computed once, however often it is used."""
    return F.transform(F.array(x), then).getItem(0)


def drop(x: Column, n: int) -> Column:
    """An array without its first ``n`` elements."""
    return F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0))) if n else x


def folded(x: Column, width: int, merge: Callable[[Column, Column, int, int], Column]) -> Column:
    """Element ``i`` merges elements ``i`` to ``i + width - 1``, put together from doubled widths.

    ``merge`` also has how many elements its left and right sides stand for.  The last ``width - 1`` are of no use.
    """

    def step(part: Column, size: int, total: Column | None, done: int, left: int) -> Column:
        if left & 1:
            total = part if total is None else F.zip_with(total, drop(part, done), lambda a, b: merge(a, b, done, size))
            done += size
        if left == 1:
            return total
        doubled = F.zip_with(part, drop(part, size), lambda a, b: merge(a, b, size, size))
        return let(doubled, lambda p: step(p, 2 * size, total, done, left >> 1))

    return let(x, lambda p: step(p, 1, None, 0, width))


def extremes(x: Column, width: int, best: Callable[[Column, Column], Column] = F.least) -> Column:
    """Element ``i`` is the least (or what ``best`` picks) of elements ``i`` to ``i + width - 1``, as far as there are any."""

    def step(part: Column, size: int) -> Column:
        if size == width:
            return part
        by = min(size, width - size)
        return let(F.zip_with(part, drop(part, by), lambda a, b: best(a, b)), lambda p: step(p, size + by))

    return let(x, lambda p: step(p, 1))


def starts(n: Column, length: int) -> Column:
    """The first window of each piece of a sequence of ``n`` letters, at least ``length``."""
    return F.sequence(F.lit(0), F.greatest(n - length, F.lit(0)).cast("int"), F.lit(piece_windows(length)))


def piece_windows(length: int) -> int:
    return max(PIECE, 4 * length)


def before(start: Column) -> Column:
    """The first window that a piece reads: the one left of its own, to see repeats."""
    return F.greatest(start - 1, F.lit(0))


def cut(text: Column, narrow: Column, start: Column, length: int) -> Column:
    """The bytes of the piece whose own windows begin at ``start``; ``narrow`` says that each letter is one byte."""
    at, size = before(start), F.lit(piece_windows(length) + length)
    size = size - 1 + start - at
    return F.when(narrow, F.substring(text.cast("binary"), at + 1, size)).otherwise(F.substring(text, at + 1, size).cast("binary"))


def fresh(found: Column, start: Column, value: Callable[[Column], Column]) -> Column:
    """The elements of a piece whose value differs from the one before; the window left of the piece's own only serves to compare."""
    return let(found, lambda f: F.filter(f, lambda x, i: F.when(i > 0, ~value(x).eqNullSafe(value(F.get(f, i - 1)))).otherwise(start == 0)))

"""Scalar, array and bit expressions.  All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit field of a date list, its seven newest days and its
# newest day.
FIELD_BITS = 32
FIELD_MASK = 0xFFFFFFFF
WEEK_MASK = 0xFE000000
DAY_MASK = 0x80000000


def grade(value: Column, bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first bound that ``value`` is strictly above.

    ``bounds`` run from high to low; NULL falls through to ``otherwise``.
    """
    (bound, label), *rest = bounds
    expr = F.when(value > bound, label)
    for bound, label in rest:
        expr = expr.when(value > bound, label)
    return expr.otherwise(otherwise)


def one_of(value: Column, allowed: Sequence[str], what: str) -> Column:
    """``value``, failing the job on a non-NULL value outside ``allowed``."""
    message = F.concat(F.lit(f"not a valid {what}: "), value.cast("string"))
    return F.when(value.isNull() | value.isin(*allowed), value).otherwise(
        F.raise_error(message).cast("string")
    )


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` in doubles, with a zero divisor taken as one."""
    divisor = F.when(bottom == 0, F.lit(1.0)).otherwise(bottom.cast("double"))
    return top.cast("double") / divisor


def last_element(array: Column) -> Column:
    """Last element, NULL for an empty or NULL array."""
    return F.try_element_at(array, F.lit(-1))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``."""
    return F.datediff(later, earlier)


def same_values(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Pairwise equality in which two NULLs are equal."""
    return reduce(lambda a, b: a & b, [l.eqNullSafe(r) for l, r in zip(left, right, strict=True)])


def set_position(array: Column, position: Column, value: Column, zero: Column) -> Column:
    """``array`` with ``value`` at 1-based ``position``.

    Missing positions before it are filled with ``zero``, elements after it are
    kept, so setting the same position again gives the same array.  A NULL
    array counts as empty.
    """
    base = F.coalesce(array, F.array().cast("array<bigint>"))
    gap = F.greatest(position - 1 - F.size(base), F.lit(0))
    before = F.slice(F.concat(base, F.array_repeat(zero, gap)), F.lit(1), position - 1)
    after = F.slice(base, position + 1, F.greatest(F.size(base), F.lit(1)))
    return F.concat(before, F.array(value), after)


def active_bits(dates: Column, as_of: Column, top_bit_age: int = 0) -> Column:
    """Date list as a 32-bit field in a long.

    The top bit stands for the day ``top_bit_age`` days before ``as_of`` and
    each lower bit for the day before; dates outside the field are left out.
    """
    top = FIELD_BITS - 1 + top_bit_age

    def add_bit(acc: Column, day: Column) -> Column:
        shift = F.lit(top) - F.datediff(as_of, day)
        inside = (shift >= 0) & (shift < FIELD_BITS)
        return F.when(inside, acc.bitwiseOR(day_bit(shift))).otherwise(acc)

    return F.aggregate(dates, F.lit(0).cast("bigint"), add_bit)


def day_bit(shift: Column) -> Column:
    """The long with only bit ``shift`` set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), shift.cast("int"))

"""Column expressions and skew helpers shared by the operators."""

from tallyglass.functions.columns import (
    active_bits,
    days_between,
    grade,
    guarded_ratio,
    last_element,
    one_of,
    same_values,
    set_position,
)
from tallyglass.functions.skew import broadcast_checked, hot_keys, split_hot, with_salt

__all__ = [
    "active_bits",
    "broadcast_checked",
    "days_between",
    "grade",
    "guarded_ratio",
    "hot_keys",
    "last_element",
    "one_of",
    "same_values",
    "set_position",
    "split_hot",
    "with_salt",
]

"""Three-valued logic over sets of possible values. MAYBE is NULL, so AND, OR and NOT are SQL's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_true(possible: Column) -> Column:
    """Whether a value that may be any of an array of nullable booleans is true: TRUE if all are, MAYBE if any is true or
    maybe, else FALSE; FALSE for no possibility."""
    some = F.exists(possible, lambda x: F.coalesce(x, F.lit(True)))
    every = F.forall(possible, lambda x: F.coalesce(x, F.lit(False)))
    return F.when(F.size(possible) == 0, F.lit(False)).when(every, F.lit(True)).when(some, F.lit(None).cast("boolean")).otherwise(F.lit(False))


def all_true_agg(possible: Column) -> Column:
    """all_true as an aggregate over rows."""
    n, t, some = F.count(F.lit(1)), F.count_if(possible), F.count_if(F.coalesce(possible, F.lit(True)))
    return F.when(t == n, F.lit(True)).when(some > 0, F.lit(None).cast("boolean")).otherwise(F.lit(False))


def invert(x: Column) -> Column:
    return ~x


def is_ambiguous(possible: Column) -> Column:
    return F.size(possible) != 1


def single_value(possible: Column) -> Column:
    """The value if there is exactly one possibility, else null (unknown)."""
    return F.when(F.size(possible) == 1, F.try_element_at(possible, F.lit(1)))


def value_or_unknown(members: Column, name: Column) -> Column:
    return F.coalesce(F.try_element_at(members, name), F.lit("unknown"))


def item(values: Column, index: Column) -> Column:
    """values[index] with Python's negative indices; null (unknown) where there is no such item."""
    return F.try_element_at(values, F.when(index >= 0, index + 1).otherwise(index).cast("int"))


def either(a: Column, b: Column) -> Column:
    """Possible values of a conditional expression whose condition is not known."""
    return F.array_union(a, b)


#: Python's operators on columns; what fails or is not known is null.
BINARY = {
    "+": lambda a, b: F.try_add(a, b), "-": lambda a, b: F.try_subtract(a, b), "*": lambda a, b: F.try_multiply(a, b), "/": lambda a, b: F.try_divide(a, b),
    "//": lambda a, b: F.floor(F.try_divide(a, b)), "%": lambda a, b: F.when(b != 0, a - b * F.floor(F.try_divide(a, b))), "**": lambda a, b: F.pow(a, b),
    "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b),
    "<<": lambda a, b: a * F.pow(F.lit(2), b).cast("bigint"), ">>": lambda a, b: F.floor(a / F.pow(F.lit(2), b)),
}
UNARY = {"+": lambda a: a, "-": lambda a: -a, "~": lambda a: F.bitwise_not(a), "not": lambda a: ~a}

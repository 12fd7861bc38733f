"""The engine's semantics for users of the DataFrame API, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelake.plans.sqltext import similar_pattern


def ascending(column: Column | str) -> Column:
    """Ascending, NULLs last."""
    return (F.col(column) if isinstance(column, str) else column).asc_nulls_last()


def descending(column: Column | str) -> Column:
    """Descending, NULLs first."""
    return (F.col(column) if isinstance(column, str) else column).desc_nulls_first()


def array_agg(column: Column | str) -> Column:
    """All values of a group, NULLs too."""
    return F.transform(F.collect_list(F.struct((F.col(column) if isinstance(column, str) else column).alias("v"))), lambda e: e["v"])


def similar_to(column: Column | str, pattern: str) -> Column:
    return F.rlike(F.col(column) if isinstance(column, str) else column, F.lit(similar_pattern(pattern)))


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def integer_divide(a: Column, b: Column) -> Column:
    """Division of integers, cut towards zero."""
    return F.when(b != 0, ((a - F.when(a % b == 0, F.lit(0)).otherwise(a % b)) / b).cast("long"))

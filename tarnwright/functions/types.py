"""Casts that give a query the types of standard SQL, whichever engine runs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big(x: Column | str) -> Column:
    """A whole number as bigint."""
    return (F.col(x) if isinstance(x, str) else x).cast("bigint")


def money(x: Column | str, digits: int = 2) -> Column:
    """A double as a decimal, so that sums don't depend on the order of rows."""
    return (F.col(x) if isinstance(x, str) else x).cast(f"decimal(14,{digits})")


def dbl(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def ntz(x: Column | str) -> Column:
    """A timestamp without a zone."""
    return (F.col(x) if isinstance(x, str) else x).cast("timestamp_ntz")

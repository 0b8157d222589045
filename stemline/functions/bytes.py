"""Column functions on bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_value(b: Column) -> Column:
    """The value of a binary column's only byte, 0 to 255."""
    return F.conv(F.hex(b), 16, 10).cast("int")


def symbol(b: Column) -> Column:
    """The symbol of one byte, 1 to 256; of none, the sentinel, 0."""
    return F.when(F.octet_length(b) > 0, byte_value(b) + 1).otherwise(0)

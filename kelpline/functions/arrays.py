"""Functions of numeric arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalised(vector: Column) -> Column:
    """A vector of length 1 in the same direction; one of length 0 stays as it is."""
    norm = F.sqrt(total(F.transform(vector, lambda x: x * x)))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def softmax(values: Column) -> Column:
    """Shares of the exponentials; the largest value is taken off first, so none overflows."""
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(powers, lambda p: p / total(powers))


def hex_number(text: Column) -> Column:
    """A hexadecimal text of up to 16 digits as a long with the same bits; null for other texts."""
    high = lambda i, n: F.conv(F.substring(F.lpad(text, 16, "0"), i, n), 16, 10).cast("long")
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.shiftleft(high(1, 8), 32).bitwiseOR(high(9, 8)))

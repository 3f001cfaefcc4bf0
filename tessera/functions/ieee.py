"""Arithmetic that follows IEEE 754 where ANSI mode would raise."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(left: Column, right: Column) -> Column:
    """left / right with infinities and NaN for zero divisors."""
    left, right = left.cast("double"), right.cast("double")
    return F.when(right == 0, left * F.pow(right, F.lit(-1.0))).otherwise(left / F.when(right != 0, right))

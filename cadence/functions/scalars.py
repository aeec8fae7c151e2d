"""Scalar functions of signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), without overflow at either end."""
    return 0.5 * (1 + F.tanh(x / 2))


def angle(y: Column, x: Column) -> Column:
    """Degrees from the x axis."""
    return F.degrees(F.atan2(y, x))


def reach(x: Column, y: Column) -> Column:
    return F.hypot(x, y)

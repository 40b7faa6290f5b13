"""Binning expressions. Statistics they need (edges, extremes) are plain arguments."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def edges_crossed(column: Column, edges: Sequence[float]) -> Column:
    """How many edges lie strictly below the value: its bin, edges closed on the right."""
    if not edges:
        return F.when(column.isNotNull(), F.lit(0))
    return reduce(lambda a, b: a + b, [(column > F.lit(e)).cast("int") for e in edges])


def bin_edges(
    column: Column,
    edges: Sequence[float],
    labels: Sequence[str],
    include_lowest: bool = False,
) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]`` that holds the value, else NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    if any(b < a for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must not decrease")
    chain = None
    for i, label in enumerate(labels):
        low = column >= F.lit(edges[i]) if include_lowest and i == 0 else column > F.lit(edges[i])
        inside = low & (column <= F.lit(edges[i + 1]))
        chain = F.when(inside, F.lit(label)) if chain is None else chain.when(inside, F.lit(label))
    return chain


def bin_equal_width(column: Column, low: float, high: float, k: int) -> Column:
    """Index of one of ``k`` intervals of equal width between the two extremes."""
    if low == high:
        # One value: the only interval that holds it lies in the middle.
        return F.when(column.isNotNull(), F.lit((k - 1) // 2))
    width = (high - low) / k
    position = F.ceil((column - F.lit(low)) / F.lit(width)) - 1
    inside = F.least(F.greatest(position, F.lit(0)), F.lit(k - 1)).cast("int")
    # Least and greatest would pass over a missing value.
    return F.when(column.isNotNull(), inside)


def bin_fixed_width(column: Column, size: float) -> Column:
    """Lower bound of the bin of the given width that holds the value."""
    if not size > 0 or math.isinf(size):
        raise ValueError("the bin width must be a positive number")
    return (F.floor(column / F.lit(size)) * F.lit(size)).cast("double")

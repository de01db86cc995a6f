"""Placing numbers between evenly spaced edges, exactly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def even_edges(low: float, high: float, count: int) -> list[float]:
    """`count` edges from `low` to `high`."""
    return [float(e) for e in np.linspace(low, high, count)]


def edge_at(edges: Sequence[float], i: Column) -> Column:
    """The i-th edge, counted from 0; null outside."""
    return F.get(F.array(*[F.lit(e) for e in edges]), i)


def edges_passed(x: Column, edges: Sequence[float], inclusive: bool = True) -> Column:
    """How many of the even `edges` lie at or below `x`, or strictly below it.

    A division guesses the number and two comparisons with the edges themselves correct
    it, so the cost does not grow with the number of edges and rounding cannot misplace
    a value that equals an edge.
    """
    m = len(edges)
    step = (edges[-1] - edges[0]) / (m - 1) if m > 1 else 1.0
    guess = F.least(F.greatest(F.floor((x - F.lit(edges[0])) / F.lit(step)) + 1, F.lit(0)), F.lit(m)).cast("int")
    passed = (lambda e: e <= x) if inclusive else (lambda e: e < x)
    above, here = edge_at(edges, guess), edge_at(edges, guess - 1)
    return (
        F.when((guess < m) & passed(above), guess + 1)
        .when((guess > 0) & ~passed(here), guess - 1)
        .otherwise(guess)
    )

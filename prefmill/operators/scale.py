"""Min-max scaling and thresholds over matrix cells.

Inputs are read twice (extremes, then values), so pass frozen or cheap tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Span:
    """A value range; ``scale`` maps it to 0..1. An empty range maps to 1."""

    low: float
    high: float

    def scale(self, value: str | Column) -> Column:
        v = F.col(value) if isinstance(value, str) else value
        if self.high <= self.low:
            return F.lit(1.0)
        return (v - self.low) / (self.high - self.low)


def positive_span(cells: DataFrame, value: str = "value") -> Span:
    row = cells.where(F.col(value) > 0).agg(F.min(value), F.max(value)).first()
    return Span(float(row[0] or 0.0), float(row[1] or 0.0))


def full_span(cells: DataFrame, n_cells: int | None = None, value: str = "value") -> Span:
    """Extremes over a matrix of ``n_cells`` cells, those not stored being 0."""
    row = cells.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
    low, high = float(row[0] or 0.0), float(row[1] or 0.0)
    if n_cells is None or row[2] < n_cells:
        low, high = min(low, 0.0), max(high, 0.0)
    return Span(low, high)


def minmax_positive(cells: DataFrame, value: str = "value", span: Span | None = None) -> DataFrame:
    """Scale positive cells by their own extremes; others become 0."""
    span = span or positive_span(cells, value)
    return cells.withColumn(value, F.when(F.col(value) > 0, span.scale(value)).otherwise(0.0))


def minmax_all(cells: DataFrame, n_cells: int | None = None, value: str = "value") -> DataFrame:
    """Scale by the extremes of the whole matrix. With a 0 minimum, cells not
    stored stay 0."""
    return cells.withColumn(value, full_span(cells, n_cells, value).scale(value))


def zero_below(cells: DataFrame, tau: float, value: str = "value") -> DataFrame:
    return cells.withColumn(value, F.when(F.col(value) < tau, 0.0).otherwise(F.col(value)))


def sparsify(cells: DataFrame, eps: float = 1e-6, value: str = "value") -> DataFrame:
    return cells.where(F.col(value) > eps)

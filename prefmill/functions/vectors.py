"""Fixed-length vector arithmetic that stays inside generated code.

Written as SQL text: one parse instead of many calls into the JVM. Small
matrices enter as array literals, so plans of later rounds reuse compiled code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _array(terms) -> Column:
    return F.expr(f"array({', '.join(terms)})")


def dot(a: str, b: str, k: int) -> Column:
    """Inner product of two length-``k`` arrays, in double precision."""
    return F.expr(" + ".join(f"double({a}[{d}]) * double({b}[{d}])" for d in range(k)))


def weighted_sum(weight: str, vec: str, k: int) -> Column:
    """Aggregate: element-wise sum of ``weight * vec`` as an array."""
    return _array(f"sum(double({weight}) * double({vec}[{d}]))" for d in range(k))


def vec_sum(vec: str, k: int) -> Column:
    return weighted_sum("1", vec, k)


def outer_sums(vec: str, k: int) -> Column:
    """Aggregate: upper triangle of the summed outer products, row by row."""
    return _array(f"sum(double({vec}[{a}]) * double({vec}[{b}]))" for a in range(k) for b in range(a, k))


def literal(numbers) -> Column:
    return F.lit([float(x) for x in numbers])


def times_matrix(vec: str, matrix: str, k: int) -> Column:
    """Row vector times a k x k matrix held row by row in the array ``matrix``."""
    return _array(
        " + ".join(f"double({vec}[{e}]) * {matrix}[{e * k + d}]" for e in range(k)) for d in range(k))


def combine(template: str, k: int) -> Column:
    """Array of ``template`` with ``{d}`` running over the positions."""
    return _array(template.format(d=d) for d in range(k))


def zeros(k: int) -> Column:
    return F.lit([0.0] * k)

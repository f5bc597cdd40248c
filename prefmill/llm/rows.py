"""A caller's columns carried through joins as one struct, so that no name of theirs can meet one of ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *own: Column, apart: tuple[str, ...] = ()) -> DataFrame:
    """``own`` columns, the columns ``apart`` under their names, and all others in the struct ``row``."""
    rest = [c for c in docs.columns if c not in apart]
    return docs.select(*own, *[col(c) for c in apart], F.struct(*[col(c) for c in rest]).alias("row"))


def unpacked(names: list[str], apart: dict[str, Column]) -> list[Column]:
    """The columns ``names`` again, those in ``apart`` from there and the others out of ``row``."""
    return [(apart[c] if c in apart else F.col("row").getField(c)).alias(c) for c in names]

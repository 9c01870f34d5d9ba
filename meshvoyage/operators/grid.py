"""Flow fields on a regular grid: divergence and curl by differences between neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _gradient(value: str, along: str, across: str) -> Column:
    """Central differences, one-sided at the borders, along one axis."""
    w = W.partitionBy(across).orderBy(along)
    before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - own).when(after.isNull(), own - before).otherwise((after - before) / 2.0)


def divergence(grid: DataFrame) -> DataFrame:
    """(i, j, divergence) of a field (i, j, u, v): the sum of the differences of u along i and of v along j."""
    return grid.select("i", "j", (_gradient("u", "i", "j") + _gradient("v", "j", "i")).alias("divergence"))


def curl(grid: DataFrame) -> DataFrame:
    """(i, j, curl) of a field (i, j, u, v): the difference of v along i less that of u along j."""
    return grid.select("i", "j", (_gradient("v", "i", "j") - _gradient("u", "j", "i")).alias("curl"))

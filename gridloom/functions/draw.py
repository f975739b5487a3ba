"""User functions that draw: rows to geometry as a table function, selection strategies as a protocol."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="subpath int, ord int, x double, y double")
class RegularPolygon:
    """draw(x, y, radius, sides): the outline of a regular polygon, closed, one row a point."""

    def eval(self, x: float, y: float, radius: float, sides: int):
        if x is None or y is None or radius is None or sides is None or sides < 3:
            return
        for i in range(sides + 1):
            a = 2 * math.pi * (i % sides) / sides - math.pi / 2
            yield 0, i, x + radius * math.cos(a), y + radius * math.sin(a)


def register(spark: SparkSession) -> None:
    """Make ``regular_polygon`` a table function in SQL."""
    spark.udtf.register("regular_polygon", RegularPolygon)


class SelectionStrategy(Protocol):
    """What a layer does with a view: the rows to draw, the row under a point, the rows in a rectangle."""

    def select(self, rows: DataFrame, view) -> DataFrame: ...

    def pick(self, rows: DataFrame, px: float, py: float, view) -> DataFrame: ...

    def pick_region(self, rows: DataFrame, rect: tuple[float, float, float, float], view) -> DataFrame: ...


class Decluttered:
    """The strategy of decluttered points: what is kept is drawn and picked."""

    def __init__(self, spacing: float = 1.0):
        self.spacing = spacing

    def select(self, rows: DataFrame, view) -> DataFrame:
        from gridloom.operators.declutter import declutter

        return rows.join(declutter(rows, view, self.spacing), "id", "left_semi")

    def pick(self, rows: DataFrame, px: float, py: float, view) -> DataFrame:
        from gridloom.operators.view import pick_nodes

        return pick_nodes(self.select(rows, view), px, py, view)

    def pick_region(self, rows: DataFrame, rect: tuple[float, float, float, float], view) -> DataFrame:
        from gridloom.operators.view import region_nodes

        return region_nodes(self.select(rows, view), rect, view)

"""A raster's grid as arithmetic on cell numbers: row-major from the top left, 1-based, no row for a missing cell."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """xmin, ymax: the top left corner; res_x, res_y: cell size; ncol, nrow."""

    xmin: float
    ymax: float
    res_x: float
    res_y: float
    ncol: int
    nrow: int

    @property
    def ncell(self) -> int:
        return self.ncol * self.nrow

    @property
    def cell_area(self) -> float:
        return self.res_x * self.res_y

    def row(self, cell: Column) -> Column:
        """0-based."""
        return F.floor((cell - 1) / F.lit(self.ncol))

    def col(self, cell: Column) -> Column:
        return (cell - 1) % F.lit(self.ncol)

    def x(self, cell: Column) -> Column:
        """Centre of the cell."""
        return F.lit(self.xmin) + (self.col(cell) + F.lit(0.5)) * F.lit(self.res_x)

    def y(self, cell: Column) -> Column:
        return F.lit(self.ymax) - (self.row(cell) + F.lit(0.5)) * F.lit(self.res_y)

    def cell(self, row: Column, col: Column) -> Column:
        """Null outside the grid."""
        inside = row.between(0, self.nrow - 1) & col.between(0, self.ncol - 1)
        return F.when(inside, (row * self.ncol + col + 1).cast("long"))

    def cell_from_xy(self, x: Column, y: Column) -> Column:
        """Cell that holds a point; a point on an edge belongs to the cell right of or below it; null outside."""
        return self.cell(F.floor((F.lit(self.ymax) - y) / F.lit(self.res_y)), F.floor((x - F.lit(self.xmin)) / F.lit(self.res_x)))


def steps_within(grid: GridSpec, radius: float) -> list[tuple[int, int]]:
    """Row and column steps whose cell centres lie within radius, the zero step included."""
    rows, cols = int(radius / grid.res_y) + 1, int(radius / grid.res_x) + 1
    return [(r, c) for r in range(-rows, rows + 1) for c in range(-cols, cols + 1) if math.hypot(r * grid.res_y, c * grid.res_x) <= radius + 1e-9]


def square_steps(w: int) -> list[tuple[int, int]]:
    """Steps of a w x w window."""
    h = w // 2
    return [(r, c) for r in range(-h, h + 1) for c in range(-h, h + 1)]


EIGHT = [s for s in square_steps(3) if s != (0, 0)]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def neighbours(df: DataFrame, grid: GridSpec, steps: list[tuple[int, int]], cell: str = "pixelID", to: str = "to") -> DataFrame:
    """Each row once for every cell reached by a step; steps off the grid fall away. An equi-joinable column."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps))).alias("__s")
    out = df.select("*", each)
    there = grid.cell(grid.row(F.col(cell)) + F.col("__s.r"), grid.col(F.col(cell)) + F.col("__s.c"))
    return out.withColumn(to, there).where(F.col(to).isNotNull()).drop("__s")


def densify(df: DataFrame, grid: GridSpec) -> DataFrame:
    """Every cell of the grid; null layers where df has no row."""
    spark: SparkSession = df.sparkSession
    return spark.range(1, grid.ncell + 1).withColumnRenamed("id", "pixelID").join(df, "pixelID", "left")

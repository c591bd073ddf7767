"""Voxel counts of a stream of points, on a grid that is fixed beforehand.

The batch engine derives its grid from the whole cloud, which a stream never has; with a given grid the
counts are an ordinary streaming aggregation. This goes beyond what the batch engine answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.voxel import Grid, voxel_counts


def fixed_grid(low: tuple[float, float, float], high: tuple[float, float, float], voxel_size: float) -> Grid:
    return Grid(low, high, voxel_size, 0, tuple(b - a for a, b in zip(low, high)))


def running_counts(points: DataFrame, grid: Grid) -> DataFrame:
    """(voxel_id, n) so far; for output mode update or complete. State is one row an occupied voxel."""
    return voxel_counts(points, grid)


def windowed_counts(points: DataFrame, grid: Grid, time: str, width: str, late: str) -> DataFrame:
    """(window, voxel_id, n) for each window of event time; points later than `late` are dropped, and state with them."""
    from gridloom.operators.voxel import finite, linear, voxel_of

    gx, gy, gz = grid.dims
    at = finite(points.withWatermark(time, late)).select(time, *[voxel_of(a, grid).alias(f"v{a}") for a in "xyz"])
    inside = at.where(F.col("vx").between(0, gx - 1) & F.col("vy").between(0, gy - 1) & F.col("vz").between(0, gz - 1))
    return inside.groupBy(F.window(time, width), linear(F.col("vx"), F.col("vy"), F.col("vz"), gx, gy).alias("voxel_id")).agg(F.count("*").alias("n"))

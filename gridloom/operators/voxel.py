"""Points to voxels: bounding box, grid, counts, threshold, and back to voxel centres.

All arithmetic on coordinates is in 32-bit floats, as results depend on it: a point's voxel is found by a
multiplication with the reciprocal of the voxel size, the grid's extent by a division.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.settings import CompressionSettings

AXES = ("x", "y", "z")
_F32 = np.float32


def f32(value) -> Column:
    """A FLOAT literal."""
    return F.lit(float(_F32(value))).cast("float")


def cloud(df: DataFrame, x: Column, y: Column, z: Column) -> DataFrame:
    """A point cloud (x, y, z as FLOAT) from the columns of any table."""
    return df.select(*[c.cast("float").alias(a) for c, a in zip((x, y, z), AXES)])


def finite(points: DataFrame) -> DataFrame:
    """The points whose coordinates are all numbers; null, NaN and infinite ones go."""
    keep = F.lit(True)
    for a in AXES:
        keep = keep & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))
    return points.where(keep)


def bounding_box(points: DataFrame) -> DataFrame:
    """One row: min_x, max_x, min_y, max_y, min_z, max_z, n_points."""
    return finite(points).agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n_points"))


@dataclass(frozen=True)
class Grid:
    """The grid of one cloud at one voxel size: a few driver scalars, from one aggregate row."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    voxel_size: float
    n_points: int
    #: Extent of the cloud before any margin.
    extent: tuple[float, float, float]

    @property
    def dims(self) -> tuple[int, int, int]:
        size = _F32(self.voxel_size)
        return tuple(int(np.ceil((_F32(b) - _F32(a)) / size)) + 1 for a, b in zip(self.low, self.high))

    @property
    def inverse(self) -> np.float32:
        return _F32(1) / _F32(self.voxel_size)

    @property
    def voxels(self) -> int:
        x, y, z = self.dims
        return x * y * z

    def blocks(self, size: int) -> tuple[int, int, int]:
        return tuple(-(-d // size) for d in self.dims)

    def block_count(self, size: int) -> int:
        x, y, z = self.blocks(size)
        return x * y * z

    def at(self, voxel_size: float) -> Grid:
        """The same box at another voxel size."""
        return Grid(self.low, self.high, voxel_size, self.n_points, self.extent)

    def margins(self, ratio: float) -> tuple[float, float, float]:
        """Width added on each side, as reported: in doubles, of the cloud's own extent."""
        return tuple(e * float(_F32(ratio)) for e in self.extent)


def widened(low, high, ratio: float):
    """A box with a margin of `ratio` of its width on each side; no margin where it has no width."""
    a, b, r = _F32(low), _F32(high), _F32(max(0.0, ratio))
    width = b - a
    pad = (_F32(0) if width < np.finfo(_F32).eps else width) * r
    return (float(a - pad), float(b + pad)) if r > 0 else (float(a), float(b))


def grid_of(points: DataFrame, settings: CompressionSettings) -> Grid | None:
    """The grid of a cloud: the one eager step, an aggregate of a single row. None for an empty cloud."""
    row = bounding_box(points).first()
    if not row.n_points:
        return None
    sides = [widened(row[f"min_{a}"], row[f"max_{a}"], settings.margin) for a in AXES]
    grid = Grid(tuple(s[0] for s in sides), tuple(s[1] for s in sides), settings.voxel_size, row.n_points, tuple(float(row[f"max_{a}"]) - float(row[f"min_{a}"]) for a in AXES))
    if grid.voxels >= 1 << 63:
        raise OverflowError(f"a grid of {grid.dims} voxels is beyond 64-bit ids; take larger voxels")
    return grid


def linear(x: Column, y: Column, z: Column, gx: int, gy: int) -> Column:
    """Voxel id, x fastest."""
    return (z.cast("long") * gx * gy) + y.cast("long") * gx + x.cast("long")


def delinear(column: str, gx: int, gy: int) -> dict[str, Column]:
    """The coordinates of a voxel id."""
    return {"vx": F.expr(f"cast({column} % {gx} as int)"), "vy": F.expr(f"cast({column} div {gx} % {gy} as int)"), "vz": F.expr(f"cast({column} div {gx * gy} as int)")}


def voxel_of(axis: str, grid: Grid) -> Column:
    """A coordinate's voxel index, or null where it can't be an int."""
    k = AXES.index(axis)
    return ((F.col(axis) - f32(grid.low[k])) * f32(grid.inverse)).cast("float").try_cast("int")


def clamped(points: DataFrame, grid: Grid) -> DataFrame:
    """Each point with the voxel it is nearest to in the grid, by division, and that voxel's id."""
    out = finite(points)
    for k, a in enumerate(AXES):
        v = ((F.col(a) - f32(grid.low[k])) / f32(grid.voxel_size)).cast("float").try_cast("int")
        out = out.withColumn(f"v{a}", F.greatest(F.lit(0), F.least(v, F.lit(grid.dims[k] - 1))))
    return out.withColumn("voxel_id", linear(F.col("vx"), F.col("vy"), F.col("vz"), *grid.dims[:2]))


def voxel_counts(points: DataFrame, grid: Grid) -> DataFrame:
    """(voxel_id, n): points of each voxel that has any; points outside the grid count nowhere.

    One shuffle of (id, partial count) pairs; crowded voxels are summed before it.
    """
    gx, gy, gz = grid.dims
    at = finite(points).select(*[voxel_of(a, grid).alias(f"v{a}") for a in AXES])
    inside = at.where((F.col("vx").between(0, gx - 1)) & F.col("vy").between(0, gy - 1) & F.col("vz").between(0, gz - 1))
    return inside.select(linear(F.col("vx"), F.col("vy"), F.col("vz"), gx, gy).alias("voxel_id")).groupBy("voxel_id").agg(F.count("*").alias("n"))


def committed(counts: DataFrame, settings: CompressionSettings) -> DataFrame:
    """The voxels with enough points."""
    return counts.where(F.col("n") >= settings.threshold)


def located(voxels: DataFrame, grid: Grid) -> DataFrame:
    """Voxels with their coordinates vx, vy, vz."""
    return voxels.withColumns(delinear("voxel_id", *grid.dims[:2]))


def centres(voxels: DataFrame, grid: Grid) -> DataFrame:
    """(voxel_id, x, y, z): the middle of each voxel, the cloud a grid stands for."""
    side = f32(grid.voxel_size)
    return located(voxels, grid).select("voxel_id", *[(f32(grid.low[k]) + ((F.col(f"v{a}").cast("float") + f32(0.5)) * side)).cast("float").alias(a) for k, a in enumerate(AXES)])


def lookup(points: DataFrame, voxels: DataFrame, grid: Grid) -> DataFrame:
    """Whether each voxel asked for (vx, vy, vz) is occupied; outside the grid none is."""
    gx, gy, gz = grid.dims
    inside = F.col("vx").between(0, gx - 1) & F.col("vy").between(0, gy - 1) & F.col("vz").between(0, gz - 1)
    asked = points.withColumn("voxel_id", F.when(inside, linear(F.col("vx"), F.col("vy"), F.col("vz"), gx, gy)))
    return asked.join(voxels.select("voxel_id", F.lit(True).alias("hit")), "voxel_id", "left").withColumn("occupied", F.coalesce("hit", F.lit(False))).drop("hit")


def set_voxels(voxels: DataFrame, more: DataFrame) -> DataFrame:
    return voxels.select("voxel_id").union(more.select("voxel_id")).distinct()


def clear_voxels(voxels: DataFrame, gone: DataFrame) -> DataFrame:
    return voxels.join(gone.select("voxel_id").distinct(), "voxel_id", "left_anti")


def statistics(counts: DataFrame, grid: Grid, settings: CompressionSettings) -> DataFrame:
    """One row: candidate and committed voxels, and the occupancy ratio (a FLOAT; 0 for no voxels)."""
    gx, gy, gz = grid.dims
    out = counts.agg(F.count("*").alias("candidate_voxels"), F.coalesce(F.sum((F.col("n") >= settings.threshold).cast("long")), F.lit(0)).alias("committed_voxels"))
    ratio = (F.col("committed_voxels").cast("float") / F.lit(grid.voxels).cast("float")).cast("float")
    return out.select(F.lit(gx).alias("gx"), F.lit(gy).alias("gy"), F.lit(gz).alias("gz"), F.lit(grid.voxels).cast("long").alias("total_voxels"), "candidate_voxels", "committed_voxels", ratio.alias("occupancy_ratio"))

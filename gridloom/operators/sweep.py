"""Parameter sweeps: the best block size, the best voxel size. Each is one job over all candidates."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.dictionary import index_width_column
from gridloom.operators.voxel import AXES, Grid, f32, finite, located

_F32 = np.float32


def block_size_sweep(voxels: DataFrame, grid: Grid, sizes: list[int]) -> DataFrame:
    """(block_size, n_blocks, n_patterns, index_bits, compressed_bytes, ratio) of each size.

    Voxels don't depend on the block size: they are made once, and each is put into its block of every
    size. Only the number of distinct patterns is needed of a size, so no dictionary is built.
    """
    gx, gy, gz = grid.dims
    spark = voxels.sparkSession
    s = F.col("block_size")
    across = lambda g: F.expr(f"({g} + block_size - 1) div block_size")
    each = located(voxels, grid).select("vx", "vy", "vz", F.explode(F.array(*[F.lit(x) for x in sizes])).alias("block_size"))
    each = each.select(
        "block_size",
        ((F.expr("vz div block_size") * across(gy) + F.expr("vy div block_size")) * across(gx) + F.expr("vx div block_size")).alias("block_id"),
        ((F.col("vz") % s * s + F.col("vy") % s) * s + F.col("vx") % s).cast("int").alias("bit"),
    )
    blocks = each.groupBy("block_size", "block_id").agg(F.sort_array(F.collect_list("bit")).alias("bits"))
    distinct = blocks.groupBy("block_size", "bits").agg(F.count("*").alias("uses"))
    found = distinct.groupBy("block_size").agg(F.count("*").alias("patterns"), F.sum("uses").alias("occupied"))
    every = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in sizes])).alias("block_size"))
    out = every.join(found, "block_size", "left").withColumn("n_blocks", (across(gx) * across(gy) * across(gz)).cast("long"))
    out = out.withColumn("n_patterns", F.coalesce("patterns", F.lit(0)) + (F.coalesce("occupied", F.lit(0)) < F.col("n_blocks")).cast("long"))
    out = out.withColumn("index_bits", index_width_column(F.col("n_patterns") - 1))
    size = F.col("n_blocks") * F.expr("index_bits div 8") + F.col("n_patterns") * F.expr("(cast(block_size as long) * block_size * block_size + 7) div 8")
    out = out.withColumn("compressed_bytes", size.cast("long"))
    ratio = F.col("compressed_bytes").cast("float") / F.lit(12 * grid.n_points).cast("float")
    return out.select("block_size", "n_blocks", "n_patterns", "index_bits", "compressed_bytes", ratio.cast("float").alias("ratio"))


def best_block_size(sweep: DataFrame) -> DataFrame:
    """The row of the lowest ratio; of equals, the smallest size."""
    return sweep.orderBy("ratio", "block_size").limit(1)


def voxel_sizes(least: float = 0.005, most: float = 0.05, step: float = 0.005) -> list[float]:
    """Sizes of a sweep, summed up step by step in 32-bit floats, as that decides whether the last is in."""
    out, size = [], _F32(least)
    while size <= _F32(most):
        out.append(float(size))
        size = _F32(size + _F32(step))
    return out


def cells(points: DataFrame, grid: Grid, grids: list[Grid]) -> DataFrame:
    """(x, y, z, n): of all points that share their voxel at every size, one, as its distance from the box's corner, and their number.

    Along an axis no size's index ever falls, so the sum of all sizes' indices is the same for two points only if
    each index is. Points far outside the box are brought nearer, to where they are outside at every size.
    """
    least, most = min(g.voxel_size for g in grids), max(g.voxel_size for g in grids)
    ends = [2 * (b - a) + 4 * most for a, b in zip(grid.low, grid.high)]
    at = finite(points).select(*[F.greatest(f32(-2 * most), F.least(f32(e), F.col(a) - f32(grid.low[i]))).alias(a) for i, (a, e) in enumerate(zip(AXES, ends))])
    index = lambda a, g: (F.col(a) * f32(g.inverse)).cast("float").cast("long")
    # Where indices go beyond what floats tell apart, a coordinate is its own cell.
    place = [reduce(add, [index(a, g) for g in grids]) if e / least < 1 << 53 else F.col(a) for a, e in zip(AXES, ends)]
    return at.groupBy(*[p.alias(f"at_{a}") for a, p in zip(AXES, place)]).agg(*[F.min(a).alias(a) for a in AXES], F.count("*").alias("n")).select(*AXES, "n")


def voxel_size_sweep(points: DataFrame, grid: Grid, sizes: list[float], threshold: int = 1) -> DataFrame:
    """(voxel_size, total_voxels, occupied, score) of each size, in one pass over the points.

    Points are brought down to cells first, of which there are hardly more than voxels of the smallest size;
    only those are put into their voxel of every size.
    """
    grids = [grid.at(s) for s in sizes]
    if any(g.voxels >= 1 << 63 for g in grids):
        raise OverflowError("the smallest voxels make a grid beyond 64-bit ids")
    entry = lambda k, g: F.struct(F.lit(k).alias("k"), f32(g.inverse).alias("inv"), *[F.lit(d).cast("long").alias(n) for n, d in zip(("gx", "gy", "gz"), g.dims)])
    each = cells(points, grid, grids).select(*AXES, "n", F.explode(F.array(*[entry(k, g) for k, g in enumerate(grids)])).alias("g"))
    each = each.select(F.col("g.k").alias("k"), "g", "n", *[(F.col(a) * F.col("g.inv")).cast("float").try_cast("long").alias(f"v{a}") for a in AXES])
    inside = each.where("vx >= 0 and vx < g.gx and vy >= 0 and vy < g.gy and vz >= 0 and vz < g.gz")
    counts = inside.groupBy("k", F.expr("vz * g.gx * g.gy + vy * g.gx + vx").alias("voxel_id")).agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(1, threshold)).groupBy("k").agg(F.count("*").alias("occupied"))
    every = points.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), f32(g.voxel_size).alias("voxel_size"), F.lit(g.voxels).cast("long").alias("total_voxels")) for k, g in enumerate(grids)])).alias("e")).select("e.*")
    out = every.join(found, "k", "left").withColumn("occupied", F.coalesce("occupied", F.lit(0)).cast("long"))
    share = (F.col("occupied").cast("float") / F.col("total_voxels").cast("float")).cast("float")
    out = out.withColumn("share", share)
    score = (F.col("share") * (f32(1) / (f32(1) + F.col("share"))).cast("float")).cast("float")
    return out.select("voxel_size", "total_voxels", "occupied", score.alias("score"))


def best_voxel_size(sweep: DataFrame) -> DataFrame:
    """The row of the highest score above 0; of equals, the smallest size."""
    return sweep.where("score > 0").orderBy(F.col("score").desc(), "voxel_size").limit(1)

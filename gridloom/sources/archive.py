"""The archive of a compressed cloud: Parquet tables that mirror the groups metadata, params, dictionary, data, statistics.

The layout says the same as an HDF5 archive of this kind; HDF5 itself needs a library that isn't here.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import metrics, packing
from gridloom.operators import blocks, voxel
from gridloom.plans.compress import Compression

METHOD, FRAME = "voxel_dictionary", "map"
VERSION = "1.0"
TABLES = ("metadata", "params", "dictionary", "blocks", "statistics")


class BadArchive(ValueError):
    """An archive without its tables, or tables that contradict each other."""


def write(run: Compression, path: str) -> None:
    """Tables of one row for the scalars; one row a pattern; one row an occupied block, ordered within files by id."""
    path = path.rstrip("/")
    spark, g, s, z = run.spark, run.grid, run.settings, run.sizes
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
    put(run.patterns.select("code", "pattern"), "dictionary")
    put(run.encoded.repartitionByRange("block_id").sortWithinPartitions("block_id"), "blocks")
    axes = lambda name, values, kind: {f"{name}_{a}": kind(v) for a, v in zip("xyz", values)}
    params = {"voxel_size": float(voxel._F32(s.voxel_size)), "dictionary_size": z.n_patterns, "pattern_bits": s.pattern_bits, "block_size": s.block_size, "block_index_bit_width": z.bit_width, "n_blocks": run.n_blocks, "empty_code": -1 if run.dictionary.empty_code is None else run.dictionary.empty_code}
    put(metrics.as_row(spark, params | axes("origin", g.low, float) | axes("dim", g.dims, int) | axes("blocks", g.blocks(s.block_size), int)), "params")
    extent = [float(voxel._F32(d) * voxel._F32(s.voxel_size)) for d in g.dims]
    put(metrics.as_row(spark, {"original_points": z.n_points, "compressed_voxels": run.n_blocks * s.pattern_bits, "compression_ratio": z.compression_ratio} | axes("min", g.low, float) | axes("max", [a + b for a, b in zip(g.low, extent)], float)), "statistics")
    # Last, so that an archive with metadata is whole.
    put(metrics.as_row(spark, {"version": VERSION, "creation_time": now, "frame_id": FRAME, "compression_method": METHOD}), "metadata")


def is_archive(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/metadata/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    if not is_archive(spark, path):
        raise BadArchive(f"no archive at {path}")
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in TABLES}


def decode(spark: SparkSession, path: str) -> DataFrame:
    """(voxel_id) of an archive: patterns unpacked, and put back where their blocks are."""
    tables = read(spark, path)
    p = tables["params"].first()
    bits = blocks.unpacked(tables["dictionary"], "code")
    return blocks.voxels_of(tables["blocks"].join(bits, "code").select("block_id", "bit"), _Shape(p), p.block_size)


class _Shape:
    """Dimensions as an archive has them, in voxels and in blocks."""

    def __init__(self, params):
        self.dims = tuple(params[f"dim_{a}"] for a in "xyz")
        self._blocks = tuple(params[f"blocks_{a}"] for a in "xyz")

    def blocks(self, size: int):
        return self._blocks


def packed(run: Compression) -> DataFrame:
    """(chunk, data): the bit-packed index buffer, as a byte-exact reader wants it."""
    return packing.pack_bits(run.dense, run.sizes.bit_width)


def write_raw(run: Compression, path: str, full: bool = False) -> None:
    """The raw grid: a row an occupied voxel (value 255); full: a row of 0 or 255 for every voxel."""
    rows = voxel.located(run.voxels.select("voxel_id"), run.grid).withColumn("value", F.lit(255).cast("short"))
    if full:
        every = run.spark.range(run.grid.voxels).withColumnRenamed("id", "voxel_id")
        rows = voxel.located(every.join(rows.select("voxel_id", "value"), "voxel_id", "left").select("voxel_id", F.coalesce("value", F.lit(0).cast("short")).alias("value")), run.grid)
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/voxels")
    g = run.grid
    metrics.as_row(run.spark, {f"dim_{a}": d for a, d in zip("xyz", g.dims)} | {f"origin_{a}": float(v) for a, v in zip("xyz", g.low)} | {"voxel_size": float(voxel._F32(g.voxel_size))}).write.mode("overwrite").parquet(f"{path.rstrip('/')}/grid")

"""The engine's one dataflow: cloud -> voxels -> blocks -> dictionary -> codes, as lazy DataFrames."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import metrics, packing
from gridloom.operators import blocks, dictionary, sweep, voxel
from gridloom.settings import CompressionSettings, block_sizes

#: Points of a marker batch, and a marker's width as a share of a voxel's.
MARKER_POINTS, MARKER_SCALE, MARKER_RGBA = 10_000, 0.9, (0.0, 1.0, 0.0, 0.5)


class EmptyCloud(ValueError):
    """There is no finite point to compress."""


@dataclass
class Compression:
    """A compression run over a cloud (x, y, z). Relations are made as they are asked for.

    The one eager step is the bounding box; the dictionary adds two counts when it is needed.
    """

    points: DataFrame
    settings: CompressionSettings

    @cached_property
    def grid(self) -> voxel.Grid:
        found = voxel.grid_of(self.points, self.settings)
        if found is None:
            raise EmptyCloud("the point cloud is empty")
        return found

    @property
    def spark(self):
        return self.points.sparkSession

    @cached_property
    def counts(self) -> DataFrame:
        return voxel.voxel_counts(self.points, self.grid)

    @cached_property
    def voxels(self) -> DataFrame:
        """(voxel_id, n) with enough points; kept, as blocks, dictionary and statistics all read it."""
        return voxel.committed(self.counts, self.settings).persist()

    @cached_property
    def bits(self) -> DataFrame:
        return blocks.block_bits(self.voxels, self.grid, self.settings.block_size)

    @cached_property
    def blocks(self) -> DataFrame:
        """(block_id, bits); kept, as the dictionary and the codes read it."""
        return blocks.patterns(self.bits).persist()

    @property
    def n_blocks(self) -> int:
        return self.grid.block_count(self.settings.block_size)

    @cached_property
    def dictionary(self) -> dictionary.Dictionary:
        return dictionary.build(self.blocks, self.n_blocks)

    @cached_property
    def encoded(self) -> DataFrame:
        return dictionary.encode(self.blocks, self.dictionary)

    @cached_property
    def dense(self) -> DataFrame:
        return dictionary.dense(self.encoded, self.dictionary)

    @cached_property
    def patterns(self) -> DataFrame:
        """(code, pattern, first_block)."""
        codes = self.dictionary.codes
        return blocks.pattern_bytes(codes, "code", self.settings.block_size).join(codes.select("code", "first_block"), "code")

    @cached_property
    def sizes(self) -> metrics.Sizes:
        return metrics.Sizes.of(self.grid.n_points, self.n_blocks, self.dictionary.n_patterns, self.settings.pattern_bytes)

    @cached_property
    def committed(self) -> int:
        return self.voxels.count()

    def summary(self) -> DataFrame:
        """One row: grid, blocks, dictionary and sizes."""
        gx, gy, gz = self.grid.dims
        bx, by, bz = self.grid.blocks(self.settings.block_size)
        s = self.sizes
        return metrics.as_row(self.spark, {"n_points": s.n_points, "gx": gx, "gy": gy, "gz": gz, "occupied_voxels": self.committed, "blocks_x": bx, "blocks_y": by, "blocks_z": bz, "n_blocks": s.n_blocks, "n_patterns": s.n_patterns, "index_bits": s.index_bits, "index_bytes": s.index_bytes, "dictionary_bytes": s.dictionary_bytes, "compressed_bytes": s.compressed_bytes, "original_bytes": s.original_bytes}).withColumn("compression_ratio", voxel.f32(s.compression_ratio))

    def metrics(self) -> metrics.SummaryMetrics:
        return metrics.summary_of(self.grid, self.settings, self.sizes)

    def decoded(self) -> DataFrame:
        """(voxel_id) of the codes: the committed voxels again."""
        return blocks.voxels_of(dictionary.decode(self.encoded, self.dictionary), self.grid, self.settings.block_size)

    def markers(self, batch: int = MARKER_POINTS) -> DataFrame:
        """(batch, n, voxel_ids, points): voxel centres in voxel order, so many a batch.

        A batch is a row of bounded size; its number comes from a rank that no single window holds.
        """
        at = dictionary.ranked(voxel.centres(self.voxels, self.grid), "voxel_id", "rank", self.committed)
        each = F.array_sort(F.collect_list(F.struct("voxel_id", "x", "y", "z")))
        return at.groupBy(F.expr(f"rank div {batch}").alias("batch")).agg(each.alias("points")).select("batch", F.size("points").alias("n"), "points")

    def message(self) -> DataFrame:
        """One row with all that a receiver needs but the buffers' bytes, which follow in chunks."""
        gx, gy, gz = self.grid.dims
        bx, by, bz = self.grid.blocks(self.settings.block_size)
        side, s = float(voxel._F32(self.settings.voxel_size)), self.sizes
        extent = [float(voxel._F32(d) * voxel._F32(self.settings.voxel_size)) for d in (gx, gy, gz)]
        return metrics.as_row(self.spark, {"frame_id": "map", "voxel_size": side, "block_size": self.settings.block_size, "min_points_threshold": self.settings.min_points, "dim_x": extent[0], "dim_y": extent[1], "dim_z": extent[2], "origin_x": float(self.grid.low[0]), "origin_y": float(self.grid.low[1]), "origin_z": float(self.grid.low[2]), "total_blocks": s.n_blocks, "blocks_x": bx, "blocks_y": by, "blocks_z": bz, "index_bit_size": s.index_bits, "num_patterns": s.n_patterns, "pattern_size_bytes": self.settings.pattern_bytes, "checksum": 0, "original_point_count": s.n_points, "compressed_data_size": s.compressed_bytes}).withColumn("compression_ratio", voxel.f32(s.compression_ratio))

    def index_chunks(self) -> DataFrame:
        return packing.pack_fixed(self.dense, self.sizes.index_bits)

    def bit_chunks(self) -> DataFrame:
        return packing.pack_bits(self.dense, self.sizes.bit_width)

    def dictionary_chunks(self) -> DataFrame:
        return packing.flattened(self.patterns)

    def sweep_blocks(self, least: int = 4, most: int = 32, step: int = 1) -> DataFrame:
        return sweep.block_size_sweep(self.voxels, self.grid, block_sizes(least, most, step))

    def sweep_voxels(self, *span: float) -> DataFrame:
        return sweep.voxel_size_sweep(self.points, self.grid, sweep.voxel_sizes(*span), self.settings.threshold)

    def report(self, name: str = "") -> str:
        began = time.time()
        candidates = self.counts.count()
        committed, sizes = self.committed, self.sizes
        return metrics.detailed_report(name, self.grid, self.settings, sizes, candidates, committed, {"total": (time.time() - began) * 1000})

    def release(self) -> None:
        """Let go of what is kept; asked again, relations are made anew."""
        for name in ("voxels", "blocks", "dictionary"):
            kept = self.__dict__.get(name)
            kept = kept.kept if name == "dictionary" and kept is not None else kept
            if kept is not None:
                kept.unpersist()
        for name in [k for k in self.__dict__ if k not in ("points", "settings")]:
            del self.__dict__[name]

"""Queries of the occupancy engine and the DuckDB SQL each is compared with."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from gridloom.functions import metrics, packing
from gridloom.operators import blocks, sweep, voxel
from gridloom.plans import filequeries, oracles
from gridloom.plans.clouds import CLOUDS, Source
from gridloom.plans.compress import Compression


def _hexed(df, column):
    return df.withColumn(column, F.hex(column))


def _grid_dims(c: Compression):
    g, s = c.grid, c.settings
    bx, by, bz = g.blocks(s.block_size)
    return metrics.as_row(c.spark, {"gx": g.dims[0], "gy": g.dims[1], "gz": g.dims[2], "total_voxels": g.voxels, "blocks_x": bx, "blocks_y": by, "blocks_z": bz, "n_blocks": c.n_blocks, "pattern_bits": s.pattern_bits, "pattern_bytes": s.pattern_bytes})


def _bbox_margin(c: Compression):
    g = voxel.grid_of(c.points, c.settings.with_(margin=0.2))
    row = metrics.as_row(c.spark, dict(zip(("gx", "gy", "gz"), g.dims)) | {f"margin_{a}": m for a, m in zip("xyz", g.margins(0.2))})
    return row.withColumns({f"{n}_{a}": voxel.f32(v) for n, side in (("low", g.low), ("high", g.high)) for a, v in zip("xyz", side)})


def _linear_id(c: Compression):
    at = voxel.located(c.voxels.select("voxel_id"), c.grid)
    return at.withColumn("again", voxel.linear(F.col("vx"), F.col("vy"), F.col("vz"), *c.grid.dims[:2]))


def _dictionary(c: Compression):
    codes = c.dictionary.codes.select("code", "first_block", "uses")
    return _hexed(blocks.pattern_bytes(c.dictionary.codes, "code", c.settings.block_size), "pattern").join(codes, "code")


def _lookup(c: Compression):
    asked = c.spark.range(-2, 40).select(F.col("id").cast("int").alias("vx"), F.expr("cast(id div 2 as int)").alias("vy"), (F.col("id") % 5).cast("int").alias("vz"))
    return voxel.lookup(asked, c.voxels, c.grid).select("vx", "vy", "vz", "occupied")


def _index_width(c: Compression):
    top = c.dictionary.max_index
    row = metrics.as_row(c.spark, {"n_patterns": c.dictionary.n_patterns, "max_index": top})
    return row.withColumn("index_bits", packing_width(F.col("max_index"))).withColumn("bit_width", packing.bit_width(F.col("max_index")).cast("long"))


def packing_width(max_index):
    from gridloom.operators.dictionary import index_width_column

    return index_width_column(max_index)


def _f32_row(c: Compression, name: str, value: float):
    return c.spark.range(1).select(voxel.f32(value).alias(name))


def _markers(c: Compression):
    return c.markers().select("batch", F.col("n").cast("long").alias("n"), F.explode("points").alias("p")).select("batch", "n", "p.*")


QUERIES = {
    "bbox": lambda c: voxel.bounding_box(c.points),
    "bbox_margin": _bbox_margin,
    "grid_dims": _grid_dims,
    "voxel_counts": lambda c: c.counts,
    "voxel_threshold": lambda c: voxel.committed(c.counts, c.settings.with_(min_points=2)),
    "candidate_committed": lambda c: voxel.statistics(c.counts, c.grid, c.settings.with_(min_points=2)),
    "voxel_linear_id": _linear_id,
    "voxel_centers": lambda c: voxel.centres(c.voxels, c.grid),
    "clamped_index": lambda c: voxel.clamped(c.points, c.grid).groupBy("voxel_id").agg(F.count("*").alias("n")),
    "block_bits": lambda c: c.bits,
    "block_occupied": lambda c: blocks.occupied_counts(c.bits),
    "block_pattern": lambda c: c.blocks.withColumn("bits", F.array_join(F.transform("bits", lambda b: b.cast("string")), ",")),
    "pattern_dictionary": _dictionary,
    "pattern_bits": lambda c: blocks.unpacked(c.patterns, "code"),
    "block_encode": lambda c: c.encoded,
    "dense_block_encode": lambda c: c.dense,
    "index_width": _index_width,
    "packed_indices": lambda c: _hexed(c.index_chunks(), "data"),
    "unpacked_indices": lambda c: packing.unpack_fixed(c.index_chunks(), c.sizes.index_bits),
    "bitpacked_indices": lambda c: _hexed(c.bit_chunks(), "data"),
    "bitunpacked_indices": lambda c: packing.unpack_bits(c.bit_chunks(), c.sizes.bit_width, c.n_blocks),
    "decode_voxels": lambda c: c.decoded(),
    "compression_summary": lambda c: c.summary(),
    "builder_ratio": lambda c: _f32_row(c, "ratio", metrics.builder_ratio(c.n_blocks, c.dictionary.n_patterns, c.settings.pattern_bytes)),
    "summary_metrics": lambda c: metrics.as_row(c.spark, c.metrics()),
    "memory_report": lambda c: metrics.as_row(c.spark, metrics.memory_report(c.grid, c.sizes, c.committed)),
    "memory_estimate": lambda c: metrics.as_row(c.spark, {"bytes": metrics.memory_estimate(c.grid.n_points, c.settings.with_(min_points=2))}),
    "block_size_sweep": lambda c: c.sweep_blocks(*oracles.SWEEP_BLOCKS),
    "best_block_size": lambda c: sweep.best_block_size(c.sweep_blocks(*oracles.SWEEP_BLOCKS)),
    "voxel_size_sweep": lambda c: c.sweep_voxels(),
    "best_voxel_size": lambda c: sweep.best_voxel_size(c.sweep_voxels()),
    "marker_batches": _markers,
    "dictionary_message": lambda c: c.message(),
    "flat_dictionary": lambda c: _hexed(c.dictionary_chunks(), "data"),
    "raw_grid": lambda c: voxel.located(c.voxels.select("voxel_id"), c.grid).withColumn("value", F.lit(255).cast("short")),
    "occupancy_mask": lambda c: _hexed(packing.occupancy_rows(c.voxels, *c.grid.dims), "mask"),
    "point_lookup": _lookup,
    "encoding_saving": lambda c: metrics.as_row(c.spark, {"n": c.n_blocks, "top": c.dictionary.max_index}).select(packing.encoding_saving(F.col("n"), F.col("top")).alias("saved_bytes")),
    "bitgrid_words": lambda c: packing.words(c.voxels),
    "bitgrid_popcount": lambda c: packing.popcount(packing.words(c.voxels)),
    "finite_filter": lambda c: voxel.finite(c.points).groupBy("x", "y", "z").agg(F.count("*").alias("n")),
    "sweep_json": lambda c: c.spark.range(1).select(F.lit(metrics.sweep_json(c.settings.block_size, c.metrics())).alias("summary")),
}

#: The cloud whose queries also go through files.
FILES = "embeddings"


def _run(source: Source, query, spark, sf_dir):
    return query(Compression(source.read(spark, sf_dir), source.settings))


def _names():
    return [(cloud, name) for cloud in CLOUDS for name in QUERIES]


def queries() -> dict:
    """Name -> callable(spark, sf_dir)."""
    found = {f"{name}_{cloud}": partial(_run, CLOUDS[cloud], QUERIES[name]) for cloud, name in _names()}
    return found | {f"{name}_{FILES}": partial(filequeries.run, CLOUDS[FILES], query) for name, query in filequeries.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL over the same tables."""
    by = {cloud: oracles.oracles(source) for cloud, source in CLOUDS.items()}
    found = {f"{name}_{cloud}": by[cloud][name] for cloud, name in _names()}
    return found | {f"{name}_{FILES}": sql for name, sql in filequeries.oracle_sql(CLOUDS[FILES]).items()}

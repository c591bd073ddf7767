"""Sizes, ratios and reports of a compressed cloud, from a few scalars. A ratio is compressed / original."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np

from gridloom.functions.packing import bit_width_of
from gridloom.operators.dictionary import index_width
from gridloom.operators.voxel import Grid
from gridloom.settings import CompressionSettings

_F32 = np.float32
#: Bytes of the fixed fields beside indices and dictionary: three ints, three floats, a float, two ints.
METADATA_BYTES = 36
POINT_BYTES = 12


def ratio32(part: int, whole: int) -> float:
    """part / whole in 32-bit floats; 1 if there is no whole."""
    return float(_F32(part) / _F32(whole)) if whole else 1.0


@dataclass(frozen=True)
class Sizes:
    """What a compression run comes to."""

    n_points: int
    n_blocks: int
    n_patterns: int
    index_bits: int
    bit_width: int
    index_bytes: int
    dictionary_bytes: int
    compressed_bytes: int
    original_bytes: int
    compression_ratio: float

    @classmethod
    def of(cls, n_points: int, n_blocks: int, n_patterns: int, pattern_bytes: int) -> Sizes:
        top = max(0, n_patterns - 1)
        bits = index_width(top)
        index, codes = n_blocks * (bits // 8), n_patterns * pattern_bytes
        return cls(n_points, n_blocks, n_patterns, bits, bit_width_of(top), index, codes, index + codes, POINT_BYTES * n_points, ratio32(index + codes, POINT_BYTES * n_points))


def builder_ratio(n_blocks: int, n_patterns: int, pattern_bytes: int) -> float:
    """Dictionary bits and 16 bits an index, over the blocks' own bits; 1 if there is nothing."""
    if not n_blocks or not n_patterns or not pattern_bytes:
        return 1.0
    return ratio32(8 * n_patterns * pattern_bytes + 16 * n_blocks, 8 * n_blocks * pattern_bytes)


@dataclass(frozen=True)
class SummaryMetrics:
    """Against the grid padded to whole blocks, at a byte and at a bit a voxel."""

    env_x: float
    env_y: float
    env_z: float
    total_voxels: int
    bytes_one_byte: int
    bytes_one_bit: int
    dictionary_entries: int
    dictionary_bytes: int
    index_entries: int
    index_bytes: int
    compressed_bytes: int
    ratio_vs_one_byte: float
    ratio_vs_one_bit: float


def summary_metrics(dims, blocks, block_size: int, voxel_size: float, dictionary_entries: int, dictionary_bytes: int, index_entries: int, index_bits: int, compressed_bytes: int = 0) -> SummaryMetrics:
    cover = [max(b * block_size, d) for b, d in zip(blocks, dims)]
    side = float(_F32(voxel_size)) if voxel_size > 0 else 0.0
    total = cover[0] * cover[1] * cover[2]
    index_bytes = index_entries * ((index_bits + 7) // 8)
    compressed = compressed_bytes or dictionary_bytes + index_bytes
    bits = (total + 7) // 8
    return SummaryMetrics(*[c * side for c in cover], total, total, bits, dictionary_entries, dictionary_bytes, index_entries, index_bytes, compressed, compressed / total if total else 0.0, compressed / bits if bits else 0.0)


def summary_of(grid: Grid, settings: CompressionSettings, sizes: Sizes) -> SummaryMetrics:
    return summary_metrics(grid.dims, grid.blocks(settings.block_size), settings.block_size, settings.voxel_size, sizes.n_patterns, sizes.dictionary_bytes, sizes.n_blocks, sizes.index_bits, sizes.compressed_bytes)


def memory_report(grid: Grid, sizes: Sizes, committed: int) -> dict:
    """Against the raw grid at a byte a voxel, fixed fields included."""
    raw, total = grid.voxels, sizes.compressed_bytes + METADATA_BYTES
    return {
        "raw_grid_bytes": raw,
        "occupied_voxels": committed,
        "occupancy_percent": committed / raw * 100.0 if raw else 0.0,
        "block_indices_bytes": sizes.index_bytes,
        "dictionary_bytes": sizes.dictionary_bytes,
        "metadata_bytes": METADATA_BYTES,
        "compressed_total_bytes": total,
        "memory_reduction_percent": (1.0 - total / raw) * 100.0 if raw else 0.0,
    }


def memory_estimate(n_points: int, settings: CompressionSettings) -> int:
    """Bytes that a run is thought to need: points, a byte for each voxel at the threshold, a block."""
    return POINT_BYTES * n_points + -(-n_points // settings.threshold) + settings.pattern_bits


def compression_text(sizes: Sizes, settings: CompressionSettings) -> str:
    return "\n".join(
        [
            "Compression summary:",
            f"  Compression ratio: {sizes.compression_ratio:.6f}",
            f"  Block count      : {sizes.n_blocks}",
            f"  Dictionary size  : {sizes.n_patterns} patterns ({settings.pattern_bytes} bytes each)",
            f"  Index bit width  : {sizes.index_bits} bits",
        ]
    )


def sweep_text(best: int | None, ratio: float | None, tested: dict[int, float], verbose: bool = False) -> str:
    if best is None or best < 0:
        return "Block size optimization failed."
    said = [f"Optimal block size: {best}", f"Best compression ratio: {ratio:.6f}"]
    if verbose and tested:
        said += ["Tested block sizes:", *(f"  block_size={s} ratio={r:.6f}" for s, r in sorted(tested.items()))]
    return "\n".join(said) + "\n"


def _mb(n: int) -> str:
    return f"{n / 1e6:.6f}"


def sweep_json(best: int, m: SummaryMetrics) -> str:
    """The sweep's summary as JSON: sizes in decimal megabytes, numbers to six places."""
    values = {
        "optimal_block_size": str(best),
        "dictionary_entries": str(m.dictionary_entries),
        "dictionary_size_mb": _mb(m.dictionary_bytes),
        "index_entries": str(m.index_entries),
        "index_size_mb": _mb(m.index_bytes),
        "compressed_size_mb": _mb(m.compressed_bytes),
        "map_size_one_byte_mb": _mb(m.bytes_one_byte),
        "map_size_one_bit_mb": _mb(m.bytes_one_bit),
        "compression_ratio_vs_one_byte": f"{m.ratio_vs_one_byte:.6f}",
        "compression_ratio_vs_one_bit": f"{m.ratio_vs_one_bit:.6f}",
    }
    return "{\n" + ",\n".join(f"  {json.dumps(k)}: {v}" for k, v in values.items()) + "\n}"


def summary_lines(m: SummaryMetrics) -> list[str]:
    """The summary for a log, a line each."""
    mb = lambda n: f"{n / 1e6:.2f} MB"
    return [
        f"Environment scale: {m.env_x:.2f}m * {m.env_y:.2f}m * {m.env_z:.2f}m",
        f"Map size at 1 byte/voxel (pre-compression): {mb(m.bytes_one_byte)}",
        f"Map size at 1 bit/voxel (pre-compression): {mb(m.bytes_one_bit)}",
        f"Index array: {m.index_entries} entries, {mb(m.index_bytes)}",
        f"Codebook: {m.dictionary_entries} entries, {mb(m.dictionary_bytes)}",
        f"Compressed map total: {mb(m.compressed_bytes)}",
        f"Compression ratio vs 1 byte/voxel: {m.ratio_vs_one_byte:.6f}",
        f"Compression ratio vs 1 bit/voxel: {m.ratio_vs_one_bit:.6f}",
    ]


def detailed_report(name: str, grid: Grid, settings: CompressionSettings, sizes: Sizes, candidates: int, committed: int, timings: dict[str, float] | None = None) -> str:
    """Sections on input, voxels, compression and memory; timings (in ms) where given."""
    ms = lambda k: f"{(timings or {}).get(k, 0.0):.3f} ms"
    kb = lambda n: f"{n} bytes ({n / 1024:.2f} KB)"
    gx, gy, gz = grid.dims
    bx, by, bz = grid.blocks(settings.block_size)
    m = memory_report(grid, sizes, committed)
    section = {
        "File IO": {"Input file": name, "Points": sizes.n_points, "Load time": ms("load")},
        "Voxelization": {"Grid dims": f"{gx} x {gy} x {gz} ({grid.voxels} voxels)", "Voxel counting": f"{ms('voxelize')} ({candidates} candidate voxels)", "Grid transfer": f"{committed} voxels set", "Block division": f"{bx} x {by} x {bz} = {sizes.n_blocks} blocks"},
        "Compression": {"Blocks processed": sizes.n_blocks, "Codebook patterns": sizes.n_patterns, "Index entries": sizes.n_blocks, "Dictionary build": ms("dictionary"), "Index bit width": f"{sizes.index_bits}-bit", "Total time": ms("total"), "Compression ratio": f"{sizes.compression_ratio:.6f}"},
        "Memory": {"Voxel size": f"{settings.voxel_size:.3f} m", "Raw grid": kb(m["raw_grid_bytes"]), "Occupied voxels": f"{committed} ({m['occupancy_percent']:.2f}%)", "Block indices": kb(m["block_indices_bytes"]), "Pattern dict": kb(m["dictionary_bytes"]), "Metadata": f"{METADATA_BYTES} bytes", "Compressed total": kb(m["compressed_total_bytes"]), "Memory reduction": f"{m['memory_reduction_percent']:.2f}%"},
    }
    return "\n".join(line for title, rows in section.items() for line in (f"[REPORT][{title}]", *(f"  {k:<18}: {v}" for k, v in rows.items() if v != "")))


def as_row(spark, values):
    """A one-row DataFrame of scalars (or of a dataclass): ints as BIGINT, floats as DOUBLE."""
    from pyspark.sql import functions as F

    values = values if isinstance(values, dict) else asdict(values)
    kind = lambda v: F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)
    return spark.range(1).select(*[kind(v).alias(k) for k, v in values.items()])

"""DuckDB SQL that says what each query of the engine must return. Grids are derived within the SQL."""

from __future__ import annotations

from gridloom.functions.metrics import METADATA_BYTES
from gridloom.functions.packing import CHUNK
from gridloom.operators.sweep import voxel_sizes
from gridloom.plans.clouds import Source
from gridloom.plans.compress import MARKER_POINTS


def f(value: float) -> str:
    return f"CAST({value!r} AS FLOAT)"


def _axes(template: str) -> str:
    return ", ".join(template.replace("@", a) for a in "xyz")


def base(c: Source, k: int = 1, margin: float = 0.0) -> str:
    """CTEs pts, box, g (grid), cnt (voxel_id, n), vox, bit, occ, allb, dict, enc, tot of a cloud."""
    s, v = c.settings.block_size, f(c.settings.voxel_size)
    x, y, z = c.duck
    pad = f"(CASE WHEN r@ - p@ < {f(1.1920928955078125e-07)} THEN {f(0.0)} ELSE r@ - p@ END) * {f(margin)}"
    low, high = (f"p@ - {pad}", f"r@ + {pad}") if margin else ("p@", "r@")
    bytes_ = (s**3 + 7) // 8
    return f"""
WITH raw AS (SELECT CAST({x} AS FLOAT) AS x, CAST({y} AS FLOAT) AS y, CAST({z} AS FLOAT) AS z FROM {c.table}),
pts AS (SELECT * FROM raw WHERE isfinite(x) AND isfinite(y) AND isfinite(z)),
box AS (SELECT {_axes("min(@) AS p@, max(@) AS r@")}, count(*) AS np FROM pts),
wide AS (SELECT {_axes(f"{low} AS l@, {high} AS h@")}, {_axes("p@, r@")}, np FROM box),
g AS (SELECT *, {_axes(f"CAST(ceil((h@ - l@) / {v}) AS INTEGER) + 1 AS g@")}, {f(1.0)} / {v} AS inv, {v} AS side FROM wide),
cell AS (SELECT {_axes("CAST(trunc((@ - l@) * inv) AS INTEGER) AS v@")} FROM pts, g),
cnt AS (SELECT CAST(vz AS BIGINT) * gx * gy + CAST(vy AS BIGINT) * gx + vx AS voxel_id, count(*) AS n FROM cell, g
  WHERE vx >= 0 AND vx < gx AND vy >= 0 AND vy < gy AND vz >= 0 AND vz < gz GROUP BY 1),
vox AS (SELECT voxel_id, n, CAST(voxel_id % gx AS INTEGER) AS vx, CAST(voxel_id // gx % gy AS INTEGER) AS vy,
  CAST(voxel_id // (CAST(gx AS BIGINT) * gy) AS INTEGER) AS vz FROM cnt, g WHERE n >= {max(1, k)}),
nb AS (SELECT {_axes(f"(g@ + {s} - 1) // {s} AS n@")} FROM g),
bit AS (SELECT CAST(vz // {s} AS BIGINT) * nx * ny + (vy // {s}) * nx + vx // {s} AS block_id,
  CAST((vz % {s}) * {s * s} + (vy % {s}) * {s} + vx % {s} AS INTEGER) AS bit FROM vox, nb),
occ AS (SELECT block_id, list(bit ORDER BY bit) AS bits FROM bit GROUP BY 1),
ids AS (SELECT unnest(range(0, (SELECT CAST(nx AS BIGINT) * ny * nz FROM nb))) AS block_id),
allb AS (SELECT block_id, coalesce(bits, CAST([] AS INTEGER[])) AS bits FROM ids LEFT JOIN occ USING (block_id)),
dict AS (SELECT bits, min(block_id) AS first_block, count(*) AS uses, row_number() OVER (ORDER BY min(block_id)) - 1 AS code FROM allb GROUP BY bits),
enc AS (SELECT block_id, code FROM allb JOIN dict USING (bits)),
hexed AS (SELECT code, array_to_string(list_transform(range(0, {bytes_}), lambda b: printf('%02X', coalesce(CAST(list_sum(list_transform(list_filter(bits, lambda t: t // 8 = b), lambda t: 1 << (t % 8))) AS BIGINT), 0))), '') AS pattern FROM dict),
tot AS (SELECT np AS n_points, gx, gy, gz, nx, ny, nz, CAST(nx AS BIGINT) * ny * nz AS n_blocks, (SELECT count(*) FROM vox) AS occupied,
  (SELECT count(*) FROM dict) AS n_patterns, CAST((SELECT count(*) FROM dict) AS BIGINT) * {bytes_} AS dictionary_bytes,
  CASE WHEN (SELECT count(*) FROM dict) - 1 <= 255 THEN 8 WHEN (SELECT count(*) FROM dict) - 1 <= 65535 THEN 16 ELSE 32 END AS index_bits,
  CAST(greatest(1, length(bin((SELECT count(*) FROM dict) - 1))) AS BIGINT) AS bit_width FROM g, nb),
sz AS (SELECT *, n_blocks * index_bits // 8 AS index_bytes, n_blocks * index_bits // 8 + dictionary_bytes AS compressed_bytes, 12 * n_points AS original_bytes,
  CAST(n_blocks * index_bits // 8 + dictionary_bytes AS FLOAT) / CAST(12 * n_points AS FLOAT) AS compression_ratio FROM tot)
"""


def oracles(c: Source) -> dict[str, str]:
    """SQL by query name, for one cloud."""
    s = c.settings.block_size
    b, two = base(c), base(c, k=2)
    bytes_ = (s**3 + 7) // 8
    low_first = "list_aggregate(list_transform(range(0, index_bits // 8), lambda i: printf('%02X', CAST(code >> (8 * i) & 255 AS BIGINT))), 'string_agg', '')"
    sweep = _block_sweep(c)
    sizes = _voxel_sweep(c)
    return {
        "bbox": b + "SELECT " + _axes("p@ AS min_@, r@ AS max_@") + ", np AS n_points FROM box",
        "bbox_margin": base(c, margin=0.2) + "SELECT " + _axes(f"l@ AS low_@, h@ AS high_@, (CAST(r@ AS DOUBLE) - CAST(p@ AS DOUBLE)) * CAST({f(0.2)} AS DOUBLE) AS margin_@") + ", gx, gy, gz FROM g",
        "grid_dims": b + f"SELECT gx, gy, gz, CAST(gx AS BIGINT) * gy * gz AS total_voxels, CAST(nx AS BIGINT) AS blocks_x, CAST(ny AS BIGINT) AS blocks_y, CAST(nz AS BIGINT) AS blocks_z, n_blocks, CAST({s**3} AS BIGINT) AS pattern_bits, CAST({bytes_} AS BIGINT) AS pattern_bytes FROM tot",
        "voxel_counts": b + "SELECT voxel_id, n FROM cnt",
        "voxel_threshold": two + "SELECT voxel_id, n FROM vox",
        "candidate_committed": two + "SELECT gx, gy, gz, CAST(gx AS BIGINT) * gy * gz AS total_voxels, (SELECT count(*) FROM cnt) AS candidate_voxels, (SELECT count(*) FROM vox) AS committed_voxels, CAST((SELECT count(*) FROM vox) AS FLOAT) / CAST(CAST(gx AS BIGINT) * gy * gz AS FLOAT) AS occupancy_ratio FROM g",
        "voxel_linear_id": b + "SELECT voxel_id, vx, vy, vz, CAST(vz AS BIGINT) * gx * gy + CAST(vy AS BIGINT) * gx + vx AS again FROM vox, g",
        "voxel_centers": b + "SELECT voxel_id, " + _axes(f"l@ + ((CAST(v@ AS FLOAT) + {f(0.5)}) * side) AS @") + " FROM vox, g",
        "clamped_index": b + "SELECT voxel_id, count(*) AS n FROM (SELECT " + _axes("greatest(0, least(CAST(trunc((@ - l@) / side) AS INTEGER), g@ - 1)) AS c@") + ", CAST(cz AS BIGINT) * gx * gy + CAST(cy AS BIGINT) * gx + cx AS voxel_id FROM pts, g) GROUP BY 1",
        "block_bits": b + "SELECT block_id, bit FROM bit",
        "block_occupied": b + "SELECT block_id, count(*) AS occupied FROM bit GROUP BY 1",
        "block_pattern": b + "SELECT block_id, array_to_string(bits, ',') AS bits FROM occ",
        "pattern_dictionary": b + "SELECT code, pattern, first_block, uses FROM dict JOIN hexed USING (code)",
        "pattern_bits": b + "SELECT code, unnest(bits) AS bit FROM dict",
        "block_encode": b + "SELECT block_id, code FROM enc JOIN occ USING (block_id)",
        "dense_block_encode": b + "SELECT block_id, code FROM enc",
        "index_width": b + "SELECT n_patterns, n_patterns - 1 AS max_index, index_bits, bit_width FROM tot",
        "packed_indices": b + f"SELECT block_id // {CHUNK} AS chunk, string_agg({low_first}, '' ORDER BY block_id) AS data FROM enc, tot GROUP BY 1",
        "unpacked_indices": b + "SELECT block_id, code FROM enc",
        "bitpacked_indices": b + f""", ones AS (SELECT block_id // {CHUNK} AS chunk, (block_id % {CHUNK}) * bit_width + k AS pos, code >> k & 1 AS one FROM enc, tot, (SELECT unnest(range(0, 32)) AS k) WHERE k < bit_width),
bytes AS (SELECT chunk, pos // 8 AS i, CAST(sum(one << (pos % 8)) AS BIGINT) AS byte FROM ones GROUP BY 1, 2)
SELECT chunk, string_agg(printf('%02X', byte), '' ORDER BY i) AS data FROM bytes GROUP BY 1""",
        "bitunpacked_indices": b + "SELECT block_id, code FROM enc",
        "decode_voxels": b + "SELECT voxel_id FROM vox",
        "compression_summary": b + "SELECT n_points, gx, gy, gz, occupied AS occupied_voxels, nx AS blocks_x, ny AS blocks_y, nz AS blocks_z, n_blocks, n_patterns, index_bits, index_bytes, dictionary_bytes, compressed_bytes, original_bytes, compression_ratio FROM sz",
        "builder_ratio": b + f"SELECT CAST(8 * dictionary_bytes + 16 * n_blocks AS FLOAT) / CAST(8 * n_blocks * {bytes_} AS FLOAT) AS ratio FROM sz",
        "summary_metrics": b + f""", cover AS (SELECT *, greatest(CAST(nx AS BIGINT) * {s}, gx) AS wx, greatest(CAST(ny AS BIGINT) * {s}, gy) AS wy, greatest(CAST(nz AS BIGINT) * {s}, gz) AS wz FROM sz)
SELECT wx * CAST({f(c.settings.voxel_size)} AS DOUBLE) AS env_x, wy * CAST({f(c.settings.voxel_size)} AS DOUBLE) AS env_y, wz * CAST({f(c.settings.voxel_size)} AS DOUBLE) AS env_z, wx * wy * wz AS total_voxels, wx * wy * wz AS bytes_one_byte, (wx * wy * wz + 7) // 8 AS bytes_one_bit,
  n_patterns AS dictionary_entries, dictionary_bytes, n_blocks AS index_entries, index_bytes, compressed_bytes, CAST(compressed_bytes AS DOUBLE) / (wx * wy * wz) AS ratio_vs_one_byte, CAST(compressed_bytes AS DOUBLE) / ((wx * wy * wz + 7) // 8) AS ratio_vs_one_bit FROM cover""",
        "memory_report": b + f""", raw_grid AS (SELECT *, CAST(gx AS BIGINT) * gy * gz AS total FROM sz)
SELECT total AS raw_grid_bytes, occupied AS occupied_voxels, CAST(occupied AS DOUBLE) / total * 100.0::DOUBLE AS occupancy_percent, index_bytes AS block_indices_bytes, dictionary_bytes, CAST({METADATA_BYTES} AS BIGINT) AS metadata_bytes, compressed_bytes + {METADATA_BYTES} AS compressed_total_bytes, (1.0::DOUBLE - CAST(compressed_bytes + {METADATA_BYTES} AS DOUBLE) / total) * 100.0::DOUBLE AS memory_reduction_percent FROM raw_grid""",
        "memory_estimate": b + f"SELECT 12 * np + (np + 1) // 2 + {s**3} AS bytes FROM box",
        "block_size_sweep": sweep + "SELECT block_size, n_blocks, n_patterns, index_bits, compressed_bytes, ratio FROM res",
        "best_block_size": sweep + "SELECT block_size, n_blocks, n_patterns, index_bits, compressed_bytes, ratio FROM res ORDER BY ratio, block_size LIMIT 1",
        "voxel_size_sweep": sizes + "SELECT voxel_size, total_voxels, occupied, score FROM res",
        "best_voxel_size": sizes + "SELECT voxel_size, total_voxels, occupied, score FROM res WHERE score > 0 ORDER BY score DESC, voxel_size LIMIT 1",
        "marker_batches": b + f", r AS (SELECT *, row_number() OVER (ORDER BY voxel_id) - 1 AS rank FROM vox) SELECT rank // {MARKER_POINTS} AS batch, count(*) OVER (PARTITION BY rank // {MARKER_POINTS}) AS n, voxel_id, " + _axes(f"l@ + ((CAST(v@ AS FLOAT) + {f(0.5)}) * side) AS @") + " FROM r, g",
        "dictionary_message": b + f"SELECT 'map' AS frame_id, CAST(side AS DOUBLE) AS voxel_size, CAST({s} AS BIGINT) AS block_size, CAST(1 AS BIGINT) AS min_points_threshold, " + ", ".join(f"CAST(g.g{a} * side AS DOUBLE) AS dim_{a}, CAST(l{a} AS DOUBLE) AS origin_{a}" for a in "xyz") + f", n_blocks AS total_blocks, CAST(nx AS BIGINT) AS blocks_x, CAST(ny AS BIGINT) AS blocks_y, CAST(nz AS BIGINT) AS blocks_z, CAST(index_bits AS BIGINT) AS index_bit_size, n_patterns AS num_patterns, CAST({bytes_} AS BIGINT) AS pattern_size_bytes, CAST(0 AS BIGINT) AS checksum, n_points AS original_point_count, compressed_bytes AS compressed_data_size, compression_ratio FROM sz, g",
        "flat_dictionary": b + f"SELECT code // {CHUNK} AS chunk, string_agg(pattern, '' ORDER BY code) AS data FROM hexed GROUP BY 1",
        "raw_grid": b + "SELECT voxel_id, vx, vy, vz, CAST(255 AS SMALLINT) AS value FROM vox",
        "occupancy_mask": b + """, rows AS (SELECT unnest(range(0, (SELECT CAST(gy AS BIGINT) * gz FROM g))) AS row_id),
cells AS (SELECT row_id, x, row_id * gx + x AS voxel_id FROM rows, g, (SELECT unnest(range(0, (SELECT gx FROM g))) AS x))
SELECT row_id, string_agg(CASE WHEN vox.voxel_id IS NULL THEN '00' ELSE '01' END, '' ORDER BY x) AS mask FROM cells LEFT JOIN vox USING (voxel_id) GROUP BY 1""",
        "point_lookup": b + ", asked AS (SELECT unnest(range(-2, 40)) AS i) SELECT CAST(i AS INTEGER) AS vx, CAST(i // 2 AS INTEGER) AS vy, CAST(i % 5 AS INTEGER) AS vz, EXISTS (SELECT 1 FROM vox WHERE vox.vx = i AND vox.vy = i // 2 AND vox.vz = i % 5) AS occupied FROM asked",
        "encoding_saving": b + "SELECT CASE WHEN n_patterns - 1 < 256 THEN n_blocks ELSE 0 END AS saved_bytes FROM tot",
        "bitgrid_words": b + "SELECT voxel_id // 64 AS word_id, CAST(sum(CASE WHEN voxel_id % 64 = 63 THEN -9223372036854775807::HUGEINT - 1 ELSE 1::HUGEINT << CAST(voxel_id % 64 AS INTEGER) END) AS BIGINT) AS word FROM vox GROUP BY 1",
        "bitgrid_popcount": b + "SELECT count(*) AS occupied FROM vox",
        "finite_filter": b + "SELECT x, y, z, count(*) AS n FROM pts GROUP BY 1, 2, 3",
        "sweep_json": b + f""", cover AS (SELECT *, greatest(CAST(nx AS BIGINT) * {s}, gx) * greatest(CAST(ny AS BIGINT) * {s}, gy) * greatest(CAST(nz AS BIGINT) * {s}, gz) AS total FROM sz)
SELECT '{{' || chr(10) || '  "optimal_block_size": {s},' || chr(10) || printf('  "dictionary_entries": %d,', n_patterns) || chr(10) || printf('  "dictionary_size_mb": %.6f,', dictionary_bytes / 1e6) || chr(10) || printf('  "index_entries": %d,', n_blocks) || chr(10) || printf('  "index_size_mb": %.6f,', index_bytes / 1e6) || chr(10) || printf('  "compressed_size_mb": %.6f,', compressed_bytes / 1e6) || chr(10) || printf('  "map_size_one_byte_mb": %.6f,', total / 1e6) || chr(10) || printf('  "map_size_one_bit_mb": %.6f,', ((total + 7) // 8) / 1e6) || chr(10) || printf('  "compression_ratio_vs_one_byte": %.6f,', CAST(compressed_bytes AS DOUBLE) / total) || chr(10) || printf('  "compression_ratio_vs_one_bit": %.6f', CAST(compressed_bytes AS DOUBLE) / ((total + 7) // 8)) || chr(10) || '}}' AS summary FROM cover""",
    }


SWEEP_BLOCKS = (2, 9, 1)


def _block_sweep(c: Source) -> str:
    return block_sweep(c, *SWEEP_BLOCKS)


def block_sweep(c: Source, least: int, most: int, step: int = 1) -> str:
    """CTEs up to res: a row a block size."""
    return base(c) + f""", s AS (SELECT CAST(unnest(range({least}, {most} + 1, {step})) AS INTEGER) AS block_size),
sn AS (SELECT block_size, (gx + block_size - 1) // block_size AS mx, (gy + block_size - 1) // block_size AS my, (gz + block_size - 1) // block_size AS mz FROM s, g),
sb AS (SELECT block_size, CAST(vz // block_size AS BIGINT) * mx * my + (vy // block_size) * mx + vx // block_size AS block_id,
  list((vz % block_size) * block_size * block_size + (vy % block_size) * block_size + vx % block_size ORDER BY vz, vy, vx) AS bits FROM vox, sn GROUP BY 1, 2),
sp AS (SELECT block_size, count(DISTINCT bits) AS patterns, count(*) AS used FROM sb GROUP BY 1),
sc AS (SELECT block_size, CAST(mx AS BIGINT) * my * mz AS n_blocks, patterns + CASE WHEN used < CAST(mx AS BIGINT) * my * mz THEN 1 ELSE 0 END AS n_patterns FROM sn JOIN sp USING (block_size)),
sw AS (SELECT *, CASE WHEN n_patterns - 1 <= 255 THEN 8 WHEN n_patterns - 1 <= 65535 THEN 16 ELSE 32 END AS index_bits FROM sc),
res AS (SELECT block_size, n_blocks, n_patterns, index_bits, n_blocks * index_bits // 8 + n_patterns * ((block_size * block_size * block_size + 7) // 8) AS compressed_bytes,
  CAST(n_blocks * index_bits // 8 + n_patterns * ((block_size * block_size * block_size + 7) // 8) AS FLOAT) / CAST(12 * (SELECT np FROM box) AS FLOAT) AS ratio FROM sw)
"""


def _voxel_sweep(c: Source) -> str:
    sizes = ", ".join(f(v) for v in voxel_sizes())
    return base(c) + f""", s AS (SELECT unnest([{sizes}]) AS voxel_size),
sg AS (SELECT voxel_size, {f(1.0)} / voxel_size AS sinv, {_axes("l@ AS q@")}, {_axes("CAST(ceil((h@ - l@) / voxel_size) AS BIGINT) + 1 AS d@")} FROM s, g),
sv AS (SELECT voxel_size, {_axes("CAST(trunc((@ - q@) * sinv) AS BIGINT) AS w@")}, {_axes("d@")} FROM pts, sg),
so AS (SELECT voxel_size, count(DISTINCT (wz * dx * dy + wy * dx + wx)) AS occupied FROM sv
  WHERE wx >= 0 AND wx < dx AND wy >= 0 AND wy < dy AND wz >= 0 AND wz < dz GROUP BY 1),
sr AS (SELECT voxel_size, dx * dy * dz AS total_voxels, occupied, CAST(occupied AS FLOAT) / CAST(dx * dy * dz AS FLOAT) AS share FROM sg JOIN so USING (voxel_size)),
res AS (SELECT voxel_size, total_voxels, occupied, share * ({f(1.0)} / ({f(1.0)} + share)) AS score FROM sr)
"""

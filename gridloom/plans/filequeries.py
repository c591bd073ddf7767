"""Queries that go through files, archives, requests and reports, each with the SQL of what must come back.

Each gets a compression run and a folder of its own, writes there and reads back.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import api, cli
from gridloom.functions import metrics
from gridloom.operators import voxel
from gridloom.plans import oracles
from gridloom.plans.clouds import Source
from gridloom.plans.compress import Compression
from gridloom.settings import CompressionSettings, CompressorConfig, SweepConfig, compressor_config, joined, sweep_config
from gridloom.sources import archive, files, headers, pointcloud, writers

TOP = 9
PCD_BINARY = "# .PCD v0.7 - Point Cloud Data file format\nVERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
PLY_BINARY = "ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"


def _binary(c: Compression, path: str, head: str) -> str:
    n = c.points.count()
    where, target = files.place(path)
    with where.open_output_stream(target) as out:
        out.write(head.format(n=n).encode())
        for r in c.points.toLocalIterator():
            out.write(struct.pack("<3f", *(float("nan") if v is None else v for v in (r.x, r.y, r.z))))
    return path


def _counted(points: DataFrame) -> DataFrame:
    return voxel.finite(points).groupBy("x", "y", "z").agg(F.count("*").alias("n"))


def _text_file(c: Compression, path: str) -> DataFrame:
    writers.save(voxel.finite(c.points), path)
    return _counted(pointcloud.load(c.spark, path))


def _detection(c: Compression, folder: str) -> DataFrame:
    writers.save(voxel.finite(c.points), f"{folder}/a.pcd")
    writers.save(voxel.finite(c.points), f"{folder}/b.PLY")
    files.write_bytes(f"{folder}/c.ply", files.read_text(f"{folder}/a.pcd").encode())
    files.write_bytes(f"{folder}/d.txt", files.read_text(f"{folder}/b.PLY").encode())
    files.write_bytes(f"{folder}/e.pcd", b"nothing of the kind\n")
    files.write_bytes(f"{folder}/f.txt", b"")
    rows = []
    for name in ("a.pcd", "b.PLY", "c.ply", "d.txt", "e.pcd", "f.txt", "none.pcd", "none"):
        found = headers.describe(f"{folder}/{name}")
        rows.append((name, found.detected.name, found.extension.name, headers.supported(f"{folder}/{name}"), found.mismatch, found.points))
    return c.spark.createDataFrame(rows, "file string, detected string, extension string, is_supported boolean, mismatch boolean, points long")


def _archived(c: Compression, folder: str) -> DataFrame:
    before = archive.is_archive(c.spark, folder)
    archive.write(c, folder)
    return archive.decode(c.spark, folder).withColumns({"was_archive": F.lit(before), "is_archive": F.lit(archive.is_archive(c.spark, folder))})


def _archive_rows(c: Compression, folder: str) -> DataFrame:
    archive.write(c, folder)
    tables = archive.read(c.spark, folder)
    of = lambda name, *columns: tables[name].select(*columns)
    return of("params", "block_size", "dictionary_size", "pattern_bits", "block_index_bit_width", "n_blocks", "dim_x", "dim_y", "dim_z", "blocks_x", "blocks_y", "blocks_z").crossJoin(of("statistics", "original_points", "compressed_voxels", "compression_ratio")).crossJoin(of("metadata", "version", "frame_id", "compression_method"))


def _raw(c: Compression, folder: str) -> DataFrame:
    archive.write_raw(c, folder)
    return c.spark.read.parquet(f"{folder}/voxels")


def _block_file(c: Compression, folder: str) -> DataFrame:
    from gridloom.operators import blocks

    bx, by, _ = c.grid.blocks(c.settings.block_size)
    at = {"bx": F.expr(f"cast(block_id % {bx} as int)"), "by": F.expr(f"cast(block_id div {bx} % {by} as int)"), "bz": F.expr(f"cast(block_id div {bx * by} as int)")}
    rows = blocks.pattern_bytes(c.blocks, "block_id", c.settings.block_size).withColumns(at).select("bx", "by", "bz", "pattern")
    writers.write_blocks(rows, f"{folder}/blocks.bin", c.settings.block_size)
    size, found = writers.read_blocks(c.spark, f"{folder}/blocks.bin")
    return found.select("bx", "by", "bz", F.hex("pattern").alias("pattern"), F.lit(size).alias("block_size"))


CONFIG = "/**:\n  ros__parameters:\n    input_file: {path}\n    voxel_size: {voxel}\n    block_size: {block}\n    min_points_threshold: 1\n    min_block_size: {least}\n    max_block_size: {most}\n    step_size: 1\n"


def _config(c: Compression, path: str, least: int, most: int) -> str:
    return CONFIG.format(path=path, voxel=c.settings.voxel_size, block=c.settings.block_size, least=least, most=most)


def _configs(c: Compression, folder: str) -> DataFrame:
    rows = []
    for i, text in enumerate((_config(c, f"{folder}/x.pcd", 4, 9), "voxel_size: 0\nblock_size: 0\nmin_block_size: 8\nmax_block_size: 4\nstep_size: 0\n", "block_size_optimizer:\n  ros__parameters:\n    input_file: a\n    save_hdf5: true\nother:\n  ros__parameters: {voxel_size: 7}\n")):
        one, sweep = compressor_config(text), sweep_config(text)
        rows.append((i, one.settings.voxel_size, one.settings.block_size, one.settings.threshold, sweep.min_block_size, sweep.max_block_size, len(sweep.sizes()), joined(sweep.problems(look=False))))
    return c.spark.createDataFrame(rows, "config int, voxel_size double, block_size int, threshold int, least int, most int, sizes int, problems string")


def _text(c: Compression, text: str) -> DataFrame:
    return c.spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


def _sweep_text(c: Compression, folder: str) -> DataFrame:
    return _text(c, api.optimal_block_size(c, 2, TOP, 1).text(True))


def _detailed(c: Compression, folder: str) -> DataFrame:
    return _text(c, metrics.detailed_report("cloud", c.grid, c.settings, c.sizes, c.counts.count(), c.committed))


def _row(c: Compression, warning: str, success: bool, run: Compression) -> dict:
    z = run.sizes
    return {"success": success, "warning": warning, "n_points": z.n_points, "n_blocks": z.n_blocks, "n_patterns": z.n_patterns, "compressed_bytes": z.compressed_bytes, "occupied": run.committed}


def _request(c: Compression, folder: str) -> DataFrame:
    path = _binary(c, f"{folder}/cloud.pcd", PCD_BINARY)
    report = api.compress(c.spark, api.Request(path, c.settings, f"{folder}/out", f"{folder}/raw"))
    out = metrics.as_row(c.spark, _row(c, report.warning, report.success, report.run))
    return out.withColumn("decoded", F.lit(archive.decode(c.spark, f"{folder}/out").count()))


def _callback(c: Compression, folder: str) -> DataFrame:
    path, got = _binary(c, f"{folder}/cloud.ply", PLY_BINARY), []
    said = api.run_compression(c.spark, api.Request(path, c.settings), lambda report: got.append(_row(c, report.warning, report.success, report.run)))
    failed = api.run_compression(c.spark, api.Request("", c.settings.with_(block_size=0)), lambda report: got.append(None))
    return metrics.as_row(c.spark, got[0] | {"calls": len(got), "said": said, "failed": failed})


def _optimized(c: Compression, folder: str) -> DataFrame:
    path = _binary(c, f"{folder}/cloud.pcd", PCD_BINARY)
    base = CompressorConfig(path, c.settings.voxel_size, c.settings.block_size)
    found = api.optimize(c.spark, SweepConfig(base, 2, TOP, 1))
    row = {"best_block_size": found.best_block_size, "tested": len(found.tested), "voxel_size": found.voxel_size, "report_block_size": found.report.run.settings.block_size, "success": found.report.success}
    return metrics.as_row(c.spark, row).withColumns({"best_ratio": voxel.f32(found.best_ratio), "voxel_size": F.col("voxel_size").cast("float")})


def _swept(c: Compression, folder: str) -> DataFrame:
    """The command line's sweep over one block size, so that its summary is that of the run."""
    path = _binary(c, f"{folder}/cloud.ply", PLY_BINARY)
    files.write_bytes(f"{folder}/config.yaml", _config(c, path, c.settings.block_size, c.settings.block_size).encode())
    return c.spark.createDataFrame([(cli._sweep(c.spark, f"{folder}/config.yaml"),)], "summary string")


def _again(c: Compression, folder: str) -> DataFrame:
    """A run that is let go of gives the same again; changed settings give a run of their own."""
    first, grid = c.committed, c.grid
    c.release()
    other = Compression(c.points, c.settings.with_(min_points=2))
    return metrics.as_row(c.spark, {"first": first, "again": c.committed, "same_grid": grid == c.grid, "changed": other.committed, "kept": c.settings.min_points})


QUERIES = {
    "pcd_ascii_file": lambda c, folder: _text_file(c, f"{folder}/cloud.pcd"),
    "ply_ascii_file": lambda c, folder: _text_file(c, f"{folder}/cloud.ply"),
    "pcd_binary_file": lambda c, folder: _counted(pointcloud.load(c.spark, _binary(c, f"{folder}/cloud.pcd", PCD_BINARY))),
    "ply_binary_file": lambda c, folder: _counted(pointcloud.load(c.spark, _binary(c, f"{folder}/cloud.ply", PLY_BINARY), rangeBytes=1 << 12)),
    "file_detection": _detection,
    "archive_voxels": _archived,
    "archive_tables": _archive_rows,
    "raw_grid_file": _raw,
    "block_file": _block_file,
    "config_files": _configs,
    "summary_text": lambda c, folder: _text(c, metrics.compression_text(c.sizes, c.settings)),
    "sweep_text": _sweep_text,
    "detailed_report": _detailed,
    "log_lines": lambda c, folder: _text(c, "\n".join(metrics.summary_lines(c.metrics()))),
    "request_report": _request,
    "callback_run": _callback,
    "optimize_workflow": _optimized,
    "sweep_command": _swept,
    "released_run": _again,
}


def run(source: Source, query, spark, sf_dir):
    return query(Compression(source.read(spark, sf_dir), source.settings), files.scratch(spark))


def _lines(c: Source, with_: str, table: str, lines: list[str]) -> str:
    """(line, text) of SQL expressions over a table of one row."""
    return with_ + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS line, {e} AS text FROM {table}" for i, e in enumerate(lines))


def oracle_sql(c: Source) -> dict[str, str]:
    s, b = c.settings.block_size, oracles.base(c)
    known, bytes_ = oracles.oracles(c), (s**3 + 7) // 8
    count = lambda f: b + f"SELECT {', '.join(f.replace('@', a) + ' AS ' + a for a in 'xyz')}, count(*) AS n FROM pts GROUP BY 1, 2, 3"
    n = "(SELECT np FROM box)"
    mb = lambda e: f"printf('%.2f MB', CAST({e} AS DOUBLE) / 1e6)"
    kb = lambda e: f"printf('%d bytes (%.2f KB)', CAST({e} AS BIGINT), CAST({e} AS DOUBLE) / 1024)"
    label = lambda k, e: f"rpad('  {k}', 20, ' ') || ': ' || {e}"
    ratio = "printf('%.6f', CAST(compression_ratio AS DOUBLE))"
    cover = b + f", cover AS (SELECT *, CAST(greatest(CAST(nx AS BIGINT) * {s}, gx) AS BIGINT) AS wx, CAST(greatest(CAST(ny AS BIGINT) * {s}, gy) AS BIGINT) AS wy, CAST(greatest(CAST(nz AS BIGINT) * {s}, gz) AS BIGINT) AS wz FROM sz), whole AS (SELECT *, wx * wy * wz AS total, (wx * wy * wz + 7) // 8 AS bits FROM cover) "
    raw = b + f", whole AS (SELECT *, CAST(gx AS BIGINT) * gy * gz AS total, (SELECT count(*) FROM cnt) AS candidates, compressed_bytes + {metrics.METADATA_BYTES} AS everything FROM sz) "
    side = f"CAST({oracles.f(c.settings.voxel_size)} AS DOUBLE)"
    report = ["'[REPORT][File IO]'", label("Input file", "'cloud'"), label("Points", "n_points"), label("Load time", "'0.000 ms'")]
    report += ["'[REPORT][Voxelization]'", label("Grid dims", "printf('%d x %d x %d (%d voxels)', gx, gy, gz, total)"), label("Voxel counting", "printf('0.000 ms (%d candidate voxels)', candidates)"), label("Grid transfer", "printf('%d voxels set', occupied)"), label("Block division", "printf('%d x %d x %d = %d blocks', nx, ny, nz, n_blocks)")]
    report += ["'[REPORT][Compression]'", label("Blocks processed", "n_blocks"), label("Codebook patterns", "n_patterns"), label("Index entries", "n_blocks"), label("Dictionary build", "'0.000 ms'"), label("Index bit width", "index_bits || '-bit'"), label("Total time", "'0.000 ms'"), label("Compression ratio", ratio)]
    report += ["'[REPORT][Memory]'", label("Voxel size", f"printf('%.3f m', CAST({c.settings.voxel_size} AS DOUBLE))"), label("Raw grid", kb("total")), label("Occupied voxels", "printf('%d (%.2f%%)', occupied, CAST(occupied AS DOUBLE) / total * 100)"), label("Block indices", kb("index_bytes")), label("Pattern dict", kb("dictionary_bytes")), label("Metadata", f"'{metrics.METADATA_BYTES} bytes'"), label("Compressed total", kb("everything")), label("Memory reduction", "printf('%.2f%%', (1 - CAST(everything AS DOUBLE) / total) * 100)")]
    env = [f"printf('Environment scale: %.2fm * %.2fm * %.2fm', wx * {side}, wy * {side}, wz * {side})", f"'Map size at 1 byte/voxel (pre-compression): ' || {mb('total')}", f"'Map size at 1 bit/voxel (pre-compression): ' || {mb('bits')}", f"'Index array: ' || n_blocks || ' entries, ' || {mb('index_bytes')}", f"'Codebook: ' || n_patterns || ' entries, ' || {mb('dictionary_bytes')}", f"'Compressed map total: ' || {mb('compressed_bytes')}", "printf('Compression ratio vs 1 byte/voxel: %.6f', CAST(compressed_bytes AS DOUBLE) / total)", "printf('Compression ratio vs 1 bit/voxel: %.6f', CAST(compressed_bytes AS DOUBLE) / bits)"]
    sweep = oracles.block_sweep(c, 2, TOP)
    told = "SELECT true AS success, '' AS warning, n_points, n_blocks, n_patterns, compressed_bytes, occupied"
    kinds = f"VALUES ('a.pcd', 'PCD', 'PCD', true, false, {n}), ('b.PLY', 'PLY', 'PLY', true, false, {n}), ('c.ply', 'PCD', 'PLY', true, true, {n}), ('d.txt', 'PLY', 'UNKNOWN', true, false, {n}), ('e.pcd', 'PCD', 'PCD', true, false, 0), ('f.txt', 'UNKNOWN', 'UNKNOWN', false, false, 0), ('none.pcd', 'UNKNOWN', 'PCD', false, false, 0), ('none', 'UNKNOWN', 'UNKNOWN', false, false, 0)"
    problems = "input_file is empty; voxel_size must be positive; block_size must be greater than zero; max_block_size must be greater than or equal to min_block_size; step_size must be greater than zero"
    d = CompressionSettings()
    return {
        "pcd_ascii_file": count("CAST(printf('%.6f', CAST(@ AS DOUBLE)) AS FLOAT)"),
        "ply_ascii_file": count("CAST(printf('%.6g', CAST(@ AS DOUBLE)) AS FLOAT)"),
        "pcd_binary_file": count("@"),
        "ply_binary_file": count("@"),
        "file_detection": b + f"SELECT * FROM ({kinds}) AS t(file, detected, extension, is_supported, mismatch, points)",
        "archive_voxels": b + "SELECT voxel_id, false AS was_archive, true AS is_archive FROM vox",
        "archive_tables": b + f"SELECT CAST({s} AS BIGINT) AS block_size, n_patterns AS dictionary_size, CAST({s**3} AS BIGINT) AS pattern_bits, bit_width AS block_index_bit_width, n_blocks, CAST(gx AS BIGINT) AS dim_x, CAST(gy AS BIGINT) AS dim_y, CAST(gz AS BIGINT) AS dim_z, CAST(nx AS BIGINT) AS blocks_x, CAST(ny AS BIGINT) AS blocks_y, CAST(nz AS BIGINT) AS blocks_z, n_points AS original_points, n_blocks * {s**3} AS compressed_voxels, CAST(compression_ratio AS DOUBLE) AS compression_ratio, '1.0' AS version, 'map' AS frame_id, 'voxel_dictionary' AS compression_method FROM sz",
        "raw_grid_file": known["raw_grid"],
        "block_file": b + f"SELECT CAST(block_id % nx AS INTEGER) AS bx, CAST(block_id // nx % ny AS INTEGER) AS by, CAST(block_id // (CAST(nx AS BIGINT) * ny) AS INTEGER) AS bz, pattern, CAST({s} AS INTEGER) AS block_size FROM occ JOIN enc USING (block_id) JOIN hexed USING (code), nb",
        "config_files": f"SELECT * FROM (VALUES (0, CAST({c.settings.voxel_size} AS DOUBLE), {s}, 1, 4, 9, 6, ''), (1, CAST(0 AS DOUBLE), 0, 1, 8, 4, 0, '{problems}'), (2, CAST({d.voxel_size} AS DOUBLE), {d.block_size}, 1, 4, 32, 29, 'hdf5_output_file must be set when save_hdf5 is true')) AS t(config, voxel_size, block_size, threshold, least, most, sizes, problems)",
        "summary_text": _lines(c, b, "sz", ["'Compression summary:'", f"'  Compression ratio: ' || {ratio}", "'  Block count      : ' || n_blocks", f"printf('  Dictionary size  : %d patterns ({bytes_} bytes each)', n_patterns)", "'  Index bit width  : ' || index_bits || ' bits'"]),
        "sweep_text": sweep + ", best AS (SELECT * FROM res ORDER BY ratio, block_size LIMIT 1), lines AS (SELECT 0 AS line, 'Optimal block size: ' || block_size AS text FROM best UNION ALL SELECT 1, printf('Best compression ratio: %.6f', CAST(ratio AS DOUBLE)) FROM best UNION ALL SELECT 2, 'Tested block sizes:' UNION ALL SELECT 2 + row_number() OVER (ORDER BY block_size), printf('  block_size=%d ratio=%.6f', block_size, CAST(ratio AS DOUBLE)) FROM res UNION ALL SELECT 3 + (SELECT count(*) FROM res), '') SELECT CAST(line AS INTEGER) AS line, text FROM lines",
        "detailed_report": _lines(c, raw, "whole", report),
        "log_lines": _lines(c, cover, "whole", env),
        "request_report": b + told + ", CAST(occupied AS INTEGER) AS decoded FROM sz",
        "callback_run": b + told + ", CAST(1 AS BIGINT) AS calls, '' AS said, 'input_file is empty; block_size must be greater than zero' AS failed FROM sz",
        "optimize_workflow": f"SELECT CAST(k.block_size AS BIGINT) AS best_block_size, CAST({TOP - 1} AS BIGINT) AS tested, coalesce((SELECT voxel_size FROM ({known['best_voxel_size']})), {oracles.f(0.005)}) AS voxel_size, CAST(k.block_size AS BIGINT) AS report_block_size, true AS success, k.ratio AS best_ratio FROM ({sweep} SELECT block_size, ratio FROM res ORDER BY ratio, block_size LIMIT 1) k",
        "sweep_command": known["sweep_json"],
        "released_run": b + "SELECT occupied AS first, occupied AS again, true AS same_grid, (SELECT count(*) FROM vox WHERE n >= 2) AS changed, CAST(1 AS BIGINT) AS kept FROM sz",
    }

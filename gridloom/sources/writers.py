"""Clouds as ASCII PCD and PLY files, blocks as block files."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources import files
from gridloom.sources.headers import Format, by_extension

AXES = ("x", "y", "z")


def _pcd_head(n: int) -> str:
    said = {"VERSION": "0.7", "FIELDS": "x y z", "SIZE": "4 4 4", "TYPE": "F F F", "COUNT": "1 1 1", "WIDTH": n, "HEIGHT": 1, "VIEWPOINT": "0 0 0 1 0 0 0", "POINTS": n, "DATA": "ascii"}
    return "# .PCD v0.7 - Point Cloud Data file format\n" + "".join(f"{k} {v}\n" for k, v in said.items())


def _ply_head(n: int) -> str:
    return "\n".join(["ply", "format ascii 1.0", "comment Created by gridloom", f"element vertex {n}", *(f"property float {a}" for a in AXES), "end_header", ""])


def text_lines(points: DataFrame, kind: Format, digits: int = 6) -> DataFrame:
    """(value): a line a point. PCD has `digits` decimals, PLY as many significant digits."""
    form = f"%.{digits}f" if kind is Format.PCD else f"%.{digits}g"
    if kind is Format.PCD:
        return points.select(F.format_string(" ".join([form] * 3), *[F.col(a).cast("double") for a in AXES]).alias("value"))
    # Java's %g keeps trailing zeros and has no short form: round to the digits, then print the double plainly.
    short = [_significant(F.col(a).cast("double"), digits) for a in AXES]
    return points.select(F.concat_ws(" ", *short).alias("value"))


def _significant(x, digits: int):
    scale = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))))
    power = F.pow(F.lit(10.0), (F.lit(digits - 1) - scale).cast("double"))
    rounded = F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * power) / power)
    text = F.regexp_replace(F.call_function("format_number", rounded, F.lit("0.####################")), ",", "")
    return F.when((scale < -5) | (scale >= digits), F.lower(rounded.cast("string"))).otherwise(text)


def save(points: DataFrame, path: str, digits: int = 6) -> int:
    """Write one file, in the format of its extension; returns the number of points.

    The lines are made in parallel and brought over partition by partition, so the driver holds one
    partition at a time; for a cloud beyond one file's use, write Parquet.
    """
    kind = by_extension(path)
    if kind is Format.UNKNOWN:
        raise ValueError(f"neither .pcd nor .ply: {path}")
    rows = text_lines(points, kind, digits).persist()
    n = rows.count()
    where, target = files.place(path)
    with where.open_output_stream(target) as out:
        out.write((_pcd_head(n) if kind is Format.PCD else _ply_head(n)).encode())
        for row in rows.toLocalIterator():
            out.write(row.value.encode() + b"\n")
    rows.unpersist()
    return n


def write_blocks(blocks: DataFrame, path: str, size: int) -> int:
    """(bx, by, bz, pattern) as a block file: count and size, then position, length and bytes of each block."""
    n = blocks.count()
    where, target = files.place(path)
    with where.open_output_stream(target) as out:
        out.write(struct.pack("<II", n, size))
        for r in blocks.orderBy("bz", "by", "bx").toLocalIterator():
            out.write(struct.pack("<iiiI", r.bx, r.by, r.bz, len(r.pattern)) + bytes(r.pattern))
    return n


def read_blocks(spark, path: str) -> tuple[int, DataFrame]:
    """Size and (bx, by, bz, pattern) of a block file."""
    with files.open_file(path) as f:
        n, size = struct.unpack("<II", f.read(8))
        rows = []
        for _ in range(n):
            bx, by, bz, length = struct.unpack("<iiiI", f.read(16))
            rows.append((bx, by, bz, f.read(length)))
    return size, spark.createDataFrame(rows, "bx int, by int, bz int, pattern binary")

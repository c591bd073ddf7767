"""The `pointcloud` data source: PCD and PLY files as DataFrames of x, y, z, read in parallel byte ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources import files
from gridloom.sources.headers import BadCloudFile, Format, Header, header

SCHEMA = "x float, y float, z float"
#: Bytes of a partition, and of what a task holds at a time.
RANGE, PIECE = 32 << 20, 4 << 20


class Range(InputPartition):
    """Points [first, last) of a binary file, or the lines that begin in bytes [first, last) of a text file."""

    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


def _batch(xyz: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(xyz[:, k], np.float32)) for k in range(3)], ["x", "y", "z"])


def _binary(part: Range, head: Header):
    dtype, places = head.dtype, head.xyz()
    names = [dtype.names[p] for p in places]
    step = max(1, PIECE // dtype.itemsize)
    with files.open_file(part.path) as f:
        for first in range(part.first, part.last, step):
            n = min(step, part.last - first)
            f.seek(head.start + first * dtype.itemsize)
            data = f.read(n * dtype.itemsize)
            if len(data) < n * dtype.itemsize:
                raise BadCloudFile(f"{part.path}: fewer points than its header says")
            points = np.frombuffer(data, dtype)
            yield np.stack([points[k].astype(np.float32) for k in names], axis=1)


def _text(part: Range, head: Header):
    """The lines that begin in the range; one that begins before it belongs to the range before."""
    with files.open_file(part.path) as f:
        at = part.first
        f.seek(at)
        if at > head.start:
            f.seek(at - 1)
            skipped = b""
            while not skipped.endswith(b"\n"):
                byte = f.read(4096)
                if not byte:
                    return
                cut = byte.find(b"\n")
                if cut >= 0:
                    at += len(skipped) + cut
                    break
                skipped += byte
            f.seek(at)
        rest = b""
        while at < part.last:
            data = f.read(PIECE)
            if not data:
                break
            block = rest + data
            lines = block.split(b"\n")
            rest = lines.pop()
            done = []
            for line in lines:
                if at >= part.last:
                    rest = b""
                    break
                at += len(line) + 1
                done.append(line)
            yield done
            if at >= part.last:
                return
        if rest and at < part.last:
            yield [rest]


def _numbers(words: list[bytes]) -> list[float] | None:
    try:
        return [float(w) for w in words]
    except ValueError:
        return None


def _rows(lines: list[bytes], head: Header) -> np.ndarray:
    places, width, out = ([0, 1, 2] if head.format is Format.PCD else head.xyz()), len(head.fields), []
    for line in lines:
        words = line.split()
        if not words:
            continue
        if head.format is Format.PCD:
            values = _numbers(words[:3])
            if values is None or len(values) < 3:
                continue
        else:
            values = _numbers(words[:width])
            if values is None or len(values) < width:
                raise BadCloudFile(f"a vertex with fewer than {width} numbers")
        out.append([values[p] for p in places])
    return np.array(out, np.float32).reshape(-1, 3)


def _end(path: str, head: Header) -> int:
    """Where the last of the points that the header promises ends: for text files in which other lines follow."""
    at, left = head.start, head.points
    with files.open_file(path) as f:
        f.seek(at)
        rest = b""
        while left and (data := f.read(PIECE)):
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            for line in lines:
                at += len(line) + 1
                words = line.split()
                left -= bool(words) and (head.format is Format.PLY or len(words) > 2 and _numbers(words[:3]) is not None)
                if not left:
                    break
        return at if not left else at + len(rest)


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int, exact: bool):
        self.path, self.size = path, size
        self.head = header(path)
        self.exact = exact or self.head.more

    def partitions(self):
        if self.head.kind == "binary":
            width = self.head.dtype.itemsize
            first, last, step = 0, self.head.points, max(1, self.size // width)
        else:
            first, step = self.head.start, self.size
            last = _end(self.path, self.head) if self.exact else files.info(self.path).size
        return [Range(self.path, a, min(last, a + step)) for a in range(first, last, step)] or [Range(self.path, first, first)]

    def read(self, partition: Range):
        """Points with coordinates that aren't all finite are left out."""
        if self.head.kind == "binary":
            parts = _binary(partition, self.head)
        else:
            parts = (_rows(lines, self.head) for lines in _text(partition, self.head))
        for xyz in parts:
            yield _batch(xyz[np.isfinite(xyz).all(axis=1)])


class PointCloud(DataSource):
    """spark.read.format("pointcloud").load(path)"""

    @classmethod
    def name(cls):
        return "pointcloud"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE)), self.options.get("exact", "false").lower() == "true")


def load(spark: SparkSession, path: str, check: bool = True, **options) -> DataFrame:
    """The points of a PCD or PLY file.

    check: an ASCII file must have as many points as its header says; lines beyond them are not read. Where
    other elements follow the points, or lines do, the file's text is first passed over to find their end.
    """
    head = header(path)
    spark.dataSource.register(PointCloud)
    read = lambda **more: spark.read.format("pointcloud").options(**options, **more).load(path)
    points = read()
    if not check or head.kind != "ascii":
        return points
    n = points.count()
    if n > head.points:
        points, n = read(exact="true"), head.points
    if n < head.points:
        raise BadCloudFile(f"{path}: {n} points, but its header says {head.points}")
    return points

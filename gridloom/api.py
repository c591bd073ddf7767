"""Requests and reports: compress a file, optimize its settings, with sinks and a callback."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from gridloom.functions import metrics
from gridloom.operators import sweep
from gridloom.plans.compress import Compression, EmptyCloud
from gridloom.settings import CompressionSettings, CompressorConfig, SweepConfig, compressor_config, joined, sweep_config
from gridloom.sources import archive, files, pointcloud


@dataclass(frozen=True)
class Request:
    """One compression: the cloud's file and what to do with it."""

    input_file: str
    settings: CompressionSettings = field(default_factory=CompressionSettings)
    archive_path: str | None = None
    raw_path: str | None = None

    @classmethod
    def of(cls, config: CompressorConfig) -> Request:
        return cls(config.input_file, config.settings, config.archive_path, config.raw_path)

    def problems(self) -> list[str]:
        said = []
        if not self.input_file:
            said.append("input_file is empty")
        if self.settings.voxel_size <= 0:
            said.append("voxel_size must be positive")
        if self.settings.block_size <= 0:
            said.append("block_size must be greater than zero")
        return said


@dataclass
class Report:
    """What came of a request. A failed sink leaves a warning on a successful report."""

    success: bool
    error: str = ""
    warning: str = ""
    run: Compression | None = None

    @property
    def sizes(self) -> metrics.Sizes:
        return self.run.sizes

    def text(self) -> str:
        return metrics.compression_text(self.sizes, self.run.settings) if self.success else f"[REPORT][Compression]\n  Status           : failed\n  Error            : {self.error}"

    def release(self) -> None:
        """Let go of what the run keeps; the report's numbers go with it."""
        if self.run is not None:
            self.run.release()
            self.run = None


def compress_cloud(points: DataFrame, settings: CompressionSettings) -> Compression:
    """A run over any cloud DataFrame (x, y, z)."""
    return Compression(points, settings)


def compress(spark: SparkSession, request: Request) -> Report:
    """Read, compress, write the sinks asked for."""
    problems = request.problems()
    if problems:
        return Report(False, joined(problems))
    try:
        run = Compression(pointcloud.load(spark, request.input_file).persist(), request.settings)
        run.sizes  # noqa: B018 - the run's eager steps, so that errors show here
    except (EmptyCloud, ValueError, OSError) as e:
        return Report(False, str(e))
    failed = []
    for path, write in ((request.archive_path, archive.write), (request.raw_path, archive.write_raw)):
        if path:
            try:
                write(run, path)
            except Exception as e:  # any sink, any store: the compression itself stands
                failed.append(f"archive write failed: {path}: {e}")
    return Report(True, warning=joined(failed), run=run)


def run_compression(spark: SparkSession, request: Request, done: Callable[[Report], None]) -> str:
    """Compress, hand the report to `done`, and release it whatever happens. Returns the warning or error, or ''."""
    if done is None:
        raise ValueError("a callback is needed")
    report = compress(spark, request)
    try:
        if report.success:
            done(report)
        return report.warning if report.success else report.error
    finally:
        report.release()


@dataclass
class Optimum:
    """The sweep's outcome; best is None if no size could be tried."""

    best_block_size: int | None
    best_ratio: float | None
    tested: dict[int, float]
    voxel_size: float | None = None
    report: Report | None = None

    def text(self, verbose: bool = False) -> str:
        return metrics.sweep_text(self.best_block_size, self.best_ratio, self.tested, verbose)


def optimal_block_size(run: Compression, least: int = 4, most: int = 32, step: int = 1) -> Optimum:
    """The block size of the lowest ratio at the run's voxel size; the lowest size of equals."""
    from gridloom.settings import block_sizes

    if not block_sizes(least, most, step):
        return Optimum(None, None, {})
    rows = run.sweep_blocks(least, most, step).collect()  # a row a size: 64 at most
    tested = {r.block_size: r.ratio for r in rows}
    best = min(rows, key=lambda r: (r.ratio, r.block_size))
    return Optimum(best.block_size, best.ratio, tested)


def optimal_voxel_size(run: Compression, least: float = 0.005, most: float = 0.05, step: float = 0.005) -> float:
    """The voxel size of the highest score, or the least one if none has a score."""
    row = sweep.best_voxel_size(run.sweep_voxels(least, most, step)).first()
    return row.voxel_size if row else least


def optimize(spark: SparkSession, config: SweepConfig, joint: bool = False) -> Optimum:
    """Sweep voxel and block sizes and compress with both; the cloud is read once.

    The block sweep is at the configured voxel size; joint: at the best voxel size instead.
    A sink that fails is an error here.
    """
    problems = config.problems()
    if problems:
        raise ValueError(joined(problems))
    points = pointcloud.load(spark, config.base.input_file).persist()
    run = Compression(points, config.base.settings)
    voxel_size = optimal_voxel_size(run)
    swept = Compression(points, config.base.settings.with_(voxel_size=voxel_size)) if joint else run
    found = optimal_block_size(swept, config.min_block_size, config.max_block_size, config.step_size)
    best = config.base.settings.with_(voxel_size=voxel_size, block_size=found.best_block_size or config.base.block_size)
    report = compress(spark, replace(Request.of(config.base), settings=best))
    if not report.success or report.warning:
        raise RuntimeError(report.error or report.warning)
    return Optimum(found.best_block_size, found.best_ratio, found.tested, voxel_size, report)


def compress_file(spark: SparkSession, config_path: str) -> Report:
    config = compressor_config(files.read_text(config_path))
    problems = config.problems()
    return Report(False, joined(problems)) if problems else compress(spark, Request.of(config))


def optimize_file(spark: SparkSession, config_path: str) -> Optimum:
    return optimize(spark, sweep_config(files.read_text(config_path)))


class Handle:
    """A compressor that holds its last report until it is released or closed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.last = spark, None

    def compress(self, request: Request) -> Report:
        self.release()
        self.last = compress(self.spark, request)
        return self.last

    def release(self) -> None:
        if self.last is not None:
            self.last.release()
            self.last = None

    def __enter__(self) -> Handle:
        return self

    def __exit__(self, *_) -> None:
        self.release()

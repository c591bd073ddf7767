"""python -m gridloom.cli compress|optimize CONFIG.yaml, or sweep CONFIG.yaml for the block sizes alone."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from gridloom import api
from gridloom.functions import metrics
from gridloom.plans.compress import Compression
from gridloom.settings import joined, sweep_config
from gridloom.sources import files, pointcloud


def _sweep(spark: SparkSession, path: str) -> str:
    """Block sizes at the configured voxel size, as JSON; of a failure, a JSON error with size -1."""
    config = sweep_config(files.read_text(path))
    problems = config.problems()
    if problems:
        return f'{{"error": "{joined(problems)}", "optimal_block_size": -1, "ratio": -1.0}}'
    points = pointcloud.load(spark, config.base.input_file).persist()
    found = api.optimal_block_size(Compression(points, config.base.settings), config.min_block_size, config.max_block_size, config.step_size)
    run = Compression(points, config.base.settings.with_(block_size=found.best_block_size))
    return metrics.sweep_json(found.best_block_size, run.metrics())


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if len(args) != 2 or args[0] not in ("compress", "optimize", "sweep") or not args[1]:
        print(__doc__, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("gridloom").getOrCreate()
    if args[0] == "sweep":
        print(_sweep(spark, args[1]))
        return 0
    try:
        if args[0] == "compress":
            report = api.compress_file(spark, args[1])
            print(report.text())
            if report.warning:
                print(report.warning, file=sys.stderr)
            return 0 if report.success else 1
        found = api.optimize_file(spark, args[1])
        print(f"Optimal voxel size: {found.voxel_size:.6f}\n{found.text(True)}{found.report.text()}")
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

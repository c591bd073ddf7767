"""Point clouds derived from the driver's tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.voxel import cloud
from gridloom.settings import CompressionSettings


@dataclass(frozen=True)
class Source:
    table: str
    #: Expressions of x, y, z, in Spark and in DuckDB.
    spark: tuple[str, str, str]
    duck: tuple[str, str, str]
    settings: CompressionSettings

    def read(self, session: SparkSession, sf_dir: str) -> DataFrame:
        rows = session.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return cloud(rows, *(F.expr(e) for e in self.spark))


_PRICES = ("l_quantity", "l_extendedprice / 1000", "l_discount * 100")

CLOUDS = {
    "lineitem": Source("lineitem", _PRICES, _PRICES, CompressionSettings(1.0, 4)),
    # Voxel borders here tell a multiplication with the reciprocal from a division.
    "lineitem_fine": Source("lineitem", _PRICES, _PRICES, CompressionSettings(0.3, 3)),
    "embeddings": Source("embeddings", ("embedding[0]", "embedding[1]", "embedding[2]"), ("embedding[1]", "embedding[2]", "embedding[3]"), CompressionSettings(0.05, 4)),
    "events": Source("events", ("user_id", "hour(ts)", "value / 10"), ("user_id", "hour(ts)", "value / 10"), CompressionSettings(1.0, 8)),
}

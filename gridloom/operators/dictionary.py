"""Block patterns to a dictionary of distinct patterns, coded in order of first occurrence, and block codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dictionary rows of a rank window: beyond this it is cut into ranges, of which there are at most RANGES.
RANGE_ROWS, RANGES = 200_000, 1024


def ranked(rows: DataFrame, order: str, out: str, total: int, per_range: int = RANGE_ROWS) -> DataFrame:
    """Add `out`: each row's rank from 0 by a distinct long column, without one window over all rows.

    Ranges are cut at approximate quantiles; a row's rank is the number of rows of lower ranges, from a
    table of a row a range, plus its rank within its own.
    """
    ranges = min(RANGES, max(1, -(-total // per_range)))
    if ranges == 1:
        return rows.withColumn(out, F.row_number().over(Window.orderBy(order)) - 1)
    cuts = rows.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))])
    rows = rows.withColumn("_range", F.size(F.filter(cuts, lambda c: c < F.col(order))))
    before = rows.groupBy("_range").count().withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return rows.withColumn(out, within).join(before.select("_range", "_base"), "_range").withColumn(out, F.col(out) + F.col("_base")).drop("_range", "_base")


@dataclass(frozen=True)
class Dictionary:
    """codes: (code, bits, first_block, uses). The empty pattern, if there are empty blocks, is one of them."""

    codes: DataFrame
    n_blocks: int
    n_patterns: int
    occupied_blocks: int
    empty_code: int | None
    #: What is persisted, to be let go of.
    kept: DataFrame | None = None

    @property
    def max_index(self) -> int:
        return max(0, self.n_patterns - 1)

    @property
    def index_bits(self) -> int:
        return index_width(self.max_index)


def index_width(max_index: int) -> int:
    """The narrowest of 8, 16, 32 and 64 bits that holds an index."""
    return next(w for w in (8, 16, 32, 64) if w == 64 or max_index < 1 << w)


def index_width_column(max_index: Column) -> Column:
    return F.when(max_index <= 0xFF, 8).when(max_index <= 0xFFFF, 16).when(max_index <= 0xFFFFFFFF, 32).otherwise(64)


def build(blocks: DataFrame, n_blocks: int, per_range: int = RANGE_ROWS) -> Dictionary:
    """The dictionary of (block_id, bits), codes in order of each pattern's lowest block.

    Blocks not in the table are empty: they never pass a shuffle. If there are any, the lowest of them is
    among the ids up to the number of occupied ones, so that an anti-join of that many ids finds it.
    """
    spark = blocks.sparkSession
    found = blocks.groupBy("bits").agg(F.min("block_id").alias("first_block"), F.count("*").alias("uses")).persist()
    row = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("uses"), F.lit(0)).alias("used")).first()
    patterns, occupied, empty_first = row.n, row.used, None
    codes = found
    if occupied < n_blocks:
        empty_first = spark.range(occupied + 1).join(blocks.select(F.col("block_id").alias("id")), "id", "left_anti").agg(F.min("id")).first()[0]
        codes = codes.unionByName(spark.range(1).select(F.array().cast("array<int>").alias("bits"), F.lit(empty_first).cast("long").alias("first_block"), F.lit(n_blocks - occupied).cast("long").alias("uses")))
        patterns += 1
    codes = ranked(codes, "first_block", "code", patterns, per_range).select(F.col("code").cast("long").alias("code"), "bits", "first_block", "uses")
    empty = None if empty_first is None else codes.where(F.size("bits") == 0).first().code
    return Dictionary(codes, n_blocks, patterns, occupied, empty, found)


def encode(blocks: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(block_id, code) of the occupied blocks; all others have the empty code. Hot patterns are AQE's to split."""
    return blocks.join(dictionary.codes.select("bits", "code"), "bits").select("block_id", "code")


def dense(encoded: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(block_id, code) of every block: only for sinks, which need one entry a block."""
    every = encoded.sparkSession.range(dictionary.n_blocks).withColumnRenamed("id", "block_id")
    return every.join(encoded, "block_id", "left").select("block_id", F.coalesce("code", F.lit(dictionary.empty_code)).cast("long").alias("code"))


def decode(encoded: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(block_id, bit) of encoded blocks: the occupied voxels, as they were."""
    return encoded.join(dictionary.codes.select("code", "bits"), "code").select("block_id", F.explode("bits").alias("bit"))

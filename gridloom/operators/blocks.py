"""Voxels to blocks: block ids, in-block bits, bit patterns, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.voxel import Grid, located


def block_bits(voxels: DataFrame, grid: Grid, size: int) -> DataFrame:
    """(block_id, bit) of each occupied voxel; both count x fastest. A projection, no shuffle."""
    bx, by, _ = grid.blocks(size)
    return located(voxels, grid).select(
        F.expr(f"cast(vz div {size} as long) * {bx * by} + cast(vy div {size} as long) * {bx} + cast(vx div {size} as long)").alias("block_id"),
        F.expr(f"(vz % {size}) * {size * size} + (vy % {size}) * {size} + vx % {size}").cast("int").alias("bit"),
    )


def patterns(bits: DataFrame) -> DataFrame:
    """(block_id, bits): the occupied bits of each block that has any, ascending.

    Voxels are distinct, so this is the block's pattern; a list never has more than size cubed bits, and
    empty blocks are never made.
    """
    return bits.groupBy("block_id").agg(F.sort_array(F.collect_list("bit")).alias("bits"))


def occupied_counts(bits: DataFrame) -> DataFrame:
    """(block_id, occupied) of the blocks that aren't empty."""
    return bits.groupBy("block_id").agg(F.count("*").alias("occupied"))


def pattern_bytes(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, pattern): the bytes of each row's `bits`, bit k being bit k % 8 of byte k div 8, lowest first.

    Bits are folded into bytes by grouping, so that cost follows the occupied bits; bytes without any are
    filled in at the end.
    """
    count = (size**3 + 7) // 8
    each = rows.select(key, F.explode_outer("bits").alias("bit")).groupBy(key, F.expr("bit div 8").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("byte"))
    found = each.groupBy(key).agg(F.array_sort(F.filter(F.collect_list(F.struct("at", "byte")), lambda e: e["at"].isNotNull())).alias("bytes"))
    before = lambda i: F.coalesce(F.get("bytes", i - 1)["at"], F.lit(-1))
    hexed = F.transform("bytes", lambda e, i: F.concat(F.repeat(F.lit("00"), (e["at"] - before(i) - 1).cast("int")), F.lpad(F.hex(e["byte"].cast("long")), 2, "0")))
    return found.select(key, F.unhex(F.rpad(F.array_join(hexed, ""), 2 * count, "0")).alias("pattern"))


def unpacked(rows: DataFrame, key: str) -> DataFrame:
    """(key, bit) of the set bits of each row's `pattern`."""
    pairs = rows.select(key, F.posexplode(F.expr("regexp_extract_all(hex(pattern), '..', 0)")).alias("at", "byte"))
    value = F.conv("byte", 16, 10).cast("int")
    spread = pairs.where(F.col("byte") != "00").select(key, "at", value.alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return spread.where(F.expr("shiftright(byte, k) & 1 = 1")).select(key, F.expr("at * 8 + k").cast("int").alias("bit"))


def voxels_of(bits: DataFrame, grid: Grid, size: int) -> DataFrame:
    """(voxel_id) of (block_id, bit): the inverse of block_bits; padding outside the grid is left out."""
    gx, gy, gz = grid.dims
    bx, by, _ = grid.blocks(size)
    at = bits.select(
        F.expr(f"block_id % {bx} * {size} + bit % {size}").alias("x"),
        F.expr(f"block_id div {bx} % {by} * {size} + bit div {size} % {size}").alias("y"),
        F.expr(f"block_id div {bx * by} * {size} + bit div {size * size}").alias("z"),
    )
    return at.where(f"x < {gx} and y < {gy} and z < {gz}").select(F.expr(f"z * {gx * gy} + y * {gx} + x").alias("voxel_id"))

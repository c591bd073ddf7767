"""Indices to bytes and back, as column expressions.

Rows of bytes are made in chunks of a fixed number of indices, in block order, so that no row grows with the
data; the chunks one after another are the whole buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Indices of a chunk: a multiple of 8, so that chunks end on whole bytes at any width.
CHUNK = 4096


def bit_width(max_index: Column) -> Column:
    """Bits of the largest index: at least 1, at most 32."""
    return F.least(F.lit(32), F.greatest(F.lit(1), F.length(F.bin(max_index))))


def bit_width_of(max_index: int) -> int:
    return min(32, max(1, max_index.bit_length()))


def to_u32(code: Column) -> Column:
    """The low 32 bits."""
    return code.bitwiseAND(F.lit(0xFFFFFFFF))


def little_endian_hex(code: Column, width: int) -> Column:
    """The bytes of an unsigned index, lowest first, as hex; width: 8, 16, 32 or 64 bits."""
    if width not in (8, 16, 32, 64):
        return F.lit("")
    digits = F.lpad(F.hex(code), width // 4, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(width // 8 - 1, -1, -1)])


def _in_order(rows: DataFrame, key: str, at: str, text: str) -> DataFrame:
    """The texts of a key's rows joined in order of `at`."""
    parts = F.array_sort(F.collect_list(F.struct(at, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "").alias("hex"))


def pack_fixed(dense: DataFrame, width: int, chunk: int = CHUNK) -> DataFrame:
    """(block_id, code) of every block -> (chunk, data): whole bytes an index, little-endian. Other widths give no bytes."""
    rows = dense.select(F.expr(f"block_id div {chunk}").alias("chunk"), "block_id", little_endian_hex(F.col("code"), width).alias("h"))
    return _in_order(rows, "chunk", "block_id", "h").select("chunk", F.unhex("hex").alias("data"))


def unpack_fixed(packed: DataFrame, width: int, chunk: int = CHUNK) -> DataFrame:
    """(chunk, data) -> (block_id, code), the low 32 bits of each index."""
    n = width // 4
    each = packed.select("chunk", F.posexplode(F.regexp_extract_all(F.hex("data"), F.lit("." * n), F.lit(0))).alias("k", "h"))
    big = F.concat(*[F.substring("h", 2 * i + 1, 2) for i in range(min(width // 8, 4) - 1, -1, -1)])
    return each.select(F.expr(f"chunk * {chunk} + k").alias("block_id"), F.conv(big, 16, 10).cast("long").alias("code"))


def pack_bits(dense: DataFrame, width: int, chunk: int = CHUNK) -> DataFrame:
    """(block_id, code) of every block -> (chunk, data): bit b of index i is bit i * width + b, lowest first.

    Eight indices fill `width` bytes: their bits, lowest first, are one text that is cut into bytes.
    """
    if not 1 <= width <= 32:
        raise ValueError("a width is from 1 to 32 bits")
    bits = F.reverse(F.lpad(F.bin("code"), width, "0"))
    eights = dense.select(F.expr("block_id div 8").alias("eight"), "block_id", bits.alias("h"))
    eights = _in_order(eights, "eight", "block_id", "h")
    full = F.rpad("hex", 8 * width, "0")
    octets = F.transform(F.regexp_extract_all(full, F.lit("........"), F.lit(0)), lambda b: F.lpad(F.conv(F.reverse(b), 2, 16), 2, "0"))
    kept = F.slice(octets, F.lit(1), F.ceil(F.length("hex") / 8).cast("int"))
    rows = eights.select(F.expr(f"eight * 8 div {chunk}").alias("chunk"), "eight", F.array_join(kept, "").alias("h"))
    return _in_order(rows, "chunk", "eight", "h").select("chunk", F.unhex("hex").alias("data"))


def unpack_bits(packed: DataFrame, width: int, count: int, chunk: int = CHUNK) -> DataFrame:
    """(chunk, data) -> (block_id, code) of `count` indices: the inverse of pack_bits."""
    octets = F.transform(F.regexp_extract_all(F.hex("data"), F.lit(".."), F.lit(0)), lambda h: F.reverse(F.lpad(F.conv(h, 16, 2), 8, "0")))
    codes = F.regexp_extract_all(F.array_join(octets, ""), F.lit("." * width), F.lit(0))
    each = packed.select("chunk", F.posexplode(codes).alias("k", "b")).select(F.expr(f"chunk * {chunk} + k").alias("block_id"), F.conv(F.reverse("b"), 2, 10).cast("long").alias("code"))
    return each.where(F.col("block_id") < count)


def packed_bytes(count: int, width: int) -> int:
    return (count * width + 7) // 8


def encoding_saving(count: Column, max_index: Column) -> Column:
    """Bytes that one-byte indices save over two-byte ones: one an index if all fit."""
    return F.when(max_index < 256, count).otherwise(F.lit(0)).cast("long")


def flattened(patterns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(code, pattern) -> (chunk, data): patterns in code order, so many a chunk."""
    rows = patterns.select(F.expr(f"code div {chunk}").alias("chunk"), "code", F.hex("pattern").alias("h"))
    return _in_order(rows, "chunk", "code", "h").select("chunk", F.unhex("hex").alias("data"))


def occupancy_rows(voxels: DataFrame, gx: int, gy: int, gz: int) -> DataFrame:
    """(row_id, mask): the dense 0/1 mask, a row of the grid along x each, in voxel order. Only for sinks."""
    rows = voxels.sparkSession.range(gy * gz).withColumnRenamed("id", "row_id")
    filled = voxels.groupBy(F.expr(f"voxel_id div {gx}").alias("row_id")).agg(F.sort_array(F.collect_set(F.expr(f"cast(voxel_id % {gx} as int)"))).alias("xs"))
    before = lambda i: F.coalesce(F.get("xs", i - 1), F.lit(-1))
    runs = F.transform("xs", lambda x, i: F.concat(F.repeat(F.lit("00"), x - before(i) - 1), F.lit("01")))
    return rows.join(filled, "row_id", "left").select("row_id", F.unhex(F.rpad(F.coalesce(F.array_join(runs, ""), F.lit("")), 2 * gx, "0")).alias("mask"))


def words(voxels: DataFrame) -> DataFrame:
    """(word_id, word): a bit set of 64-bit words over voxel ids, words without a bit left out."""
    return voxels.groupBy(F.expr("voxel_id div 64").alias("word_id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(voxel_id % 64 as int))")).alias("word"))


def popcount(bitset: DataFrame) -> DataFrame:
    """One row: the number of bits set."""
    return bitset.agg(F.coalesce(F.sum(F.bit_count("word").cast("long")), F.lit(0)).alias("occupied"))


def probe_bits(bitset: DataFrame, ids: DataFrame) -> DataFrame:
    """(voxel_id, is_set) for each id asked for."""
    asked = ids.withColumn("word_id", F.expr("voxel_id div 64"))
    return asked.join(bitset, "word_id", "left").select("voxel_id", F.coalesce(F.expr("shiftright(word, cast(voxel_id % 64 as int)) & 1 = 1"), F.lit(False)).alias("is_set"))

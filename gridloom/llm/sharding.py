"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import running_offsets, written


@dataclass(frozen=True)
class Tree:
    """shards: (region, rack, shard, weight). A rack's name is unique within its region, a shard's overall.

    A node's weight is the sum of the weights below it.
    """

    shards: tuple[tuple[int, int, int, float], ...]

    def __post_init__(self):
        if not self.shards or any(w <= 0 for *_, w in self.shards) or len({s for _, _, s, _ in self.shards}) < len(self.shards):
            raise ValueError("a tree needs shards, of distinct names and weights above 0")

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own.

        No other node's weight changes, so the only draws that can change their winner are those
        that the new region wins: rows move into the new shard and nowhere else.
        """
        return Tree((*self.shards, (max(r for r, *_ in self.shards) + 1, 0, max(s for _, _, s, _ in self.shards) + 1, weight)))


def even_tree(shards: int, racks: int = 2, shards_per_rack: int = 4, base: int = 16) -> Tree:
    """The tree that a shard count alone decides.

    Up to `base` shards fill racks and regions in order; each further one is a region of its own,
    so that from base on the tree of n + 1 shards is the tree of n shards, grown.
    """
    full = tuple((s // (racks * shards_per_rack), s // shards_per_rack % racks, s, 1.0) for s in range(min(shards, base)))
    tree = Tree(full)
    for _ in range(shards - base):
        tree = tree.grown()
    return tree


def _draw(key: Column, nodes: list[tuple[tuple[int, ...], int, float]]) -> Column:
    """The name of the node that wins: the highest ln(u) / weight, u a hash of key and the node's path.

    Changing one node's weight changes that node's draw alone, so rows move only from or to it.
    """
    if len(nodes) == 1:
        return F.lit(nodes[0][1])
    draws = []
    for path, name, weight in nodes:
        u = (F.shiftrightunsigned(F.xxhash64(key, *[F.lit(p) for p in (len(path), *path)]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((F.ln(u) / F.lit(weight)).alias("d"), F.lit(name).alias("n")))
    return F.array_max(F.array(*draws))["n"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key: one draw a level. Null keys are one key as any other."""
    regions: dict = {}
    for region, rack, shard, w in tree.shards:
        regions.setdefault(region, {}).setdefault(rack, []).append((shard, w))
    total = lambda racks: sum(w for shards in racks.values() for _, w in shards)
    top, out = _draw(key, [((r,), r, total(x)) for r, x in regions.items()]), None
    for r, racks in regions.items():
        middle, inner = _draw(key, [((r, k), k, sum(w for _, w in s)) for k, s in racks.items()]), None
        for k, shards in racks.items():
            leaf = _draw(key, [((r, k, s), s, w) for s, w in shards])
            inner = leaf if inner is None else F.when(middle == k, leaf).otherwise(inner)
        out = inner if out is None else F.when(top == r, inner).otherwise(out)
    return out


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document's shard under the law `key`, its slot there, and its shard were there one more.

    Columns: doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard.
    Null texts have no bytes (size 1, crc32 0); rows with a null doc_id all fall into one shard; repeated
    rows each get a slot; an empty table gives no rows; other columns are ignored. Slots run without
    gaps in an order by hash of (doc_id, crc32, size); the text is read once and never shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    narrow = written(narrow, "shard")
    tree = even_tree(shards)
    key = F.col("doc_id")
    placed = narrow.withColumns({"shard": shard_of(key, tree).cast("int"), "grown_shard": shard_of(key, even_tree(shards + 1)).cast("int")})
    placed = running_offsets(placed, "shard", ["doc_id", "text_crc32", "size"], F.lit(1), "slot", narrow.count())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")

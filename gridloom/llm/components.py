"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop, written


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): the lowest of u and its neighbours. Summed before the shuffle, so a hub costs a row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _star(edges: DataFrame) -> DataFrame:
    """One round of both steps (Kiveris et al. 2014) over edges (u, v).

    In the first, a hub meets all its neighbours: its lowest are written out, so that the join has an
    exchange of its own on each side, of which Spark can split a hub's. In the second, a node
    meets only lower ones, few by then.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = written(_lowest(both), "lowest")
    large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = small.join(_lowest(small), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()


#: Edges, of 16 bytes each, that the driver takes at most.
FEW = 1 << 15


def _solved(edges: pa.Table) -> pa.Table:
    """(node, root) of a table of few edges."""
    parent: dict[int, int] = {}

    def root(i):
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = i = parent[up]
        return i

    for u, v in zip(*(edges.column(c).to_pylist() for c in ("u", "v"))):
        x, y = root(u), root(v)
        parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return pa.table([pa.array(nodes, pa.int64()), pa.array([root(i) for i in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): the lowest node of its component, for each node of an edge.

    Every round is written to the shared folder; the number of rounds grows with the logarithm of the
    components' sizes. What has no more than FEW edges is solved on the driver, without rounds. Loops, repeated
    edges and an empty table are allowed; null ends are left out.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    if now.count() <= FEW:
        found = now.toArrow()
        drop(now)
        return written(edges.sparkSession.createDataFrame(_solved(found)).repartition(1), "roots")
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == state or not mark[0]:
            break
        state, last = mark, now
        now = written(_star(last), "edges")
        drop(last)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())

"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists, in blocks."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ship, written

#: Rows of a block of candidates and of one of queries: what one task holds at a time.
CANDIDATES, QUERIES = 32768, 8192
#: A small table is cut into more blocks, so that all cores have some, but none below this.
LEAST = 2048
#: The lists are gone down 1, 4, 16, ... entries deep.
GROWTH = 4
#: Vectors with components beyond LIMIT are scored in whole numbers of any size, others in 64 bits.
LIMIT = 1 << 26
#: Scores stop here.
MOST = (1 << 63) - 1


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, within +-LIMIT."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(scale)), F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))


def wide(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double, for vectors that have some beyond +-LIMIT; null for others."""
    most = F.lit(sys.float_info.max)
    exact = F.transform(vector, lambda x: F.least(F.greatest(x.cast("double") * F.lit(float(scale)), -most), most))
    whole = F.transform(exact, lambda y: F.when(F.abs(y) < F.lit(float(1 << 53)), F.floor(y).cast("double")).otherwise(y))
    return F.when(F.exists(whole, lambda y: F.abs(y) > F.lit(float(LIMIT))), whole)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _matrix(vectors: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """Rows padded with zeros to one width."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Lists:
    """A block of candidates: its distinct vectors, the smallest k + 1 ids of each, and a sorted list for each dimension.

    Rows that repeat an id are candidates of their own; copies says how often a row stands there.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, copies: np.ndarray | None = None):
        self.rows, of = np.unique(rows, axis=0, return_inverse=True) if rows.shape[1] else (rows[:1], np.zeros(len(ids), int))
        of, copies = of.reshape(-1), np.ones(len(ids), int) if copies is None else np.minimum(copies, k + 1)
        of, ids = np.repeat(of, copies), np.repeat(ids, copies)
        order = np.lexsort((ids, of))
        of, ids = of[order], ids[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        near = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) <= k
        self.ids, of = ids[near], of[near]
        self.begin = np.searchsorted(of, np.arange(len(self.rows) + 1))
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.rows, self.order, axis=0)
        self.place = None

    def own(self, query_ids: np.ndarray, queries: np.ndarray) -> list[int]:
        """The vector of this block that each query is itself, or -1."""
        if self.place is None:
            self.place = {r.tobytes(): i for i, r in enumerate(self.rows)}
        return [self.place.get(q.tobytes(), -1) for q in np.ascontiguousarray(queries, self.rows.dtype)]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        """(query number, id, score) of each query's k best here, ties to smaller ids; its own row left out.

        Sorted access goes down the lists of all dimensions that a query has, from the end that its sign
        prefers, in rounds of growing depth; what is met is scored in full. Before each round a query stops
        if no row not met can beat the kth result: if the bound, the product with the values where its
        lists stand, is below its kth best score, here or (floors) elsewhere. A round that would name
        half of the rows goes down to the lists' ends, where all rows are met. Below its floor a query
        needs no results.
        """
        most = int(np.abs(self.rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        x, q, n = self.rows.astype(kind), queries.astype(kind), len(self.rows)
        uses, own = np.maximum(1, np.count_nonzero(queries, axis=1)), self.own(query_ids, queries)
        lowest = np.iinfo(np.int64).min
        floors = np.full(len(q), lowest) if floors is None else floors
        found, last, active, depth = {}, [], np.arange(len(q)), 0
        while len(active) and n:
            high, low = self.values[n - 1 - depth], self.values[depth]
            bound = np.maximum(queries[active], 0) @ high + np.minimum(queries[active], 0) @ low
            kth = np.array([max(floors[i], found[i][-1][1] if len(found.get(i, ())) == k else lowest) for i in active], np.int64)
            active = active[bound >= kth]
            depth = max(1, GROWTH * depth)
            ends = 2 * depth * uses[active] >= n
            last, active = last + active[ends].tolist(), active[~ends]
            for i in active:
                up, down = queries[i] > 0, queries[i] < 0
                met = np.unique(np.concatenate([self.order[n - depth :, up].reshape(-1), self.order[:depth, down].reshape(-1)]))
                found[i] = self.best(query_ids[i], own[i], met, x[met] @ q[i], k)
        every = np.arange(n)
        for part in range(0, len(last), 64):
            rest = last[part : part + 64]
            for i, scores in zip(rest, q[rest] @ x.T):
                found[i] = self.best(query_ids[i], own[i], every, scores, k)
        return [(i, d, s) for i, best in sorted(found.items()) for d, s in best if s >= floors[i]]

    def best(self, query_id, own: int, met: np.ndarray, scores: np.ndarray, k: int):
        """The k best of the vectors met, as (id, score), without the query's own row. One of k + 1 vectors at most is that row alone."""
        if len(scores) > k + 1:
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            at = scores >= least
            met, scores = met[at], scores[at]
        size = self.begin[met + 1] - self.begin[met]
        place = np.repeat(self.begin[met] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ids, scores = self.ids[place], np.repeat(scores, size).astype(np.int64)
        itself = np.flatnonzero((ids == query_id) & (np.repeat(met, size) == own))[:1]
        ids, scores = np.delete(ids, itself), np.delete(scores, itself)
        order = np.lexsort((ids, -scores))[:k]
        return list(zip(ids[order].tolist(), scores[order].tolist()))


def _search(ids, rows, copies, query_ids, queries, floors, k: int):
    """What Lists finds, as (query number, id, score), whatever the vectors' size."""
    limit = min(LIMIT, math.isqrt(MOST // max(1, rows.shape[1])))
    over, asked = (np.abs(x).max(axis=1, initial=0) > limit for x in (rows, queries))
    out = []
    if not over.all() and not asked.all():
        number = np.flatnonzero(~asked)
        lists = Lists(ids[~over], rows[~over].astype(np.int64), k, copies[~over])
        out = [(int(number[i]), d, s) for i, d, s in lists.search(query_ids[number], queries[number].astype(np.int64), k, floors[number])]
    if over.any() or asked.any():
        exact = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
        large, every = exact(rows[over]), exact(rows if asked.any() else rows[:0])
        for i, (own, q, is_over) in enumerate(zip(query_ids.tolist(), exact(queries), asked)):
            among, x, times = (ids, every, copies) if is_over else (ids[over], large, copies[over])
            itself = (among == own) & (x == q).all(axis=1).astype(bool)
            scored = [(max(-MOST, min(MOST, s)), d) for s, d, m, o in zip((x @ q).tolist(), among.tolist(), times.tolist(), itself.tolist()) for _ in range(min(m, k + 1) - o)]
            out += [(i, d, s) for s, d in sorted(scored, key=lambda c: (-c[0], c[1]))[:k] if s >= floors[i]]
    return out


def _blocks(rows: int, most: int, tasks: int) -> int:
    return max(1, -(-rows // most), min(tasks, rows // LEAST))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product with each query.

    vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by `every`; candidates are all
    rows but the query's own; ties go to the smaller vec_id. Rows with a null vec_id, and vectors that are
    null or hold null or non-finite components, take no part; shorter vectors count as zero beyond
    their end. Rows that repeat a vec_id are rows of their own, as queries (each has its k results) and as
    candidates; scores beyond 64 bits count as +-MOST, and tie there. Vectors of any length are read
    whole. An empty table gives no rows; other columns are ignored.

    Equal rows are counted once. Rows are dealt into blocks of bounded size by a hash of id and vector. Each
    query first goes to one block, its home; its kth score there is its floor in all other blocks, which give
    only what reaches it. The query set meets every block, a pair of blocks a task, so rows move as often as
    the other side has blocks.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", scaled(F.col("embedding"), scale).alias("v"), wide(F.col("embedding"), scale).alias("wide"))
    rows = rows.groupBy("vec_id", "v", "wide").agg(F.count("*").alias("copies"))
    rows = written(rows.withColumn("number", F.monotonically_increasing_id()), "topk-rows")
    n = rows.agg(F.count("*").alias("rows"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries")).first()
    tasks = spark.sparkContext.defaultParallelism
    blocks = _blocks(n.rows, CANDIDATES, tasks)
    groups = _blocks(n.queries, QUERIES, max(1, tasks // blocks))
    deal = lambda parts, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    columns = ["query", "number", "vec_id", "v", "wide", "copies", "floor"]
    lowest = F.lit(-MOST - 1)
    candidates = rows.withColumns({"query": F.lit(0), "floor": lowest})
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("query", F.lit(1))
    schema = pa.schema([("number", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_query = table.column("query").to_numpy() == 1
        if is_query.all() or not is_query.any():
            return schema.empty_table()
        lists = table.column("v").chunk(0)
        width = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
        matrix = _matrix(lists, width)
        large = np.asarray(table.column("wide").is_valid())
        if large.any():
            matrix = matrix.astype(float)
            matrix[large] = _matrix(table.column("wide").combine_chunks().drop_null(), width, float)
        ids, copies, number, floors = (table.column(c).to_numpy() for c in ("vec_id", "copies", "number", "floor"))
        got = _search(ids[~is_query], matrix[~is_query], copies[~is_query], ids[is_query], matrix[is_query], floors[is_query], k)
        return pa.table([pa.array(number[is_query][[i for i, *_ in got]], pa.int64()), pa.array([d for _, d, _ in got], pa.int64()), pa.array([s for *_, s in got], pa.int64())], schema=schema)

    def searched(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        both = candidates.select("block", "part", *columns).unionAll(queries.select("block", "part", *columns))
        return both.groupBy("block", "part").applyInArrow(search, "number long, vec_id long, score long")

    home = deal(blocks, 3)
    own = written(searched(candidates.withColumns({"block": deal(blocks, 1), "part": F.lit(0)}), queries.withColumns({"block": home, "part": F.lit(0), "floor": lowest})), "topk-home")
    floors = own.groupBy("number").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(lowest).alias("floor"))
    asked = queries.join(floors, "number", "left").withColumn("floor", F.coalesce("floor", lowest))
    others = asked.withColumns({"block": each(blocks), "part": deal(groups, 2)}).where(F.col("block") != home)
    found = own.unionAll(searched(candidates.withColumns({"block": deal(blocks, 1), "part": each(groups)}), others))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    named = queries.select("number", F.col("vec_id").alias("query_id"), "copies")
    out = found.join(named, "number").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

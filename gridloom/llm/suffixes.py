"""Suffix array and longest common prefixes of many sequences, by distributed prefix doubling.

A suffix is a row; g numbers the symbols of all sequences in text order. A sequence (seg, ids) is named by the g of
its first symbol and ends there: no common prefix goes beyond an end. Every table is sorted in ranges of
bounded size whose last key is unique, so that no group of equal suffixes, however large, falls into one task.
What goes from one range to the next is a few numbers a range, summed up by the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import drop, written

#: Rows of a range, about.
ROWS = 200_000
FAR = 1 << 31


def ranges(df: DataFrame, rows: int) -> int:
    """A range for each core if the rows suffice, and more if they are many."""
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, rows // 1000), -(-rows // ROWS))


def _columns(batches, names=None):
    """All columns of a partition, of bounded size, as arrays; None for an empty one."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return None
    table = pa.Table.from_batches(batches)
    return {c: table.column(c).to_numpy() for c in names or table.column_names}


def _starts(new: np.ndarray) -> np.ndarray:
    """For each row, the place of the last row before it, or itself, that begins a group."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _indexed(batches):
    """Rows of a range sorted by x, y: their place k, that of the first of their (x, y) and of their x, whether they are alone, whether they end the range."""
    c = _columns(batches)
    if c is None:
        return
    x, y, n = c["x"], c["y"], len(c["x"])
    new_x = np.append(True, x[1:] != x[:-1])
    new = new_x | np.append(True, y[1:] != y[:-1])
    k = np.arange(n)
    more = {"part": np.full(n, TaskContext.get().partitionId(), np.int32), "k": k, "s": _starts(new), "q": _starts(new_x), "alone": new & np.append(new[1:], True), "edge": (k == 0) | (k == n - 1)}
    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in (c | more).items()})


def grouped(df: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (x, y, g, ...) in the order of x, y, g, and the table read, to be dropped: adds `first`, the number of
    rows below their (x, y); `above`, how many of these have their x; `alone`, whether no other row has their (x, y)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "part int, k long, s long, q long, alone boolean, edge boolean"])
    parts = ranges(df, rows)
    table = written(df.repartitionByRange(parts, "x", "y", "g").sortWithinPartitions("x", "y", "g").mapInArrow(_indexed, schema), "suffix-order")
    ends: dict[int, list] = {}
    for r in table.where("edge").select("part", "k", "x", "y", "s", "q").collect():
        ends.setdefault(r.part, []).append(r)
    fixes, base, last = [], 0, None
    for part in sorted(ends):
        head, tail = min(ends[part], key=lambda r: r.k), max(ends[part], key=lambda r: r.k)
        same = last is not None and (last[0], last[1]) == (head.x, head.y)
        s0, q0 = last[2] if same else base, last[3] if last is not None and last[0] == head.x else base
        if same:
            fixes[-1][-1] = True
        fixes.append([part, base, s0, q0, tail.s, same, False])
        last = tail.x, tail.y, s0 if tail.s == 0 else base + tail.s, q0 if tail.q == 0 else base + tail.q
        base += tail.k + 1
    fix = df.sparkSession.createDataFrame([tuple(f) for f in fixes], "part int, _base long, _s0 long, _q0 long, _tail long, _before boolean, _after boolean")
    out = table.join(fix, "part")
    first = F.when(F.col("s") == 0, F.col("_s0")).otherwise(F.col("_base") + F.col("s"))
    top = F.when(F.col("q") == 0, F.col("_q0")).otherwise(F.col("_base") + F.col("q"))
    alone = F.col("alone") & ~(F.col("_before") & (F.col("s") == 0)) & ~(F.col("_after") & (F.col("s") == F.col("_tail")))
    return out.select(*df.columns, first.alias("first"), (first - top).alias("above"), alone.alias("alone")), table


def _pairs(step: int):
    """Rows of whole sequences in text order -> kind 0 for those of sequences that are done, 1 for suffixes that are, and
    2 for the others, with y, the rank of the suffix `step` symbols on, or -1 beyond the end."""

    def find(batches):
        c = _columns(batches)
        if c is None:
            return
        n, seg = len(c["g"]), c["seg"]
        begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        live = np.repeat(np.add.reduceat(c["open"], begin) > 0, np.diff(np.append(begin, n)))
        at = np.arange(n) + step
        there = c["rest"] > step
        c["y"] = np.where(there, c["r"][np.where(there, at, 0)], -1)
        c["kind"] = np.where(c["open"], 2, live.astype(int)).astype(np.int32)
        c["x"] = c.pop("r")
        c.pop("open")
        yield pa.RecordBatch.from_pydict({k: pa.array(c[k]) for k in ("seg", "g", "rest", "x", "y", "sep", "kind")})

    return find


def ranked(sequences: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Sequences (seg, ids) -> a row a suffix: seg, g, rest (symbols to the end), r, sep; and the tables read.

    ids are the symbols' ranks as grouped() gives them: from one symbol to the next by as many at least as it stands.
    Ranks r of the suffixes by their first 1, 2, 4, ... symbols: each round sorts the pairs (rank of the
    suffix, rank of the one as far on as the ranks reach) and writes the order to the shared folder. Equal
    ranks mean equal prefixes. A suffix is done when no other has its rank, or when the prefix reaches its
    end; a sequence is when its suffixes are, and takes no part in later rounds. sep is the reach of the round
    that told the group of a rank from the one before it: their common prefix has sep symbols at least
    and fewer than 2 sep (0: none).
    """
    base = sequences.select("seg", F.posexplode("ids"), F.size("ids").alias("n"))
    rows = base.select("seg", (F.col("seg") + F.col("pos")).alias("g"), (F.col("n") - F.col("pos")).alias("rest"), F.col("col").alias("r"), F.lit(0).alias("sep"), F.lit(True).alias("open"))
    schema = "seg long, g long, rest int, x long, y long, sep int, kind int"
    total, step, done, kept = sequences.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0], 1, [], []
    old: list[DataFrame] = []
    while total:
        by_seg = rows.repartition(ranges(rows, total), "seg").sortWithinPartitions("seg", "g")
        pairs = written(by_seg.mapInArrow(_pairs(step), schema), "suffix-pairs")
        drop(*old)
        kept.append(pairs)
        n = pairs.agg(F.count(F.when(F.col("kind") == 2, 1)), F.count(F.when(F.col("kind") > 0, 1))).first()
        done.append(pairs.where("kind = 0"))
        if not n[0]:
            break
        order, table = grouped(pairs.where("kind = 2").select("x", "y", "g", "seg", "rest", "sep"), n[0])
        old, total = [table], n[1]
        new = order.select("seg", "g", "rest", (F.col("x") + F.col("above")).alias("r"), F.when(F.col("above") == 0, F.col("sep")).otherwise(step).alias("sep"), (~F.col("alone") & (F.col("rest") >= 2 * step)).alias("open"))
        rows = pairs.where("kind = 1").select("seg", "g", "rest", F.col("x").alias("r"), "sep", F.lit(False).alias("open")).unionAll(new)
        step *= 2
    if not done:
        return rows.drop("open"), kept
    return reduce(DataFrame.unionAll, done).select("seg", "g", "rest", F.col("x").alias("r"), "sep"), kept


def _neighbours(batches):
    """Rows of a range in suffix order -> with the suffix before each."""
    c = _columns(batches)
    if c is None:
        return
    n = len(c["g"])
    k = np.arange(n)
    shift = lambda a: pa.array(np.append(0, a[:-1]), mask=k == 0)
    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in c.items()} | {"part": pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), "k": pa.array(k), "before_g": shift(c["g"]), "before_seg": shift(c["seg"]), "before_r": shift(c["r"]), "edge": pa.array((k == 0) | (k == n - 1))})


def suffix_array(sequences: DataFrame) -> tuple[DataFrame, int]:
    """(s, g, seg, lcp) of every suffix, a table, and their number: its place s in the suffix array, ties by g, and the length of
    the prefix it shares with the suffix at s - 1 (0 for the first).

    A common prefix is compared symbol by symbol, between sep and 2 sep symbols on, only where it doesn't
    follow from the suffix one symbol earlier: where that one's neighbour stood one symbol earlier too, it
    is one shorter. So what is compared is n log n symbols at most, however long the copies are.
    """
    found, kept = ranked(sequences)
    total = sequences.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    schema = "seg long, g long, rest int, r long, sep int, part int, k long, before_g long, before_seg long, before_r long, edge boolean"
    parts = ranges(found, total)
    order = written(found.repartitionByRange(parts, "r", "g").sortWithinPartitions("r", "g").mapInArrow(_neighbours, schema), "suffix-neighbours")
    drop(*kept)
    ends: dict[int, list] = {}
    for r in order.where("edge").select("part", "k", "g", "seg", "r").collect():
        ends.setdefault(r.part, []).append(r)
    fixes, base, last = [], 0, (None, None, None)
    for part in sorted(ends):
        tail = max(ends[part], key=lambda r: r.k)
        fixes.append((part, base, *last))
        base, last = base + tail.k + 1, (tail.g, tail.seg, tail.r)
    fix = sequences.sparkSession.createDataFrame(fixes, "part int, _base long, _g long, _seg long, _r long")
    rows = order.join(fix, "part")
    rows = rows.select((F.col("_base") + F.col("k")).alias("s"), "seg", "g", "rest", "sep", "r", *[F.coalesce(f"before_{c}", f"_{c}").alias(f"before_{c}") for c in ("g", "seg", "r")])
    tie = F.coalesce(F.col("r") == F.col("before_r"), F.lit(False))
    rows = rows.withColumns({"tie": tie, "linked": tie | (F.col("sep") > 0)})
    text = Window.partitionBy("seg").orderBy("g")
    follows = F.lag("linked").over(text) & (F.lag("before_seg").over(text) == F.col("before_seg")) & (F.lag("before_g").over(text) + 1 == F.col("before_g"))
    lcp = F.when(F.coalesce(follows, F.lit(False)), F.lit(None)).when(F.col("tie"), F.col("rest")).when(~F.col("linked"), 0).otherwise(-1)
    rows = written(rows.withColumn("lcp", lcp).select("s", "seg", "g", "sep", "before_g", "before_seg", "lcp"), "suffix-text")
    drop(order)

    def at(name: str, column: Column, seg: Column) -> Column:
        return F.slice(name, (column - seg + F.col("sep") + 1).cast("int"), F.col("sep"))

    asked = rows.where("lcp = -1")
    own = sequences.select(F.col("seg").alias("_own"), F.col("ids").alias("_ids")).hint("merge")
    other = sequences.select(F.col("seg").alias("_other"), F.col("ids").alias("_more")).hint("merge")
    asked = asked.join(own, F.col("seg") == F.col("_own")).withColumn("a", at("_ids", F.col("g"), F.col("seg"))).drop("_own", "_ids")
    asked = asked.join(other, F.col("before_seg") == F.col("_other")).withColumn("b", at("_more", F.col("before_g"), F.col("before_seg")))
    differ = F.array_position(F.zip_with("a", "b", lambda p, q: ~p.eqNullSafe(q)), True)
    common = F.when(differ > 0, differ - 1).otherwise(F.greatest(F.size("a"), F.size("b")))
    known = rows.where("lcp is null or lcp >= 0").select("s", "seg", "g", "lcp").unionAll(asked.select("s", "seg", "g", (F.col("sep") + common).cast("int")))
    carried = F.last(F.col("lcp") + F.col("g"), ignorenulls=True).over(text.rowsBetween(Window.unboundedPreceding, 0)) - F.col("g")
    out = written(known.select("s", "seg", "g", carried.cast("int").alias("lcp")), "suffix-array")
    drop(rows)
    return out, total


def _climb(g: list, link: list):
    """For rows in order, each linked to the one before by `link`: the least link back to the nearest row of lower g, or
    None, and the least link to the start; and what is left on the stack, nearest last, as (g, link to the one below)."""
    stack, near, start = [], [], []
    for own, low in zip(g, link):
        while stack and stack[-1][0] > own:
            low = min(low, stack.pop()[1])
        near.append(low if stack else None)
        start.append(low if not stack else 0)
        stack.append((own, low))
    return near, start, stack


def _stairs(stack, low: int):
    """(g, least link from beyond the edge) of the rows that can be the nearest lower one to a row beyond it."""
    out = []
    for g, link in reversed(stack):
        if not low:
            break
        if out and out[-1][1] == low:
            out.pop()
        out.append((g, low))
        low = min(low, link)
    return out


def _joined(near, far, low: int):
    """Stairs seen across a range: those of its own, then those beyond it."""
    out = list(near)
    for g, m in far:
        m = min(m, low)
        if m and (not out or g < out[-1][0]):
            if out and out[-1][1] == m:
                out.pop()
            out.append((g, m))
    return out


def _earlier(batches):
    c = _columns(batches)
    if c is None:
        return
    g, lcp = c["g"].tolist(), c["lcp"].tolist()
    left, from_left, up = _climb(g, lcp)
    right, from_right, down = _climb(g[::-1], [FAR, *lcp[:0:-1]])
    best = [max(a or 0, b or 0) for a, b in zip(left, right[::-1])]
    part, low = TaskContext.get().partitionId(), min(lcp)
    kind = pa.list_(pa.struct([("g", pa.int64()), ("m", pa.int64())]))
    pack = lambda stairs: pa.array([[{"g": g, "m": m} for g, m in stairs]], kind)
    n, none = len(g), pa.nulls(len(g), kind)
    names = ["part", "seg", "g", "run", "from_left", "from_right", "low", "ups", "downs"]
    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(c["seg"]), pa.array(c["g"]), pa.array(best, pa.int64()), pa.array(from_left, pa.int64()), pa.array(from_right[::-1], pa.int64()), pa.nulls(n, pa.int64()), none, none], names)
    null = pa.nulls(1, pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), null, null, null, null, null, pa.array([low]), pack(_stairs(up, FAR)), pack(_stairs(down, lcp[0]))], names)


def earlier_runs(sequences: DataFrame) -> DataFrame:
    """(seg, g, run) of the suffixes that share a prefix with an earlier one: the longest, `run` symbols.

    The LCP intervals that hold a suffix and an earlier one are nested; the innermost reaches to the nearest
    earlier suffix on the left or on the right in the suffix array, and its length is the least LCP on the
    way. A stack finds both within a range. Beyond its edges only the stairs count: going away
    from an edge, for each lower LCP, the earliest suffix; no more than the longest common prefix has symbols.
    """
    array, total = suffix_array(sequences)
    schema = "part int, seg long, g long, run long, from_left long, from_right long, low long, ups array<struct<g: long, m: long>>, downs array<struct<g: long, m: long>>"
    rows = array.repartitionByRange(ranges(array, total), "s").sortWithinPartitions("s").select("seg", "g", "lcp")
    table = written(rows.mapInArrow(_earlier, schema), "suffix-runs")
    drop(array)
    ends = sorted((r.part, r.low, [tuple(x) for x in r.ups], [tuple(x) for x in r.downs]) for r in table.where("g is null").select("part", "low", "ups", "downs").collect())
    before, after, stairs = {}, {}, []
    for part, low, ups, _ in ends:
        before[part] = stairs
        stairs = _joined(ups, stairs, low)
    stairs = []
    for part, low, _, downs in reversed(ends):
        after[part] = stairs
        stairs = _joined(downs, stairs, low)
    pair = "array<struct<g: long, m: long>>"
    fix = sequences.sparkSession.createDataFrame([(p, before[p], after[p]) for p, *_ in ends], f"part int, _before {pair}, _after {pair}")
    reach = lambda stairs, low: F.least(F.coalesce(F.array_max(F.transform(F.filter(stairs, lambda x: x["g"] < F.col("g")), lambda x: x["m"])), F.lit(0)), F.col(low))
    out = table.where("g is not null").join(fix, "part")
    return out.select("seg", "g", F.greatest("run", reach("_before", "from_left"), reach("_after", "from_right")).alias("run")).where("run > 0")

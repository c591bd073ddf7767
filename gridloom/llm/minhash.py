"""MinHash near-duplicates: a multi-index Hamming join of signatures, links confirmed on full shingle sets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.bpe import by_size
from gridloom.llm.common import drop, held_by, ship, written
from gridloom.llm.components import components
from gridloom.llm.fingerprints import _GOLD, _mix

#: A signature has CHUNKS chunks of 4 symbols of 16 bits; a chunk is a long.
CHUNKS = 8
SYMBOLS = 4 * CHUNKS
#: Two signatures that differ in at most so many symbols have a chunk in which at most one differs.
DISTANCE = 2 * CHUNKS - 1
_FACTORS = _mix(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Documents are linked if 100 * intersection >= percent * union of their sets of `words`-word shingles."""

    words: int = 5
    percent: int = 80


class _Hashes(dict):
    def __missing__(self, word):
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(texts: list[str], words: int):
    """Distinct shingle hashes of texts, sorted within each -> (hashes, number of each text).

    Words are runs of other than space and \\x09-\\x0D, A-Z lower-cased: just what bytes.lower and bytes.split
    do in UTF-8. A text of fewer words has them all as its one shingle, a text of none has none.
    """
    known = held_by("shingles").setdefault("words", _Hashes())
    if len(known) > 300_000:
        known.clear()
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, n.sum())
    end = np.cumsum(n)
    size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(texts)), size)
    start = np.repeat(end - n - (np.cumsum(size) - size), size) + np.arange(size.sum())
    length = np.minimum(n, words)[of]
    total, padded = length.astype(np.uint64), np.append(h, np.zeros(words, np.uint64))
    for k in range(words):
        total = total + np.where(k < length, _mix(padded[start + k] + np.uint64((k + 1) * int(_GOLD) % 2**64)), np.uint64(0))
    total = _mix(total)
    order = np.lexsort((total, of))
    total, of = total[order], of[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
    return total[new], np.bincount(of[new], minlength=len(texts))


def _marks(hashes, n):
    """Two 64-bit sums that name each set; 0 for empty ones."""
    at, some = (np.cumsum(n) - n)[n > 0], n > 0
    out = np.zeros((len(n), 2), np.uint64)
    if some.any():
        out[some, 0] = _mix(np.add.reduceat(_mix(hashes), at) + n[some].astype(np.uint64))
        out[some, 1] = np.add.reduceat(_mix(hashes ^ _GOLD), at)
    return out.view(np.int64)


def _signatures(hashes, n):
    """(texts, CHUNKS) longs: 16 bits of the lowest hash under each of SYMBOLS hash functions."""
    at, some = (np.cumsum(n) - n)[n > 0], n > 0
    out = np.zeros((len(n), SYMBOLS), np.uint16)
    if some.any():
        for k in range(SYMBOLS):
            lowest = np.minimum.reduceat(hashes * _FACTORS[2 * k] + _FACTORS[2 * k + 1], at)
            out[some, k] = _mix(lowest) >> np.uint64(48)
    return out.view(np.int64)


SIGNED = "doc_id long, n long, a long, b long, " + ", ".join(f"s{k} long" for k in range(CHUNKS))


def signed(docs: DataFrame, words: int, *more: str) -> DataFrame:
    """doc_id, number of shingles, name (a, b) of the shingle set and signature of every whole text; columns `more`, longs, go along."""
    schema = ", ".join([SIGNED, *(f"{c} long" for c in more)])

    def sign(batches):
        for batch in batches:
            ids, at = batch.column(0), 0
            for run in by_size(t or "" for t in batch.column(1).to_pylist()):
                hashes, n = shingles(run, words)
                marks, sig = _marks(hashes, n), _signatures(hashes, n)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(run)), pa.array(n), pa.array(marks[:, 0]), pa.array(marks[:, 1]), *(pa.array(sig[:, k]) for k in range(CHUNKS)), *(batch.column(2 + k).slice(at, len(run)) for k in range(len(more)))], names=[x.split()[0] for x in schema.split(", ")])
                at += len(run)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(sign, schema)


def _keys() -> Column:
    """For each chunk and each of its symbols, a hash of the chunk without that symbol: all ways to differ in one at most."""
    masks = [~(0xFFFF << 16 * j) & (1 << 64) - 1 for j in range(4)]
    return F.array(*[F.xxhash64(F.lit(4 * k + j), F.col(f"s{k}").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k in range(CHUNKS) for j, m in enumerate(masks)])


def _whole_groups(batches, first: int):
    """Runs of rows that agree in the columns from `first` on, from batches sorted by them, as (columns, starts, ends)."""
    kept = None
    for batch in chain(batches, [None]):
        rows = kept if batch is None else batch if kept is None else pa.concat_batches([kept, batch])
        if rows is None or not rows.num_rows:
            continue
        keys = [rows.column(k).to_numpy(zero_copy_only=False) for k in range(first, rows.num_columns)]
        new = np.ones(rows.num_rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.flatnonzero(new)
        if batch is None:
            yield rows, starts, np.append(starts[1:], rows.num_rows)
        else:
            if len(starts) > 1:
                yield rows.slice(0, starts[-1]), starts[:-1], starts[1:]
            kept = rows.slice(starts[-1])


def _forest(joined: np.ndarray):
    """(member, lowest member) links that connect what a symmetric matrix connects."""
    left = np.ones(len(joined), bool)
    for i in range(len(joined)):
        if left[i]:
            left[i] = False
            edge = joined[i] & left
            while edge.any():
                left &= ~edge
                for j in np.flatnonzero(edge):
                    yield j, i
                edge = joined[edge].any(axis=0) & left


#: Classes of a block: of those that a task compares by signatures, and by full sets.
SIGNATURE_BLOCK, SET_BLOCK = 512, 256


def _own_block(size: str, block: int, *by: str) -> Column:
    return F.pmod(F.xxhash64("node", *by), F.ceil(F.col(size) / block)).cast("long")


def _placed(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows (group, node, comp), each once for every two blocks of its group that must be compared, named lo and hi.

    A component of over half a block has blocks of its own, which are never compared with each other; the others share blocks.
    So a group that is one component costs nothing, and one of a large component and few other rows little more
    than the rows it has. No task holds more than two blocks.
    """
    counts = rows.groupBy(group, "comp").agg(F.count("*").alias("_n")).withColumn("_large", 2 * F.col("_n") > block)
    rest = counts.groupBy(group).agg(F.sum(F.when(~F.col("_large"), F.col("_n"))).alias("_rest"))
    shared = F.pmod(F.xxhash64("comp", F.lit(5)), F.ceil(F.col("_rest") / block)).cast("long")
    own = F.when(F.col("_large"), F.xxhash64("comp", _own_block("_n", block))).otherwise(shared)
    rows = rows.join(counts.join(rest, group), [group, "comp"]).select(group, "node", "comp", F.when(F.col("_large"), F.col("comp")).alias("_of"), own.alias("_own"))
    blocks = rows.select(group, F.col("_of").alias("_theirs"), F.col("_own").alias("_other")).distinct()
    met = rows.join(blocks, group).where(F.col("_of").isNull() | F.col("_theirs").isNull() | (F.col("_of") != F.col("_theirs")))
    return met.select(group, "node", "comp", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"))


def _close(rows: DataFrame, classes: DataFrame, percent: int, more: DataFrame | None = None) -> DataFrame:
    """(node, root): joined up are classes of different components within DISTANCE and of sizes that allow a link.

    rows (node, comp, key, lo, hi): all classes of one (key, lo, hi) are compared; links that connect the close
    ones are kept, not the pairs. more: links (u, v) that join up as well.
    """
    columns = [f"s{k}" for k in range(CHUNKS)]
    rows = rows.join(classes.select("node", "n", *columns), "node").select("node", "n", "comp", *columns, "key", "lo", "hi")

    def compare(batches):
        for table, starts, ends in _whole_groups(batches, 3 + CHUNKS):
            node, n, comp = (table.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            symbols = np.stack([table.column(3 + k).to_numpy(zero_copy_only=False) for k in range(CHUNKS)], axis=1).view(np.uint16)
            u, v = [], []
            for a, b in zip(starts, ends):
                if b - a == 2:
                    if comp[a] != comp[a + 1] and (symbols[a] != symbols[a + 1]).sum() <= DISTANCE and 100 * min(n[a], n[a + 1]) >= percent * max(n[a], n[a + 1]):
                        u.append(node[a])
                        v.append(node[a + 1])
                    continue
                far = np.zeros((b - a, b - a), np.uint8)
                for k in range(SYMBOLS):
                    far += symbols[a:b, k, None] != symbols[None, a:b, k]
                size, of = n[a:b], comp[a:b]
                near = (far <= DISTANCE) & (100 * np.minimum(size[:, None], size) >= percent * np.maximum(size[:, None], size)) & (of[:, None] != of)
                for i, j in _forest(near):
                    u.append(node[a + i])
                    v.append(node[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    links = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(compare, "u long, v long")
    return components(links if more is None else links.unionAll(more))


def _confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """rows (node, comp, hashes, root, lo, hi) -> links (u, v) that connect the linked classes of one (root, lo, hi).

    Pairs of different components are compared on full sets, by products of their membership in the shingles that they share.
    """

    def confirm(batches):
        for table, starts, ends in _whole_groups(batches, 3):
            node, comp = (table.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            u, v = [], []
            for a, b in zip(starts, ends):
                held = [np.frombuffer(table.column(2)[i].as_buffer(), np.uint64) for i in range(a, b)]
                n, of = np.array([len(h) for h in held]), comp[a:b]
                common = _common(held)
                for i, j in _forest((100 * common >= percent * (n[:, None] + n - common)) & (of[:, None] != of)):
                    u.append(node[a + i])
                    v.append(node[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    rows = rows.select("node", "comp", "hashes", "root", "lo", "hi").repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    return written(rows.mapInArrow(confirm, "u long, v long").distinct(), "near-links")


def _sets(docs: DataFrame, who: DataFrame, rule: Rule) -> DataFrame:
    """who with the shingle set of each class, a sorted run of hashes; repeated rows of a document give one set."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(who.select("rep").distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def hashed(batches):
        for batch in batches:
            for run in by_size(t or "" for t in batch.column(1).to_pylist()):
                hashes, n = shingles(run, rule.words)
                marks, ends = _marks(hashes, n), 8 * np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(hashes.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(marks[:, 0]), pa.array(marks[:, 1]), sets], ["a", "b", "hashes"])

    # Joins with texts are by merging at every size: a broadcast would pass its bound somewhere.
    sets = texts.mapInArrow(hashed, "a long, b long, hashes binary").groupBy("a", "b").agg(F.first("hashes").alias("hashes"))
    return who.hint("merge").join(sets, ["a", "b"])


def _links(classes: DataFrame, docs: DataFrame, rule: Rule) -> tuple[DataFrame, list[DataFrame]]:
    """Links (u, v) of classes, confirmed on full sets, that join up all classes that are linked; and the tables read.

    A class goes to the bucket of each of its keys. Each bucket is cut into blocks, those of one block are compared by
    signatures, and the close ones joined up to families; so are all of a bucket of several blocks, so that any two classes
    that are close are of one family. A family of one block is compared on full sets, and that is all. A larger one is cut
    into blocks, to each of which its most central classes are added: those that meet most others in buckets. Copies of a
    text are joined up by the least edited of them, at a cost of twice the family. What is still in different components
    is compared across blocks, first by sketches that rule out only what can't be linked, the rest on full sets: no link is lost.
    """
    keyed = classes.select("node", F.explode(_keys()).alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1")
    met = written(keyed.join(buckets, "key"), "near-met")
    whole = met.where((F.col("size") > SIGNATURE_BLOCK) & (F.col("node") != F.col("first"))).select(F.col("node").alias("u"), F.col("first").alias("v"))
    alone = lambda df, block, *by: df.withColumns({"comp": F.col("node"), "lo": _own_block("size", block, *by), "hi": F.lit(0)})
    families = written(_close(alone(met, SIGNATURE_BLOCK, "key"), classes, rule.percent, whole), "near-families")
    sizes = families.groupBy("root").agg(F.count("*").alias("size"))
    who = written(classes.select("node", "rep", "a", "b").join(families, "node").join(sizes, "root"), "near-who")
    sets = written(_sets(docs, who, rule).select("node", "root", "size", "hashes"), "near-sets")
    used, wide = [met, families, who, sets], F.col("size") > SET_BLOCK
    if who.where(wide).isEmpty():
        links = [_confirmed(alone(sets, SET_BLOCK), rule.percent)]
        drop(*used)
        return links[0], links
    central = SET_BLOCK // 2
    weights = met.groupBy("node").agg(F.sum("size").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("weight"), "node"))
    pivots = written(who.where(wide).select("node", "root").join(weights, "node").withColumn("rank", rank).where(F.col("rank") <= central).select("node", "rank"), "near-pivots")
    used.append(pivots)
    ranked = sets.where(wide).hint("merge").join(pivots, "node", "left")
    blocks = F.sequence(F.lit(0), F.ceil(F.col("size") / (SET_BLOCK - central)) - 1)
    parts = [sets.where(~wide), ranked.where("rank is null").drop("rank")]
    parts = [alone(df, SET_BLOCK - k * central) for k, df in enumerate(parts)]
    parts.append(ranked.where("rank is not null").select("node", "root", "size", "hashes", F.col("node").alias("comp"), F.explode(blocks).alias("lo"), F.lit(0).alias("hi")))
    links = [_confirmed(reduce(DataFrame.unionByName, parts), rule.percent)]
    joined = components(links[0]).select("node", F.col("root").alias("comp"))
    now = who.where(wide).select("node", "root").join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    apart = now.groupBy("root").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("root")
    now = written(now.join(apart, "root"), "near-now")
    differ = _differences(ranked.select("node", "rank", "hashes").join(now.hint("merge"), "node"), rule.percent)
    close = written(_reach(_placed(differ.select("root", "node", "comp"), "root", SIGNATURE_BLOCK), differ, rule.percent), "near-close")
    used += [now, differ, close]
    if not close.isEmpty():
        rows = _placed(close.join(now.select("node", "comp"), "node").select("root", "node", "comp"), "root", SET_BLOCK)
        links.append(_confirmed(rows.hint("merge").join(sets.select("node", "hashes"), "node"), rule.percent))
    drop(*used)
    return reduce(DataFrame.unionAll, links), links


#: Counts of a byte in a sketch of the shingles in which a class differs from the centre of its family.
SKETCH = 64


def _differences(rows: DataFrame, percent: int) -> DataFrame:
    """rows (node, rank, hashes, root, comp) -> (node, root, comp, n, f, sketch), without classes that can't be linked with any.

    Two classes differ just where their differences from a third one do: here the most central of the family, of rank 1.
    Of those, f shingles differ in no other class of the family; the sketch counts the others by hash.
    So two classes differ in at least the sum of their f and of the distances of their counts.
    """

    def differ(batches):
        for batch in batches:
            sets, centres = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("hashes", "centre"))
            d = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(sets, centres)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), batch.column("comp"), pa.array([len(x) for x in sets], pa.int64()), pa.array(d, pa.list_(pa.int64()))], ["node", "root", "comp", "n", "d"])

    def sketch(batches):
        for batch in batches:
            f, sketches = [], []
            for d, own in zip(batch.column("d"), batch.column("own")):
                own = own.values.to_numpy() if own.is_valid else np.zeros(0, np.int64)
                others = np.setdiff1d(d.values.to_numpy(), own, assume_unique=True).view(np.uint64)
                f.append(len(own))
                sketches.append(np.minimum(np.bincount((_mix(others) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "comp", "n")), pa.array(f, pa.int64()), pa.array(sketches, pa.binary())], ["node", "root", "comp", "n", "f", "sketch"])

    centres = rows.where("rank = 1").select("root", F.col("hashes").alias("centre"))
    diffs = written(rows.join(centres.hint("merge"), "root").select("node", "root", "comp", "hashes", "centre").mapInArrow(differ, "node long, root long, comp long, n long, d array<long>"), "near-diffs")
    once = diffs.select("root", "node", F.explode("d").alias("h")).groupBy("root", "h").agg(F.count("*").alias("times"), F.min("node").alias("node")).where("times = 1")
    own = once.groupBy("node").agg(F.collect_list("h").alias("own"))
    found = diffs.hint("merge").join(own, "node", "left").select("node", "root", "comp", "n", "d", "own").mapInArrow(sketch, "node long, root long, comp long, n long, f long, sketch binary")
    # Sizes of linked classes are within percent of each other, so that more than this is too much for any.
    found = written(found.where(F.col("f") * percent <= (100 - percent) * F.col("n")), "near-sketches")
    drop(diffs)
    return found


def _reach(rows: DataFrame, differ: DataFrame, percent: int) -> DataFrame:
    """(node, root): joined up are classes of different components that differ, as far as `differ` tells, by no more than linked ones.

    Sets of n and m shingles that are linked differ in at most (n + m) * (100 - percent) / (100 + percent).
    """
    rows = rows.join(differ.select("node", "n", "f", "sketch").hint("merge"), "node").select("node", "n", "comp", "f", "sketch", "root", "lo", "hi")

    def compare(batches):
        for table, starts, ends in _whole_groups(batches, 5):
            node, n, comp, f = (table.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            u, v = [], []
            for a, b in zip(starts, ends):
                counts = np.stack([np.frombuffer(table.column(4)[i].as_buffer(), np.uint8) for i in range(a, b)]).astype(np.int16)
                apart = np.zeros((b - a, b - a), np.int16)
                for k in range(SKETCH):
                    apart += np.abs(counts[:, k, None] - counts[None, :, k])
                size, own, of = n[a:b], f[a:b], comp[a:b]
                near = ((100 + percent) * (apart + own[:, None] + own) <= (100 - percent) * (size[:, None] + size)) & (of[:, None] != of)
                for i, j in _forest(near):
                    u.append(node[a + i])
                    v.append(node[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return components(rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(compare, "u long, v long"))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of hashes that each two sets share: only hashes of two sets at least are looked at, a strip at a time."""
    n = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), n)
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[word]
    of, word = of[keep], number[word[keep]]
    total = np.zeros((len(sets), len(sets)))
    order = np.argsort(word, kind="stable")
    of, word = of[order], word[order]
    for start in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(word, [start, start + 4096])
        strip = np.zeros((len(sets), 4096), np.float32)
        strip[of[lo:hi], word[lo:hi] - start] = 1
        total += strip @ strip.T
    return total


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (doc_id = component_id).

    Documents of one shingle set are one class, found by grouping; only classes are compared, by signatures
    of 32 symbols of 16 bits. Every pair of classes within DISTANCE symbols shares a key and is found: at
    a similarity of 0.85 a linked pair is farther apart with a chance below 1 in 100,000, at 0.8 of 2 in 10,000,
    and is lost only if it alone connects its ends. Links are confirmed on the full sets.

    Texts without words, null ones too, have no shingles and no links. Rows with a null doc_id are linked like
    others; a component of them alone has a null component_id, and there null is kept. Repeated rows are
    rows of one class. An empty table gives no rows; other columns are ignored.
    """
    return _grouped(docs, rule)[0].select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, rule: Rule, *more: str) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, n, component_id and `more` of each row, and the number of its group (none for a row like no other); and the tables read."""
    ship(docs.sparkSession)
    rows = written(signed(docs, rule.words, *more), "near-rows")
    grouped = rows.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("n", *(f"s{k}" for k in range(CHUNKS)))])
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    links, read = _links(classes, docs, rule)
    roots = components(links).withColumnRenamed("node", "_node")
    drop(*read)
    reps = classes.select("node", "a", "b", "rep", "rows").join(roots, F.col("node") == F.col("_node"), "left")
    lowest = reps.where("root is not null").groupBy("root").agg(F.min("rep").alias("lowest"))
    reps = reps.where("rows > 1 or root is not null").join(lowest, "root", "left").select("a", "b", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("lowest")).alias("component_id"), F.coalesce("root", "node").alias("group"))
    out = rows.select("doc_id", "n", "a", "b", *more).join(reps, ["a", "b"], "left")
    group = F.when(F.col("n") > 0, F.col("group"))
    return out.select("doc_id", "n", F.when(group.isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), group.alias("group"), *more), [rows, classes]


def without_near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of each group stays, with all its columns: the first by doc_id, null last, then by hashes of the text.

    Decided by row, whatever other rows have its doc_id. Of rows that agree in doc_id and text one stays,
    any of them. Rows without words are in no group and stay.
    """
    key = ["_none", "_id", "_x", "_y"]
    named = lambda c: dict(zip(key, (F.col(f"{c}doc_id").isNull(), F.coalesce(F.col(f"{c}doc_id").cast("long"), F.lit(0)), F.xxhash64(f"{c}text"), F.xxhash64(F.lit(1), f"{c}text"))))
    marked = docs.select("doc_id", "text", *[named("")[c].alias(c) for c in key[2:]])
    found, read = _grouped(marked, rule, *key[2:])
    found = found.where("group is not null")
    found = written(found.groupBy("group", F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), *key[2:]).agg(F.count("*").alias("times")), "near-found")
    drop(*read)
    first = written(found.groupBy("group").agg(F.min(F.struct(*key, "times")).alias("first")).select("first.*"), "near-first")
    gone = written(found.select(*key).join(first.select(*key).hint("merge"), key, "left_anti"), "near-gone")
    drop(found)
    rows = docs.select(F.struct(*docs.columns).alias("_row")).withColumns(named("_row."))
    rows = rows.join(gone.hint("merge"), key, "left_anti")
    again = first.where("times > 1").select(*key)
    if again.isEmpty():
        return rows.select("_row.*")
    one = rows.join(again.hint("merge"), key, "left_semi").groupBy(*key).agg(F.first("_row").alias("_row"))
    return rows.join(again.hint("merge"), key, "left_anti").select("_row.*").unionAll(one.select("_row.*"))

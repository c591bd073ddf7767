"""Document fingerprints by locally consistent parsing with deterministic coin tossing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ship

#: Levels of phrases, hashes kept of a level, and phrases from which a level is rich enough to be compared alone.
LEVELS, KEPT, RICH = 3, 32, 12
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _toss(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 2 l + bit l of a, l the lowest bit in which a differs from its left neighbour; 0 at a text's first.

    Neighbours that differ keep labels that differ, from b bits to labels below 2 b: four rounds take
    64 bits to labels below 6, and a label depends on the four symbols to its left alone.
    """
    x = a.copy()
    x[1:] ^= a[:-1]
    x[first] = 1
    low = np.minimum(np.bitwise_count((x & (~x + x.dtype.type(1))) - x.dtype.type(1)), 8 * a.dtype.itemsize - 1).astype(a.dtype)
    return (low << a.dtype.type(1)) | ((a >> low) & a.dtype.type(1))


def parse(names: np.ndarray, of: np.ndarray):
    """One level: symbols of texts laid end to end, and the text of each -> names and texts of their phrases.

    A run of one symbol becomes a symbol of its own, so that neighbours differ. A phrase begins at each
    local minimum of the labels, and its name is a hash of its symbols in order: equal substrings are cut
    and named alike but for a few symbols at their ends, wherever they stand.
    """
    if not len(names):
        return names, of
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    if len(at) < len(names):
        run = np.diff(np.append(at, len(names))).astype(np.uint64)
        names, of = np.where(run > 1, _mix(names[at] + run * _GOLD), names[at]), of[at]
    first = np.ones(len(names), bool)
    first[1:] = of[1:] != of[:-1]
    label = _toss(names, first).astype(np.uint8)
    for _ in range(3):
        label = _toss(label, first)
    start = first.copy()
    start[1:] |= label[1:] < label[:-1]
    start[1:-1] &= first[1:-1] | (label[1:-1] < label[2:]) | first[2:]
    at = np.flatnonzero(start)
    within = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
    return _mix(np.add.reduceat(_mix(names + within.astype(np.uint64) * _GOLD), at)), of[at]


def fingerprints(texts: list[str]) -> list[str]:
    """For each level from the highest down: its number of distinct phrases and the KEPT smallest hashes of them.

    A level is written until one has 4 * RICH phrases. Equal texts have equal fingerprints; the empty text's is "".
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    names, of = code.astype(np.uint64), np.repeat(np.arange(len(texts)), sizes)
    levels = []
    for _ in range(LEVELS):
        names, of = parse(names, of)
        levels.append((names, of))
    out, need = [""] * len(texts), sizes > 0
    for k in range(LEVELS - 1, -1, -1):
        names, of = levels[k]
        use = need[of]
        h, of = (names[use] >> np.uint64(32)).astype(np.uint32), of[use]
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        distinct = np.ones(len(h), bool)
        distinct[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[distinct].astype(">u4"), of[distinct]
        n = np.bincount(of, minlength=len(texts))
        begin, raw = np.cumsum(n) - n, h.tobytes()
        for i in np.flatnonzero(need):
            out[i] += f"{k + 1}:{n[i]}:{raw[4 * begin[i] : 4 * (begin[i] + min(n[i], KEPT))].hex()};"
        need &= n < 4 * RICH
    return out


def _levels(fingerprint: str) -> dict[int, tuple[int, str]]:
    return {int(k): (int(n), h) for k, n, h in (x.split(":") for x in fingerprint.split(";") if x)}


def likeness(a: str, b: str) -> float:
    """Estimated share of common phrases, 0 to 1, at the highest level that is rich in both fingerprints, or the lowest both have."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    left, right = _levels(a), _levels(b)
    both = sorted(left.keys() & right.keys(), reverse=True)
    level = next((k for k in both if min(left[k][0], right[k][0]) >= RICH), both[-1])
    x, y = ({h[i : i + 8] for i in range(0, len(h), 8)} for _, h in (left[level], right[level]))
    lowest = sorted(x | y)
    if max(left[level][0], right[level][0]) > KEPT:
        lowest = lowest[:KEPT]
    return sum(h in x and h in y for h in lowest) / len(lowest)


def _edited(text: str, following: str) -> str:
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _runs(rows, chars: int = 1_000_000):
    """Runs of about so many characters, each with the row that follows it."""
    run, n = [], 0
    for row in rows:
        run.append(row)
        n += len(row[3])
        if n >= chars:
            yield run
            run, n = [row], len(row[3])
    if len(run) > 1:
        yield run


def _compared(batches):
    """Rows sorted by (bucket, copy, document) -> the result's rows; a bucket's last rows are copies."""
    rows = ((b, c, i, t or "") for batch in batches for b, c, i, t in zip(*(batch.column(k).to_pylist() for k in range(4))))
    for run in _runs(rows):
        own = fingerprints([r[3] for r in run])
        pairs = [(k, r, s) for k, (r, s) in enumerate(zip(run, run[1:])) if not r[1]]
        edited = [_edited(r[3], s[3]) for _, r, s in pairs]
        marks = fingerprints(edited)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[2] for _, r, _ in pairs], pa.int64()),
                pa.array([len(r[3]) for _, r, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([own[k] for k, *_ in pairs], pa.string()),
                pa.array(marks, pa.string()),
                pa.array([likeness(own[k], m) for (k, *_), m in zip(pairs, marks)], pa.float64()),
                pa.array([likeness(own[k], own[k + 1]) for k, *_ in pairs], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of the text edited with the next document's, and their likeness.

    Documents are in descending order of doc_id (null last, ties by a hash of the text); after the last
    comes the first. Null texts count as empty. An empty table gives no rows, a single document is its own
    next one, repeated rows follow one another, and other columns are ignored.

    The texts are shuffled once, to ranges of doc_id; the row that follows a range, the first of the next,
    is copied into it. The ranges are found by sorting the ids alone; the driver holds the first of each.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(4, 2 * docs.rdd.getNumPartitions())
    ids = docs.select("doc_id").repartitionByRange(parts, F.col("doc_id").desc_nulls_last())
    firsts = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("id"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()
    cuts = -np.array(sorted((r.id for r in firsts if r.id is not None), reverse=True), np.int64)

    def bucket(ids: pa.Array) -> np.ndarray:
        """The range of each id, from 0; null ids come in one of their own, the last."""
        known = np.asarray(ids.is_valid())
        return np.where(known, np.searchsorted(cuts, -ids.fill_null(0).to_numpy(zero_copy_only=False), "right") - 1, len(cuts)).astype(np.int32)

    heads = dict(enumerate((-cuts).tolist()))
    if any(r.nulls for r in firsts):
        heads[len(cuts)] = None
    there = sorted(heads)
    before = dict(zip(there, there[-1:] + there[:-1]))

    def dealt(batches):
        """Each row in its bucket, and those at the head of a bucket also at the end of the one before."""
        for batch in batches:
            ids = batch.column(0)
            at = bucket(ids)
            head = np.array([i for i, (b, d) in enumerate(zip(at.tolist(), ids.to_pylist())) if d == heads[b]], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), np.int32)), ids, batch.column(1)], ["bucket", "copy", "doc_id", "text"])
            if len(head):
                copies = batch.take(pa.array(head))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([before[b] for b in at[head].tolist()], np.int32)), pa.array(np.ones(len(head), np.int32)), copies.column(0), copies.column(1)], ["bucket", "copy", "doc_id", "text"])

    rows = docs.mapInArrow(dealt, "bucket int, copy int, doc_id long, text string")
    rows = rows.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return rows.mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

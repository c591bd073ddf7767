"""Line dedup: maximal repeated runs of lines, found by a suffix array over line ids."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import by_size
from gridloom.llm.common import drop, held_by, ship, written
from gridloom.llm.suffixes import earlier_runs, grouped, ranges

#: A repeated run is deleted if it has at least so many words.
MIN_WORDS = 50
_NONE = (1 << 63) - 1


def _hashed(batches):
    """(doc, hash, lines, and of each line two hashes and its number of words) of each text, once a task."""
    held_by("lines")
    seen = set()
    for batch in batches:
        docs, hashes, at = batch.column(0), batch.column(1), 0
        for run in by_size(t or "" for t in batch.column(2).to_pylist()):
            new = []
            for i, key in enumerate(zip(docs.slice(at, len(run)).to_pylist(), hashes.slice(at, len(run)).to_pylist())):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            lines = [run[i].encode("utf-8", "surrogatepass").split(b"\n") for i in new]
            flat = list(chain.from_iterable(lines))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lines], dtype=np.int64)]).astype(np.int32)
            each = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(values, kind, len(flat))))
            name = lambda seed: (xxhash.xxh64_intdigest(x, seed) - (1 << 63) for x in flat)
            take = pa.array(np.array(new, np.int64) + at)
            yield pa.RecordBatch.from_arrays([docs.take(take), hashes.take(take), each(name(1), np.int64), each(name(2), np.int64), each((len(x.split()) for x in flat), np.int32)], ["doc", "hash", "a", "b", "words"])
            at += len(run)


def _placed(batches):
    """Texts of a range in order -> each once, with the range and the number of lines before it there."""
    last, before, part = None, 0, TaskContext.get().partitionId()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        new = np.array([i for i, key in enumerate(keys) if key != (keys[i - 1] if i else last)], np.int64)
        last = keys[-1] if keys else last
        batch = batch.take(pa.array(new))
        n = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
        at = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(at), pa.array(n)], [*batch.schema.names, "part", "at", "n"])


def _stretches(min_words: int):
    def find(batches):
        """Repeated lines of whole texts in order -> stretches of neighbouring ones that have min_words words."""
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        doc, g, ids, words = (table.column(c).to_numpy() for c in ("doc", "g", "first", "words"))
        begin = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (g[1:] != g[:-1] + 1)))
        end = np.append(begin[1:], len(g))
        for a, b in zip(begin[np.add.reduceat(words, begin) >= min_words].tolist(), end[np.add.reduceat(words, begin) >= min_words].tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([g[a]]), pa.array([doc[a]]), pa.array([ids[a:b]], pa.list_(pa.int64())), pa.array([words[a:b]], pa.list_(pa.int32()))], ["seg", "doc", "ids", "words"])

    return find


def _covered(min_words: int):
    @F.pandas_udf("array<struct<start: int, length: int>>")
    def cover(words: pd.Series, runs: pd.Series) -> pd.Series:
        """The lines that runs of min_words words or more cover, as few spans as there can be."""
        out = []
        for w, own in zip(words, runs):
            total = np.concatenate([[0], np.cumsum(w)])
            at, length = np.array([r["at"] for r in own]), np.array([r["run"] for r in own])
            long = total[at + length] - total[at] >= min_words
            edge = np.zeros(len(w) + 1, np.int64)
            np.add.at(edge, at[long], 1)
            np.add.at(edge, at[long] + length[long], -1)
            gone = np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]])
            begin, end = np.flatnonzero(np.diff(gone) == 1), np.flatnonzero(np.diff(gone) == -1)
            out.append([{"start": int(a), "length": int(b - a)} for a, b in zip(begin, end)])
        return pd.Series(out)

    return cover


def _spans(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, hash, spans): the runs to delete of each text that has any.

    Texts are put in order of doc_id and hash, and their lines numbered through. Lines are grouped: ids are
    places in the order of all lines' hashes. A line that is no other's equal is in no repeated run, so
    it parts the text; stretches of fewer words than count are left out with it, as queries and as copies. What
    remains goes to the suffix array, and the runs that begin there and earlier are deleted.
    """
    spark = docs.sparkSession
    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), F.xxhash64("text").alias("hash"), "text")
    texts = written(rows.mapInArrow(_hashed, "doc long, hash long, a array<long>, b array<long>, words array<int>"), "line-texts")
    total = texts.agg(F.coalesce(F.sum(F.size("a")), F.lit(0))).first()[0]
    parts = ranges(texts, total)
    placed = texts.repartitionByRange(parts, "doc", "hash").sortWithinPartitions("doc", "hash").mapInArrow(_placed, "doc long, hash long, a array<long>, b array<long>, words array<int>, part int, at long, n long")
    placed = written(placed, "line-placed")
    drop(texts)
    base, bases = 0, []
    for r in sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.part):
        bases.append((r.part, base))
        base += r.n
    placed = placed.join(spark.createDataFrame(bases, "part int, base long"), "part").withColumn("own", F.col("base") + F.col("at"))
    lines = placed.select("own", F.posexplode(F.arrays_zip("a", "b", "words")))
    lines = lines.select(F.col("col.a").alias("x"), F.col("col.b").alias("y"), (F.col("own") + F.col("pos")).alias("g"), F.col("own").alias("doc"), F.col("col.words").alias("words"))
    order, table = grouped(lines, total)
    repeated = order.where("not alone").select("doc", "g", "first", "words").repartition(parts, "doc").sortWithinPartitions("doc", "g")
    stretches = written(repeated.mapInArrow(_stretches(min_words), "seg long, doc long, ids array<long>, words array<int>"), "line-stretches")
    drop(table)
    runs = earlier_runs(stretches.select("seg", "ids"))
    runs = runs.groupBy("seg").agg(F.collect_list(F.struct((F.col("g") - F.col("seg")).alias("at"), "run")).alias("runs"))
    found = stretches.select("seg", "doc", "words").hint("merge").join(runs, "seg").select("seg", "doc", F.explode(_covered(min_words)("words", "runs")).alias("span"))
    found = found.groupBy("doc").agg(F.collect_list(F.struct((F.col("seg") - F.col("doc") + F.col("span.start")).alias("start"), F.col("span.length").alias("length"))).alias("spans"))
    spans = placed.select(F.col("doc").alias("doc_id"), "hash", "own").join(found.hint("merge"), F.col("own") == found["doc"]).select("doc_id", "hash", "spans")
    return written(spans, "line-spans")


def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    held_by("lines")
    rows = []
    for text, own in zip(texts, spans):
        if text is None:
            rows.append((0, 0, None))
            continue
        lines = text.split("\n")
        if own is None or not len(own):
            rows.append((len(lines), 0, text))
            continue
        edge = np.zeros(len(lines) + 1, np.int64)
        start, length = np.array([s["start"] for s in own]), np.array([s["length"] for s in own])
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        rows.append((len(lines), int(gone.sum()), "\n".join([x for x, g in zip(lines, gone) if not g])))
    return pd.DataFrame(rows, columns=["n_lines", "n_deleted", "text"])


def _cleaned(docs: DataFrame, min_words: int) -> DataFrame:
    """_row (a document's columns) and _cut (n_lines, n_deleted, text)."""
    ship(docs.sparkSession)
    spans = _spans(docs, min_words).select(F.col("doc_id").alias("_d"), F.col("hash").alias("_h"), "spans").hint("merge")  # alike at every size: a broadcast would pass its bound somewhere
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    rows = rows.join(spans, (F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(_NONE)) == F.col("_d")) & (F.xxhash64("_row.text") == F.col("_h")), "left")
    # Not to be evaluated once for a filter and again for a projection.
    cut = F.pandas_udf(_cut, "n_lines long, n_deleted long, text string").asNondeterministic()
    return rows.select("_row", cut(F.col("_row.text"), F.col("spans")).alias("_cut"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted and the text without later copies of repeated runs of lines.

    Lines are what \\n parts. Of a maximal run of consecutive lines, of min_words words or more, that stands in
    several places, the first stays, in order of doc_id (null last), then of a hash of the text, then of
    lines; the later copies are deleted, also those that overlap the first. Rows alike in doc_id and text are one
    text, and are cut alike. Null texts have no lines and stay null; an empty text is one line; an empty
    table gives no rows; a text of any length is read whole; other columns are ignored.
    """
    return _cleaned(docs, min_words).select("_row.doc_id", "_cut.n_lines", "_cut.n_deleted", "_cut.text")


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with all their columns, the text cut, n_chars (if there) its length; those with no line left go."""
    rows = _cleaned(docs, min_words).where("_cut.n_deleted = 0 or _cut.n_deleted < _cut.n_lines")
    new = {"text": F.col("_cut.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_cut.n_deleted") > 0, F.length("_cut.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return rows.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])

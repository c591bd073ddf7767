import math
import re
import struct
import zlib
from collections import defaultdict

import xxhash

from pyspark.sql import functions as F

from gridloom.llm import mixing, sharding
from gridloom.llm.common import documents, sums_before

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, slot string"


def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing names."""
    rows = [(1, "a b c", "en", "s", 5, "x", "y", "z"), (1, "a b c", "en", "s", 5, "x", "y", "z"), (None, "q " * 5000, "en", None, None, None, None, None), (2, None, None, "s", None, "", "", ""), (3, "", "en", "t", 0, "", "", ""), (4, " \x0b\t\n", "en", "é", 4, "", "", ""), (5, "  x", "en", "\U00010000", 3, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


def fill(sizes):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w >= 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def held(docs, out, block):
    words = lambda t: len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    rows, got = docs.select("doc_id", "text", "source").collect(), out.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += words(r.text)
    target = fill(sizes)
    assert sorted((str(r.doc_id), words(r.text), str(r.source)) for r in rows) == sorted((str(r.doc_id), r["size"], str(r.source)) for r in got)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6, (s, taken[s], target[s])


def test_mix_meets_targets(spark):
    docs = documents(spark, SF)
    for block in (256, 7):
        held(docs, mixing.mix_sources(docs, block=block, shard_slots=16), block)


def test_mix_odd_rows(spark):
    held(odd(spark), mixing.mix_sources(odd(spark), block=3), 3)
    assert mixing.mix_sources(odd(spark).limit(0)).count() == 0
    kept = mixing.mixed_documents(odd(spark))
    assert kept.columns == odd(spark).columns
    assert mixing.mixed_documents(odd(spark).limit(0)).count() == 0


def test_mix_agrees_with_brute_force(spark):
    """The slots' words, laid over the documents one by one, give the same taken."""
    docs = documents(spark, SF)
    got = {r.doc_id: r.taken for r in mixing.mix_sources(docs, block=50).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(3), block=50).collect()}
    assert got == again
    sizes = docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"))
    src = mixing.source_targets(sizes).cache()
    name = {r.src: r.source for r in src.collect()}
    per = defaultdict(lambda: defaultdict(int))
    for r in mixing._slots(src, 50, 1024, 20).collect():
        for w in range(r.block * 50, r.block * 50 + r.words):
            per[name[r.src]][w] += 1
    laid = mixing.running_offsets(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "source", ["doc_id", "size"], F.col("size"), "start", docs.count())
    for r in laid.collect():
        assert got[r.doc_id] == sum(per[r.source][w] for w in range(r.start, r.start + r["size"]))


def test_sums_in_steps(spark):
    rows = [(g, at, (7 * at + g) % 11) for g in range(3) for at in range(100) if (at + g) % 5]
    for fan in (2, 3, 10, 4096):
        got = sums_before(spark.createDataFrame(rows, "g int, at long, w long"), "g", "at", "w", "s", 100, fan).collect()
        assert sorted((r.g, r.at, r.w, r.s) for r in got) == sorted((g, at, w, sum(v for h, a, v in rows if h == g and a < at)) for g, at, w in rows)


def test_permutation(spark):
    for n in (1, 2, 3, 17, 100):
        df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), [F.lit(9)]).alias("p"))
        df = df.withColumn("back", mixing.permuted(F.col("p"), F.lit(n), [F.lit(9)], inverse=True))
        rows = df.collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    assert [r.p for r in rows] != list(range(n))


def test_shards(spark):
    for docs in (documents(spark, SF), odd(spark)):
        src, got = docs.select("doc_id", "text").collect(), sharding.shard_documents(docs).collect()
        want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in src)
        assert want == sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(odd(spark).limit(0)).count() == 0


def slow_shard(doc_id, tree):
    """A row's shard, draw by draw: Spark's xxhash64 is that of each value's bytes, seeded by the one before."""

    def draw(path, weight):
        h = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
        for p in (len(path), *path):
            h = xxhash.xxh64_intdigest(struct.pack("<i", p), h)
        return math.log(((h >> 11) + 0.5) / 2.0**53) / weight

    def weight(path):
        return sum(w for *p, w in tree.shards if tuple(p[: len(path)]) == path)

    path = ()
    while len(path) < 3:
        below = sorted({tuple(p[: len(path) + 1]) for *p, _ in tree.shards if tuple(p[: len(path)]) == path})
        path = max(below, key=lambda p: draw(p, weight(p)))
    return path[2]


def test_shards_draw_by_draw(spark):
    docs = documents(spark, SF)
    rows = sharding.shard_documents(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))).collect()
    for r in rows:
        assert (r.shard, r.grown_shard) == (slow_shard(r.doc_id, sharding.even_tree(16)), slow_shard(r.doc_id, sharding.even_tree(17)))
    tree = sharding.Tree(((0, 0, 5, 3.0), (0, 0, 6, 0.5), (0, 1, 7, 1.0), (2, 0, 8, 2.0)))
    got = docs.select("doc_id", sharding.shard_of(F.col("doc_id"), tree).alias("shard")).collect()
    assert all(r.shard == slow_shard(r.doc_id, tree) for r in got)


def test_tree_confines_movement(spark):
    keys, base = spark.range(4000).withColumnRenamed("id", "k"), sharding.even_tree(16)
    heavy = sharding.Tree(tuple((r, k, s, 3.0 if s == 5 else w) for r, k, s, w in base.shards))
    home = {s: (r, k) for r, k, s, _ in base.shards}
    rows = keys.select(sharding.shard_of(F.col("k"), base).alias("a"), sharding.shard_of(F.col("k"), heavy).alias("b"), sharding.shard_of(F.col("k"), sharding.even_tree(17)).alias("c")).collect()
    for r in rows:
        if r.a != r.b:  # into shard 5's region from another, into its rack from its region, or into itself from its rack
            assert home[r.b][0] == home[5][0] and (home[r.a][0] != home[r.b][0] or home[r.b] == home[5] and (home[r.a] != home[5] or r.b == 5))
        assert r.c in (r.a, 16)
    n = [sum(r.a == s for r in rows) for s in range(16)]
    assert min(n) > 170 and max(n) < 340
    assert 150 < sum(r.c == 16 for r in rows) < 330

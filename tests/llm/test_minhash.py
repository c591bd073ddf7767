import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import components, minhash
from gridloom.llm.common import documents


def shingle_set(text, words):
    w = tuple(re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    return {w[i : i + words] for i in range(len(w) - words + 1)} if len(w) >= words else {w} if w else set()


def brute(rows, rule):
    """[(doc_id, text)] -> n and the component's smallest doc_id of each row, by comparing all pairs that share a shingle."""
    sets = [shingle_set(t, rule.words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for p in {(i, j) for own in holders.values() for k, i in enumerate(own) for j in own[k + 1 :]}:
        a, b = sets[p[0]], sets[p[1]]
        if 100 * len(a & b) >= rule.percent * len(a | b):
            parent[root(p[0])] = root(p[1])
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[root(i)] = min(lowest.get(root(i), d), d)
    return sorted((str(d), len(s), str(lowest.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def held(docs, rule):
    got = minhash.near_duplicates(docs, rule).collect()
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], rule)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return got


@pytest.mark.parametrize("rule", [minhash.Rule(3, 85), minhash.Rule()])
def test_documents(spark, rule):
    got = held(documents(spark, "/root/testdata/sf0.01"), rule)
    assert sum(not r.kept for r in got) > 20


def test_chains_and_odd_rows(spark):
    """A chain whose ends aren't alike, near copies of one text, short texts, nulls and repeated rows."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows, now = [], list(base)
    for i in range(40):
        now = now[:]
        now[rng.randrange(400)] = now[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        now[rng.randrange(400)] = now[rng.randrange(400)] = f"y{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(now)))
    for i in range(60):
        other = base[:]
        for _ in range(rng.randrange(1, 14)):
            other[rng.randrange(400)] = f"z{rng.randrange(10**6)}"
        rows.append((2000 + i, " \t".join(other).upper()))
    rows += [(5, "one"), (6, "ONE"), (7, "one two"), (8, ""), (9, None), (None, "one"), (None, "é lone"), (5, "one"), (10, " \x0b "), (11, "É one two three"), (12, "é one two three"), (13, "q " * 50000), (14, "q " * 49999)]
    df = spark.createDataFrame([(d, t, 1, "n", "u") for d, t in rows], "doc_id long, text string, n int, node string, u string")
    for rule in (minhash.Rule(3, 85), minhash.Rule()):
        held(df, rule)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    kept = minhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert minhash.without_near_duplicates(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (None, text(1)), (None, text(1) + " and"), (None, text(2)), (2, text(3)), (5, text(3)), (5, text(4)), (7, text(5)), (7, text(5)), (None, text(6)), (None, text(6)), (None, text(6).upper()), (None, ""), (None, ""), (8, None), (8, None)]
    df = spark.createDataFrame([(t, d, "s") for d, t in rows], "text string, doc_id int, group string")
    got = minhash.without_near_duplicates(df).collect()
    kept = [(r.doc_id, r.text and r.text.lower()) for r in got]
    want = [(1, text(1)), (None, text(2)), (2, text(3)), (5, text(4)), (7, text(5)), (None, text(6)), (None, ""), (None, ""), (8, None), (8, None)]
    assert sorted(kept, key=str) == sorted(want, key=str) and got[0].group == "s"


def test_pairs_within_the_distance_share_a_key(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, (300, minhash.SYMBOLS), dtype=np.uint16)
    other = base.copy()
    for k, row in enumerate(other):
        row[rng.permutation(minhash.SYMBOLS)[: k % (minhash.DISTANCE + 1)]] ^= np.uint16(1 << (k % 16))
    frame = lambda m, name: spark.createDataFrame([(k, *map(int, r)) for k, r in enumerate(m.view(np.int64))], "k int, " + ", ".join(f"s{j} long" for j in range(minhash.CHUNKS))).select("k", minhash._keys().alias(name))
    rows = frame(base, "x").join(frame(other, "y"), "k").select(F.arrays_overlap("x", "y").alias("met")).collect()
    assert all(r.met for r in rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    """A group cut into many blocks loses no link."""
    monkeypatch.setattr(minhash, "SIGNATURE_BLOCK", 3)
    monkeypatch.setattr(minhash, "SET_BLOCK", 2)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(50):
        other = base[:]
        for _ in range(rng.randrange(0, 9)):
            other[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(other)))
    for i in range(30):  # close by signature, but linked in pairs alone
        other = base[:]
        for k in rng.sample(range(200), 14):
            other[k] = f"z{rng.randrange(10**6)}"
        rows += [(100 + 2 * i, " ".join(other)), (101 + 2 * i, " ".join(other[:-1]))]
    got = held(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Rule(3, 85))
    assert len({r.component_id for r in got}) > 10


def test_a_large_family_is_not_compared_key_by_key(spark, monkeypatch):
    """Copies of one text, many too much edited for a link: rows compared stay near the classes' keys, and no link is lost."""
    monkeypatch.setattr(minhash, "SIGNATURE_BLOCK", 32)
    monkeypatch.setattr(minhash, "SET_BLOCK", 16)
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(300):
        other = base[:]
        for k in rng.sample(range(150), rng.randrange(1, 9)):
            other[k] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(other)))
    seen, close = [], minhash._close
    monkeypatch.setattr(minhash, "_close", lambda df, *more: seen.append(df.count()) or close(df, *more))
    got = held(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Rule(3, 85))
    assert len({r.component_id for r in got}) > 50
    assert sum(seen) <= 32 * len(rows)


@pytest.mark.parametrize("rule", [minhash.Rule(3, 85), minhash.Rule()])
def test_sketches_rule_out_no_link(spark, rule):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(60):
        other = base[:]
        for k in rng.sample(range(120), rng.randrange(0, 6)):
            other[k] = rng.choice(["", f"v{k}", f"z{rng.randrange(10**6)}"])
        texts.append(" ".join(other[: rng.choice([120, 120, 110])]))
    texts = sorted(set(texts))
    hashes, n = minhash.shingles(texts, rule.words)
    sets = np.split(hashes, np.cumsum(n)[:-1])
    rows = [(i, i + 1, bytearray(h.tobytes()), 7, i) for i, h in enumerate(sets)]
    differ = minhash._differences(spark.createDataFrame(rows, "node long, rank int, hashes binary, root long, comp long"), rule.percent)
    kept = {r.node: (r.f, np.frombuffer(bytes(r.sketch), np.uint8).astype(int)) for r in differ.collect()}
    linked = far = 0
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            union = len(sets[i]) + len(sets[j]) - common
            if i in kept and j in kept:
                apart = kept[i][0] + kept[j][0] + abs(kept[i][1] - kept[j][1]).sum()
                assert apart <= union - common
                far += (100 + rule.percent) * apart > (100 - rule.percent) * (len(sets[i]) + len(sets[j]))
            if 100 * common >= rule.percent * union:
                linked += 1
                assert i in kept and j in kept
    assert linked > 20 and far > 20


def test_few_edges_take_no_rounds(spark, monkeypatch):
    names, real = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or real(df, name))
    rng = random.Random(4)
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)], "u long, v long")
    want = sorted(map(tuple, components.components(edges).collect()))
    assert want[:51] == [(i, 0) for i in range(51)] and len(names) == 2
    monkeypatch.setattr(components, "FEW", 10)
    assert sorted(map(tuple, components.components(edges).collect())) == want and len(names) > 6


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(30)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(3, 2), (2, 3), (3, 2)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for i in list(parent)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0

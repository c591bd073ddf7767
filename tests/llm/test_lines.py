import random

from pyspark.sql import functions as F

from gridloom.llm import lines as L
from gridloom.llm import suffixes as S
from gridloom.llm.common import documents


def brute(rows, min_words):
    """Kept lines of [(doc_id, text, hash)]: from each line, the longest run that also begins earlier, tried run by run."""
    order = sorted({(d if d is not None else 1 << 62, h, t) for d, t, h in rows if t is not None})
    docs = [(d, t.split("\n")) for d, _, t in order]
    places = {}
    for k, (d, ls) in enumerate(docs):
        for i, x in enumerate(ls):
            places.setdefault(x, []).append((k, i))
    gone = [[False] * len(ls) for _, ls in docs]
    for k, (d, ls) in enumerate(docs):
        for i, x in enumerate(ls):
            best = 0
            for m, j in places[x]:
                other = docs[m][1]
                if m < k or m == k and j < i:
                    n = 0
                    while i + n < len(ls) and j + n < len(other) and ls[i + n] == other[j + n]:
                        n += 1
                    best = max(best, n)
            if best and sum(len(y.encode().split()) for y in ls[i : i + best]) >= min_words:
                gone[k][i : i + best] = [True] * best
    kept = {o: "\n".join(x for x, g in zip(ls, gs) if not g) for o, (_, ls), gs in zip(order, docs, gone)}
    return sorted((str(d), str(None if t is None else kept[d if d is not None else 1 << 62, h, t])) for d, t, h in rows)


def held(docs, min_words):
    got = L.dedup_lines(docs, min_words).collect()
    rows = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == brute(rows, min_words)
    return got


def test_suffix_array(spark, monkeypatch):
    """Order, longest common prefixes and earlier runs against naive ones, in ranges of a few rows and in one."""
    rng = random.Random(1)
    for rows, n, symbols, long in ((1 << 30, 12, 2, 9), (5, 4, 2, 6)):
        monkeypatch.setattr(S, "ROWS", rows)
        texts, at = [], 0
        for _ in range(n):
            text = [rng.randrange(symbols) * 1000 for _ in range(rng.randrange(1, long))]
            texts.append((at, text if rng.random() < 0.7 or not texts else texts[0][1]))
            at += len(texts[-1][1]) + rng.randrange(3)
        df = spark.createDataFrame(texts, "seg long, ids array<long>")
        suffixes = sorted((t[i:], seg + i) for seg, t in texts for i in range(len(t)))
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = [(s, g, common(t, suffixes[s - 1][0]) if s else 0) for s, (t, g) in enumerate(suffixes)]
        assert sorted((r.s, r.g, r.lcp) for r in S.suffix_array(df)[0].collect()) == want
        runs = {g: max((common(t, u) for u, h in suffixes if h < g), default=0) for t, g in suffixes}
        assert {r.g: r.run for r in S.earlier_runs(df).collect()} == {g: n for g, n in runs.items() if n}
    assert S.earlier_runs(df.limit(0)).count() == 0


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    for w in (50, 5):
        got = held(docs, w)
        assert sum(r.n_deleted > 0 for r in got) > 5


def test_random_lines(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "", "c c c", "d"]) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    rows += [(None, "a\nb b\nc c c"), (None, "c c c\na\na"), (3, rows[3][1]), (3, "d\nd\nd\nd\nd\nd\nd"), (70, None), (71, ""), (72, "a\n" * 300), (-5, "c c c\nb b\n")]
    df = spark.createDataFrame([(d, t, "x", 9) for d, t in rows], "doc_id long, text string, spans string, n_chars long")
    for w in (1, 6):
        held(df, w)
    assert L.dedup_lines(df.limit(0)).count() == 0
    kept = L.without_repeated_lines(df, 3)
    assert kept.columns == df.columns and all(r.n_chars == 9 or r.n_chars == len(r.text) for r in kept.collect())

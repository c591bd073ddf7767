import hashlib
import random

import numpy as np

from gridloom.llm import fingerprints as L
from gridloom.llm.common import documents

SF = "/root/testdata/sf0.001"


def mix(x):
    """The finaliser of splitmix64, in whole numbers."""
    x %= 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def slow_marks(text):
    """Level -> all distinct 32-bit marks of its phrases, for the levels that a fingerprint writes, highest first."""
    levels, names = [], list(map(ord, text))
    for _ in range(L.LEVELS):
        names = slow_parse(names)
        levels.append(sorted({n >> 32 for n in names}))
    out = {}
    for k in range(L.LEVELS, 0, -1):
        if not text or out and len(out[k + 1]) >= 4 * L.RICH:
            break
        out[k] = levels[k - 1]
    return out


def slow_likeness(a, b):
    """From full sets of marks: the smallest KEPT of both together that are in both."""
    if a == b or not a or not b:
        return float(a == b)
    both = sorted(a.keys() & b.keys(), reverse=True)
    k = next((k for k in both if len(a[k]) >= L.RICH and len(b[k]) >= L.RICH), both[-1])
    x, y = set(a[k]), set(b[k])
    lowest = sorted(x | y)
    if max(len(x), len(y)) > L.KEPT:
        lowest = lowest[: L.KEPT]
    return sum(h in x and h in y for h in lowest) / len(lowest)


def slow_parse(names):
    """One level of one text, symbol by symbol."""
    gold, runs, i = int(L._GOLD), [], 0
    while i < len(names):
        j = i
        while j < len(names) and names[j] == names[i]:
            j += 1
        runs.append(names[i] if j - i == 1 else mix(names[i] + (j - i) * gold))
        i = j
    label = list(runs)
    for _ in range(4):
        out = []
        for k, a in enumerate(label):
            x = 1 if k == 0 else a ^ label[k - 1]
            low = (x & -x).bit_length() - 1
            out.append(2 * low + (a >> low & 1))
        label = out
    starts = [k for k in range(len(runs)) if k == 0 or label[k] < label[k - 1] and (k + 1 == len(runs) or label[k] < label[k + 1])]
    return [mix(sum(mix(a + j * gold) for j, a in enumerate(runs[s:e]))) for s, e in zip(starts, starts[1:] + [len(runs)])]


def test_parse_agrees_with_brute_force():
    rng = random.Random(3)
    texts = ["", "a", "aa", "ab", "aaab", "abab" * 9] + ["".join(rng.choice("ab cdeé🙂") for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    slow = [list(map(ord, t)) for t in texts]
    for _ in range(3):
        names, of = L.parse(names, of)
        slow = [slow_parse(s) for s in slow]
        for i, s in enumerate(slow):
            assert names[of == i].tolist() == s


def test_equal_substrings_share_their_interior():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    shared = word(3000)
    names = lambda t: set(L.parse(*L.parse(np.array(list(map(ord, t)), np.uint64), np.zeros(len(t), int)))[0].tolist())
    own, one, two = names(shared), names(word(17) + shared + word(40)), names(word(101) + shared)
    assert len(own & one & two) > 0.95 * len(own)


def test_documents(spark):
    rows = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    got = {r.doc_id: r for r in L.compare_neighbours(documents(spark, SF)).collect()}
    order = sorted(rows, reverse=True)
    assert got.keys() == rows.keys()
    for i, following in zip(order, order[1:] + order[:1]):
        t, r = rows[i], got[i]
        m = len(t) // 3
        e = t[: len(t) - m] + rows[following][:m]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert [r.fingerprint, r.edited_fingerprint] == L.fingerprints([t]) + L.fingerprints([e])
        assert r.near_edited == L.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == L.likeness(r.fingerprint, got[following].fingerprint)
    marks = {i: slow_marks(t) for i, t in rows.items() if len(t) < 1500}
    pairs = [(i, j) for i, j in zip(order, order[1:] + order[:1]) if i in marks and j in marks]
    assert len(pairs) > 40
    for i, j in pairs:
        text = "".join(f"{k}:{len(m)}:{''.join(f'{h:08x}' for h in m[: L.KEPT])};" for k, m in marks[i].items())
        assert got[i].fingerprint == text and abs(got[i].near_next - slow_likeness(marks[i], marks[j])) < 1e-12
        m = len(rows[i]) // 3
        e = slow_marks(rows[i][: len(rows[i]) - m] + rows[j][:m])
        assert abs(got[i].near_edited - slow_likeness(marks[i], e)) < 1e-12
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in long]) < 0.1


def test_odd_rows(spark):
    rows = [(1, "", "x"), (None, None, None), (None, "abc" * 50, ""), (3, "x" * 300_000, ""), (4, "one two three " * 20, ""), (4, "one two three " * 20, ""), (-7, "\U0001f642é" * 30, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = L.compare_neighbours(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    twice = [r for r in got if r.doc_id == 4]
    assert twice[0].fingerprint == twice[1].fingerprint and 1.0 in (twice[0].near_next, twice[1].near_next)
    assert [r.fingerprint for r in got if r.n_chars == 0] == ["", ""]
    assert L.compare_neighbours(df.limit(0)).count() == 0
    alone = L.compare_neighbours(df.where("doc_id = -7")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0

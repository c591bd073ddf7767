import tracemalloc
import zlib

import numpy as np

from gridloom.llm import toxicity as T
from gridloom.llm.common import documents

SF = "/root/testdata/sf0.01"


def test_windows_cover_texts():
    sizes = np.array([0, 1, T.LENGTH, T.LENGTH + 1, 5 * T.LENGTH + 3, 0])
    ids = np.arange(1, sizes.sum() + 1)
    found, of = T.windows(ids, sizes)
    base = np.cumsum(sizes) - sizes
    for k, n in enumerate(sizes):
        own = found[of == k]
        assert set(own[own > 0]) == set(range(base[k] + 1, base[k] + n + 1))
        starts = [w[0] for w in own if w[0]]
        assert all(b - a <= T.STRIDE for a, b in zip(starts, starts[1:])) and len(own) >= 1


def test_short_passages_lie_whole_in_a_window():
    sizes = np.array([400])
    found, _ = T.windows(np.arange(1, 401), sizes)
    for n in range(1, T.LENGTH // 2 + 2):
        assert all(any({i, i + n - 1} <= set(w) for w in found.tolist()) for i in range(1, 402 - n))


def test_long_words_are_read_whole():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 64, 65, 123, 124, 1000):
        inner = "".join(rng.choice(list("ab_-é中"), max(0, n - 2)))
        word = "--" + ("x" + inner + "y")[:n] + "_." * 40
        pieces = T.plain_words(T.words_of(f"a {word} b"))
        plain = T.EDGE.sub("", word).lower()
        assert pieces[0] == "a" and pieces[-1] == "b" and all(len(p) <= T.PIECE for p in pieces)
        for size in (1, 6):
            assert {plain[i : i + size] for i in range(len(plain) - size + 1)} <= {p[i : i + size] for p in pieces[1:-1] for i in range(len(p) - size + 1)}
    assert T.words_of("İ" * 64) == ["İ" * 64] and len(T._grams(["i̇" * 64])[0]) == 4 * 131 - 2 - 3 - 4 - 5


def test_toxic_passage_late_in_unspaced_text():
    rng = np.random.default_rng(5)
    plain = lambda: "".join(rng.choice(list("天地人你我他好大小上下中"), 300))
    clean = [plain() + plain()[:60] for _ in range(430)]
    toxic = [plain() + "笨蛋白痴滚开" * 3 + plain()[:42] for _ in range(430)]
    model = T.train(clean[:400] + toxic[:400], [0] * 400 + [1] * 400, 0.5)
    low, high = T.Scorer(model).score(clean[400:]), T.Scorer(model).score(toxic[400:])
    assert (low < T.THRESHOLD).mean() > 0.9 and (high >= T.THRESHOLD).mean() > 0.9


def test_gradients():
    rng = np.random.default_rng(0)
    words = ["idiot", "the", "a", "über", "", "x" * 90]
    model = T.train([], [], 0.5)
    model.vocab = {"the": 1, "a": 2}
    model.p["Ew"] = rng.standard_normal((3, T.WIDTH)) * 0.3
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    feats = model.inputs(words)
    counts = np.diff(np.append(feats[2], len(feats[1])))
    ids = np.array([[1, 2, 3, 0], [4, 1, 6, 5], [0, 0, 0, 0], [2, 2, 2, 1]])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss():
        table = np.concatenate([np.zeros((1, 6 * T.UNITS)), model.project(model.embed(*feats))])
        part, mask, k = ids.T, ids.T > 0, 3 * T.UNITS
        hf = T._gru(table[part, :k], model.p["Uf"], mask)
        hb = T._gru(table[part[::-1], k:], model.p["Ub"], mask[::-1])[::-1]
        q = T._sigmoid(T._pool(model.p, hf, hb, mask)[0] @ model.p["wo"] + model.p["bo"][0])
        return -(weight * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum() / len(y)

    # Rows without words have no input: the padding row is zero, whatever the biases.
    grads = T._gradients(model, ids, y, weight, feats, counts)
    for name in ("Wf", "Ub", "va", "wo", "bo", "Ew", "bf", "Ec"):
        flat, g = model.p[name].reshape(-1), grads[name].reshape(-1)
        for i in ([int(np.argmax(np.abs(g)))] if name in ("Ec", "Ew") else rng.choice(len(flat), min(4, len(flat)), replace=False)):
            was, e = flat[i], 1e-5
            flat[i] = was + e
            up = loss()
            flat[i] = was - e
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * e) - g[i]) < 2e-4, name


def test_forward_pass_word_by_word():
    """Window logits and a text's features against plain loops over words and units."""
    from math import exp, log, tanh

    rng = np.random.default_rng(2)
    words = "you idiot the a of über x y z and so on".split()
    model = T.train([], [], 0.5)
    model.vocab = {"the": 1, "a": 2}
    model.p = {k: v + rng.standard_normal(v.shape) * 0.2 for k, v in (model.p | {"Ew": rng.standard_normal((3, T.WIDTH))}).items()}
    p, K, W = model.p, T.UNITS, T.WIDTH
    text = [words[i] for i in rng.integers(0, len(words), 3 * T.LENGTH + 5)]

    def embedded(w):
        grams = []
        marked = f"^{w}$"
        for n in (3, 4, 5, 6):
            for i in range(len(marked) + 1 - n + 1):
                h = 0
                for c in (marked + "$")[i : i + n]:
                    h = (h * 0x9E3779B1 + ord(c)) % 2**64
                grams.append((h * 0x9E3779B97F4A7C15 % 2**64) >> 50)
        return list(p["Ew"][model.vocab.get(w, 0)]) + [sum(p["Ec"][g][j] for g in grams) / len(grams) ** 0.5 for j in range(W)]

    def states(xs, d):
        h, out = [0.0] * K, []
        for x in xs:
            a = [sum(x[j] * p["W" + d][j][c] for j in range(2 * W)) + p["b" + d][c] for c in range(3 * K)]
            u = [sum(h[j] * p["U" + d][j][c] for j in range(K)) for c in range(3 * K)]
            z = [1 / (1 + exp(-a[c] - u[c])) for c in range(2 * K)]
            n = [tanh(a[2 * K + c] + z[K + c] * u[2 * K + c]) for c in range(K)]
            h = [n[c] + z[c] * (h[c] - n[c]) for c in range(K)]
            out.append(h)
        return out

    def logit(ws):
        xs = [embedded(w) for w in ws]
        both = [f + b for f, b in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])]
        e = [exp(sum(v * x for v, x in zip(p["va"], h))) for h in both]
        return sum(p["wo"][c] * sum(w * h[c] for w, h in zip(e, both)) / sum(e) for c in range(2 * K)) + p["bo"][0]

    starts = sorted({*range(0, len(text) - T.LENGTH, T.STRIDE), len(text) - T.LENGTH})
    wanted = sorted((logit(text[i : i + T.LENGTH]) for i in starts), reverse=True)
    model.final = np.array([0.7, -0.4, 0.1, 0.2])
    score = 1 / (1 + exp(-(model.final @ [wanted[0], sum(wanted[:3]) / 3, log(len(wanted)), 1])))
    assert abs(T.Scorer(model).score([" ".join(text)])[0] - score) < 2e-5
    assert abs(T.Scorer(model).score(["so on"])[0] - 1 / (1 + exp(-(0.3 * logit(["so", "on"]) + 0.2)))) < 2e-5


def test_parts_change_nothing(monkeypatch):
    """Words and windows worked on in small parts give what they give all at once."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abé中-"), rng.integers(1, 12))) for _ in range(100)] + ["", " " + "x" * 64]
    model = T.train([], [], 0.5)
    model.vocab = {w: 1 + i % 2 for i, w in enumerate(words[:50])}
    model.p["Ew"] = rng.standard_normal((3, T.WIDTH)).astype(np.float32)
    sizes = np.array([0, 1, 500, T.LENGTH, 0, 777])
    ids = np.arange(1, sizes.sum() + 1)

    def made():
        inputs = model.inputs(words)
        return *inputs, model.table(*inputs), *T.windows(ids, sizes)

    whole = made()
    for part in (1, 7, 102):
        monkeypatch.setattr(T, "PART", part)
        for x, y in zip(whole, made()):
            assert x.dtype == y.dtype and x.shape == y.shape and np.allclose(x, y, rtol=0, atol=1e-6)
    assert not whole[4][0].any() and np.array_equal(whole[4][1:], model.project(model.embed(*whole[:4])))


def test_training_holds_little_beside_its_sample():
    """The driver trains: with many distinct words, n-grams and windows, its peak stays near what it has to keep (34 MB; 93 all at once)."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"{a:x}" for a in rng.integers(1 << 28, 1 << 31, 400)) for _ in range(200)]
    tracemalloc.start()
    T.train(texts, [0, 1] * 100, 0.5, epochs=1, few=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_few_labels(spark):
    """With some thirty toxic texts to learn from, held-out ones are still told apart."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in T.score_documents(documents(spark, SF), labels).collect()}
    test = [(r.toxic, got[r.doc_id].score) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    pairs = [(a > b) + (a == b) / 2 for t, a in test if t for u, b in test if not u]
    assert sum(pairs) / len(pairs) > 0.78


def test_scores(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = documents(spark, "/root/testdata/sf0.1")
    got = {r.doc_id: r for r in T.score_documents(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    test = [(r.toxic, got[r.doc_id]) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    hit = sum(t and r.predicted for t, r in test)
    assert hit / sum(t for t, _ in test) > 0.8 and hit / sum(r.predicted for _, r in test) > 0.9


def test_odd_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(1, "", "en"), (None, None, None), (2, "idiot " * 30000, ""), (3, "x" * 50000, ""), (2, "idiot " * 30000, ""), (5, "퟿ 中文 \x00", "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = T.fit(documents(spark, SF), labels, sample=100)
    from pyspark.sql import functions as F

    got = odd.select("doc_id", T.score_column(spark, model, F.col("text")).alias("s")).collect()
    assert len(got) == 6 and all(0 <= r.s <= 1 for r in got) and abs(got[2].s - got[4].s) < 2e-6 and got[0].s == got[1].s == 0
    assert T.score_documents(odd, labels.limit(0)).count() == 6
    assert T.score_documents(odd.limit(0), labels).count() == 0
    kept = T.without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= 6
    nulls = spark.createDataFrame([(None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    assert T.score_documents(odd, labels.unionByName(nulls)).count() == 6

import hashlib
import io
import math
import random

import numpy as np
import pytest

from gridloom.llm import topk, warc


def brute(rows, k=20, every=20):
    """Each row against all others, by row: repeated ids are rows of their own."""
    known = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, w) in enumerate(known):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for m, (i, v) in enumerate(known) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def as_rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_top_k(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert as_rows(topk.top_k(df)) == brute(rows)
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "LEAST", 16)
    assert as_rows(topk.top_k(df)) == brute(rows)


def test_odd_vectors(spark):
    rows = [(i, [0.5, 0.25]) for i in range(60)] + [(60, None), (80, [float("nan"), 1.0]), (100, [None, 1.0]), (120, []), (140, [1.0]), (160, [-1.0, 0.0, 2.0]), (None, [1.0, 1.0]), (180, [float("inf")]), (20, [9.0, 9.0]), (161, [0.0, 0.0]), (-20, [-0.01, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    assert as_rows(topk.top_k(df)) == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 40")).count() == 0
    again = rows[:4] * 30 + [(20, [0.5, 0.25])] * 25 + [(40, [0.5, 0.25 + i]) for i in range(3)]
    assert as_rows(topk.top_k(spark.createDataFrame(again, "vec_id long, embedding array<double>"))) == brute(again)


def test_large_components(spark):
    """Exact wherever a score fits 64 bits; beyond, scores stop at its ends."""
    big = [1.5e6, 2e6, 2.0**21, 2.0**30 + 0.25, 3e7, -(2.0**40), 2.0**56, 1e30]
    rows = [(i, [0.5 * (i % 7), -0.25, 1.0]) for i in range(40)] + [(41 + i, [b, -b, 0.5 * i]) for i, b in enumerate(big)] + [(60, [2.0**22, 1.0, 0.0]), (80, [1.0, 1.0, 1.0]), (80, [1.0, 1.0, 2.0**30]), (81, [2.0**23, 0.5]), (100, [1e30, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    MOST = (1 << 63) - 1
    stop = lambda s: max(-MOST, min(MOST, s))
    want = []
    for n, (q, w) in enumerate(rows):
        if q % 20 == 0:
            whole = [math.floor(64 * x) for x in w]
            every = sorted((-stop(sum(a * math.floor(64 * b) for a, b in zip(whole, v))), i) for m, (i, v) in enumerate(rows) if m != n)[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(every)]
    assert as_rows(topk.top_k(df)) == sorted(want)
    assert any(abs(s) == MOST for *_, s in want) and any(1 << 26 < abs(s) < MOST for *_, s in want)


def test_early_stop_keeps_ties():
    """Skewed lists stop early; large and tied values stay exact."""
    rng = np.random.default_rng(0)
    for top in (9, 1 << 26):
        rows = np.minimum(rng.geometric(0.3, (20_000, 3)), 9) * (top // 9)
        ids = rng.permutation(20_000)
        queries = rows[:25] * np.array([1, -1, 0])
        got = topk.Lists(ids, rows, 20).search(ids[:25], queries, 20)
        for i in range(25):
            score, itself = rows @ queries[i], (ids == ids[i]) & (rows == queries[i]).all(axis=1)
            want = sorted((-s, d) for s, d, o in zip(score.tolist(), ids.tolist(), itself) if not o)[:20]
            assert [(-s, d) for n, d, s in got if n == i] == want


def test_blocks_of_64_dimensions_go_down_the_lists(spark, monkeypatch):
    """All queries begin by sorted access; on skewed rows, or with a floor from elsewhere, the bound stops them there."""
    rng = np.random.default_rng(1)
    met, best = [], topk.Lists.best
    monkeypatch.setattr(topk.Lists, "best", lambda self, q, own, rows, *a: met.append(len(rows)) or best(self, q, own, rows, *a))
    real = np.floor(64 * np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(7000).collect()]))
    alike, skewed = rng.integers(-40, 40, (7000, 64)), np.ceil(np.exp(2 * rng.standard_normal((20_000, 1)))) * rng.integers(50, 60, (20_000, 64))
    for rows, stops in ((alike, False), (skewed, True), (real, False)):
        rows, ids = rows.astype(np.int64), rng.permutation(len(rows))
        lists = topk.Lists(ids, rows, 20)
        met.clear()
        got = lists.search(ids[:30], rows[:30], 20)
        assert sum(n < len(rows) / 2 for n in met) >= 30 and any(n >= len(lists.rows) for n in met) != stops
        for i in range(30):
            want = sorted((-s, d) for s, d in zip((rows @ rows[i]).tolist(), ids.tolist()) if d != ids[i])[:20]
            assert [(-s, d) for n, d, s in got if n == i] == want
        met.clear()
        floors = np.array([max(s for n, _, s in got if n == i) for i in range(30)])
        assert [g for g in got if g[2] >= floors[g[0]]] == lists.search(ids[:30], rows[:30], 20, floors)
        over = np.abs(rows[:30]).sum(axis=1) * np.abs(rows).max() + 1
        met.clear()
        assert lists.search(ids[:30], rows[:30], 20, over) == [] and not met


def test_records_round_trip():
    rng = random.Random(1)
    payloads = [b"", b"x", bytes(rng.randrange(256) for _ in range(300_000)), b"a\r\n\r\nWARC/1.1\r\n" * 50, "é🙂".encode() * 999]
    data = b"".join(warc.record(i, f"http://h/{i}\r\nx", p) for i, p in enumerate(payloads)) + warc.record(9, None, payloads[2], refers_to=2)
    got = list(warc.read_records(io.BytesIO(data), keep=True))
    assert [r.payload for r in got[:-1]] == payloads
    assert all(r.payload_digest == hashlib.sha256(p).hexdigest() and r.payload_bytes == len(p) for r, p in zip(got, payloads))
    last = got[-1]
    assert last.payload == b"" and last.payload_bytes == 300_000 and last.payload_digest == got[2].payload_digest and last.headers["warc-refers-to"] == got[2].headers["warc-record-id"]
    assert list(warc.read_records(io.BytesIO(b""))) == []


def test_long_urls(spark):
    rng = random.Random(2)
    for url in ("http://h/" + "x" * 3_000_000, "http://h/" + "".join(rng.choices("abcdefgh0123", k=3_000_000)), "http://h/" + "é" * 1_500_000):
        data = warc.record(1, url, b"p" * 200) + warc.record(2, "u", b"q")
        got = list(warc.read_records(io.BytesIO(data), keep=True))
        assert got[0].headers["warc-target-uri"] == url and [r.payload for r in got] == [b"p" * 200, b"q"]
    df = spark.createDataFrame([(i, "http://h/" + "x" * (2_000_000 if i < 4 else 5), f"<p>{i}</p>") for i in range(8)], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df)).collect()
    assert sorted((r.page_id, len(r.url)) for r in got) == [(i, 2_000_009 if i < 4 else 14) for i in range(8)]


def test_broken_archives():
    import gzip

    good = warc.record(1, "u", b"hello" * 100)
    plain = gzip.decompress(good)
    for bad in (good[:-12], plain, gzip.compress(plain.replace(b"hellohello", b"hellohellp", 1)), gzip.compress(plain[:-4]), gzip.compress(plain + b"x"), gzip.compress(plain.replace(b"WARC/1.1", b"XARC/1.1")), good + b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def test_pages(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i % 7}</p>" * (1 if i % 2 else 30)) for i in range(50)]
    rows += [(60, None, None), (61, "", ""), (None, "u", rows[0][2]), (None, None, "only null" * 40), (None, "x", "only null" * 40), (0, "again", rows[0][2]), (-5, "é\n", rows[2][2]), (70, "u", "é" * 500_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, lead int")
    low = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            low[h] = min(low.get(h, i), i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = low.get(h) if i is not None and h in low and low[h] < i else None
        want.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "response" if to is None else "revisit", str(to)))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.archive_pages(df).collect()]
    assert sorted(got) == sorted(want)
    assert warc.archive_pages(df.limit(0)).count() == 0
    manifest = warc.write_archives(df)
    kept = []
    for r in manifest.collect():
        where, path = warc._place(r.path)
        with where.open_input_stream(path) as f:
            kept += [(x.payload, x.headers["warc-type"]) for x in warc.read_records(f, keep=True)]
    assert sorted(p for p, t in kept if t == "response") == sorted((h or "").encode() for (i, _, h), w in zip(rows, want) if w[3] == "response")

import hashlib

import corpus_pipeline
from tokenizers import Tokenizer

import __spark_entry__
from gridloom.llm import bpe
from gridloom.llm.common import documents, word_count, written
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near

SF = "/root/testdata/sf0.01"


def test_stages_agree_with_brute_force(spark):
    docs = documents(spark, SF)
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), "test-" + name)
        by[name] = docs.collect(), out.collect()
        assert name == "bpe" or out.columns == docs.columns
        docs = out
    was, now = by["toxicity"]
    assert 0.85 * len(was) < len(now) < len(was) and set(now) <= set(was)
    was, now = by["line_dedup"]
    want = brute_lines([(r.doc_id, r.text, 0) for r in was], 50)
    assert sorted((str(r.doc_id), r.text) for r in now) == [(d, t) for d, t in want if t or (d, t) in {(str(r.doc_id), r.text) for r in was}]
    was, now = by["near_dedup"]
    want = {d for d, _, c in brute_near([(r.doc_id, r.text) for r in was], corpus_pipeline.minhash.Rule(5, 80)) if d == c}
    assert {str(r.doc_id) for r in now} == want and set(now) <= set(was)
    was, now = by["mixing"]
    assert set(now) <= set(was) and max(now.count(r) for r in set(now)) == 2
    sizes = {r.doc_id: len(r.text.split()) for r in was}
    total = sum(sizes.values())
    assert 1.35 * total < sum(sizes[r.doc_id] for r in now) < 1.65 * total
    library = Tokenizer.from_file(bpe.VOCABULARY)
    was, now = by["bpe"]
    want = []
    for r in was:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in now) == sorted(want)
    again = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, now))


def test_odd_documents(spark):
    rows = [(1, "", "x"), (None, None, None), (2, "a b c", "s"), (2, "a b c", "s"), (3, "a b c d e f", None), (None, "a b c d e f", "s")]
    docs = spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), 7, "z") for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, kept string")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, frame, SF), "odd-" + name)
            assert name == "bpe" or out.columns == frame.columns
            frame = out

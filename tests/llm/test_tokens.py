import hashlib
import itertools
import random
import re

import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe, unigram
from gridloom.llm.common import documents

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, t string, n_tokens string"
ODD = ["", " ", "Hello 're world's <|startoftext|>İX ΑΣ ss12", "<|endoftext|><|endoftext|>x<|endof", "a\x1cb\x1fc\x85d\xa0e", "x" * 3000, "ÀÉ é ﬁ Ᲊ 中文 🙂🙂 ​ཱི", "don't!!! 123 456,789 ½²", "\x00\x01\x7f\x80\xad", "word " * 20000, "'S 'lLama we'LL", "﻿bom  line"]


@pytest.fixture(scope="module")
def pair():
    with open(bpe.VOCABULARY, encoding="utf-8") as f:
        source = f.read()
    return Tokenizer.from_str(source), bpe.Codec(source)


def test_encoding_is_the_librarys(pair, spark):
    library, codec = pair
    texts = ODD + [r.text for r in documents(spark, SF).collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("aeinst'l 09!<|>é") for _ in range(40)) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(30)) for _ in range(300)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == want, t[:80]
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_stable_characters(pair):
    """Each character below U+0250, alone and within a word, as the library has it."""
    library, codec = pair
    for c in map(chr, range(0x250)):
        t = f"a{c}b {c} {c}{c}"
        assert codec.encode(t) == library.encode(t, add_special_tokens=False).ids, hex(ord(c))
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} - set(map(chr, range(0x1C, 0x20))) == {c for c in map(chr, range(0x110000)) if bpe.SPACE.match(c)}


def test_small_tries_give_the_same(pair):
    _, codec = pair
    words = ["".join(p) for n in (1, 2, 3, 4, 5) for p in itertools.product("thea", repeat=n)]
    small = bpe.WordTrie(codec.trie.vocab, sorted(codec.trie.rank, key=codec.trie.rank.get), max_nodes=50, max_path=4)
    plain = {w: [codec.trie.vocab[t] for t in codec.trie.merged(codec.trie.symbols(w + bpe.END))] for w in words}
    assert small.encode(words) == codec.trie.encode(words) == plain


def test_documents(spark, pair):
    library, _ = pair
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(None, None, None, None), (1, "again", "", ""), (1, "again", "", "")]
    got = bpe.encode_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def brute(word, scores, floor):
    """The best of all segmentations, written as another recurrence: from the end."""
    best = [(0.0, 0)]
    for i in range(len(word) - 1, -1, -1):
        found = []
        for j in range(i + 1, len(word) + 1):
            s, n = best[len(word) - j]
            if word[i:j] in scores:
                found.append((s + scores[word[i:j]], -(n + 1)))
            elif j == i + 1:
                size = len(word[i].encode())
                found.append((s + size * floor, -(n + size)))
        s, n = max(found)
        best.append((s, -n))
    return best[-1]


def test_unigram_counts(spark):
    with open(unigram.VOCABULARY, "rb") as f:
        counter = unigram.Counter(f.read())
    words = {"the", "unbelievable", "ering", "中文", "🙂x", "aaaaaaaaaaaaaaaa", "donaudampfschifffahrt"} | {w for r in documents(spark, SF).limit(40).collect() for w in r.text.split()[:60]}
    words = {unigram.SPACE + w for w in words}
    for word, states in counter.trie.walk(words):
        want = brute(word, counter.trie.scores, counter.trie.floor)
        assert abs(states[-1][0] - want[0]) < 1e-6 and states[-1][1] == want[1], word
    small = unigram.UnigramTrie(counter.trie.scores, max_nodes=20, max_path=6)
    assert small.counts(words) == counter.trie.counts(words)


def test_unigram_documents(spark):
    rows = [(1, "a b c", "", ""), (1, "a b c", "", ""), (None, None, None, None), (2, "", "", ""), (3, "x" * 20000, "", ""), (4, " \t", "", "")]
    got = {(r.doc_id, r.n_words, r.n_tokens > 0) for r in unigram.count_tokens(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 3, True), (None, 0, False), (2, 0, False), (3, 1, True), (4, 0, False)}
    assert unigram.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_borders_agree_with_plain_merging(pair):
    """Two whole tokens stay apart just if merging the symbols of both gives back the two."""
    _, codec = pair
    trie, rng = codec.trie, random.Random(6)
    inner = [t for t in list(trie.vocab)[:6000] if not t.endswith(bpe.END) and trie.follows(None, t)]
    anyhow = [t for t in list(trie.vocab)[:6000] if trie.follows(None, t)]
    for _ in range(20_000):
        a, b = rng.choice(inner), rng.choice(anyhow)
        assert trie.apart(a, b) == (trie.merged(trie.symbols(a) + trie.symbols(b)) == [a, b]), (a, b)
    for t in "aeiou":
        for u in ("a", "e", "aa", "ee", "aa" + bpe.END, "i" + bpe.END):
            assert trie.apart(t, u) == (trie.merged(trie.symbols(t) + trie.symbols(u)) == [t, u]) if trie.follows(None, t) and u in trie.vocab and trie.follows(None, u) else True


def test_counts_agree_with_the_tokenizers_library(spark):
    """Whole-text counts against the library's own Unigram model of the same pieces and scores."""
    from tokenizers import models

    with open(unigram.VOCABULARY, "rb") as f:
        scores = unigram.piece_scores(f.read())
    vocab = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", min(scores.values()) - 10) for b in range(256)] + list(scores.items())
    theirs = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    rows = documents(spark, SF).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in unigram.count_tokens(documents(spark, SF)).collect()}
    known, far = {}, 0
    for r in rows:
        words = re.findall(unigram.WORD, r.text or "")
        for w in set(words) - known.keys():
            known[w] = len(theirs.encode(unigram.SPACE + w, add_special_tokens=False).ids)
        assert got[r.doc_id].n_words == len(words)
        far += abs(got[r.doc_id].n_tokens - sum(known[w] for w in words))
    total = sum(r.n_tokens for r in got.values())
    assert far <= 1e-4 * total, (far, total)

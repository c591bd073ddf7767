"""BPE encoding and decoding: a trie of distinct words, each prefix's last token found once."""

from __future__ import annotations

import gc
import hashlib
import json
import re
from itertools import chain

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm.common import held_by, ship
from gridloom.llm.trie import Trie

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = "</w>"
#: How the vocabulary's file splits lower-case text (fixed value).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"\s+")
#: Characters on which str.split and \s differ.
CONTROL = re.compile("[\x1c-\x1f]")
#: Below this, no character takes part in composition, and all Unicode versions agree on classes and cases.
STABLE = re.compile("[^\x00-ɏ]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class WordTrie(Trie):
    """State: (last token of the prefix's encoding, its length in symbols), one object for each token.

    The encoding of a prefix ends in the one token t that is a suffix of it, is its own encoding, and
    may follow the last token of what precedes it; two tokens may be neighbours if merging their
    symbols gives back just the two. So an encoding is read backwards along the states.
    """

    def __init__(self, vocab: dict[str, int], merges: list, **bounds):
        self.vocab, self.rank = vocab, {tuple(m): i for i, m in enumerate(merges)}
        self.own = {t: (t, len(self.symbols(t))) for t in vocab}
        self.longest = max(n for _, n in self.own.values())
        self.whole: dict[str, bool] = {}
        self.halves: dict[str, tuple] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        super().__init__(**bounds)

    def begin(self):
        return None, 0  # nothing precedes

    def symbols(self, token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the lowest-ranked pair is merged, the leftmost first."""
        while len(symbols) > 1:
            rank, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def follows(self, before: str | None, token: str) -> bool:
        """Whether merging the symbols of both gives back just the two, or with no `before` token itself."""
        if before is None:
            found = self.whole.get(token)
            if found is None:
                found = self.whole[token] = self.merged(self.symbols(token)) == [token]
                if found and token not in self.halves:
                    self.split(token)
            return found
        key = before, token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 150_000:
                self.pairs.clear()
            found = self.pairs[key] = self.follows(None, token) and self.apart(before, token)
        return found

    def split(self, token: str) -> None:
        """The rank of the merge that makes a token, and the two tokens merged; -1 for a symbol."""
        symbols, last = self.symbols(token), (-1, None, None)
        if len(symbols) > 1:
            pairs = [symbols]
            while len(symbols) > 2:
                rank, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
                symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
                pairs.append(symbols)
            last = self.rank[symbols[0], symbols[1]], symbols[0], symbols[1]
        self.halves[token] = last
        for half in last[1:]:
            if half is not None and half not in self.halves:
                self.split(half)

    def apart(self, before: str, token: str) -> bool:
        """Whether no merge ever crosses the border of two whole tokens.

        Their making is run backwards: of the two tokens at the border the one made later is undone, and at
        each stage the merge of both must come after one of them has been merged into its own parent
        (of equal ranks the left one comes first).
        """
        rank, halves, left_by, right_by = self.rank, self.halves, 1 << 60, 1 << 60
        while True:
            crossing = rank.get((before, token))
            if crossing is not None and crossing < left_by and crossing <= right_by:
                return False
            a, b = halves[before], halves[token]
            if a[0] > b[0]:
                left_by, before = a[0], a[2]
            elif b[0] >= 0:
                right_by, token = b[0], b[1]
            else:
                return True

    def step(self, word, d, states, last):
        """Just one place fits; first tried are where the token before began, and the last symbol alone."""
        tail, own, pairs = END if last else "", self.own, self.pairs
        n = states[d - 1][1]
        for j in (d - 1 - n, d - 1) if n else (d - 1,):
            state = own.get(word[j:d] + tail)
            if state is not None:
                before = states[j][0]
                fits = pairs.get((before, state[0]))
                if fits or fits is None and self.follows(before, state[0]):
                    return state
        for j in range(d - 2, max(-1, d - 1 - self.longest), -1):
            state = own.get(word[j:d] + tail)
            if state is not None:
                before = states[j][0]
                fits = pairs.get((before, state[0]))
                if fits or fits is None and self.follows(before, state[0]):
                    return state
        raise ValueError(f"no token ends at {d} in {word[:40]!r}")

    def encode(self, words) -> dict[str, list[int]]:
        out, vocab = {}, self.vocab
        for word, states in self.walk(words):
            d, ids = len(word), []
            while d:
                token, n = states[d]
                d -= n
                ids.append(vocab[token])
            ids.reverse()
            out[word] = ids
        return out


class Codec:
    """Encoder and decoder of texts for one vocabulary file; caches are bounded."""

    def __init__(self, source: str, max_chunks: int = 200_000):
        model = json.loads(source)
        self.library = Tokenizer.from_str(source)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        vocab = model["model"]["vocab"]
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.shown = {i: str(i) for i in self.names}
        self.trie, self.bytes = WordTrie(vocab, model["model"]["merges"], max_nodes=200_000), dict(enumerate(byte_alphabet()))
        self.max_chunks = max_chunks
        #: Of each chunk met: its ids as text, and what they decode to.
        self.known: dict[str, tuple[str, str]] = {}

    def words(self, chunk: str) -> list:
        """A chunk of text without white space as words in the byte alphabet; special tokens as their ids."""
        if self.apart and "<" in chunk and self.apart.search(chunk):
            return [x for part in self.apart.split(chunk) if part for x in ([self.special[part]] if part in self.special else self.words(part))]
        if STABLE.search(chunk):  # the library's own Unicode tables decide
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]
        low = chunk.lower()
        found = [low] if low.isalpha() else SPLIT.findall(low)
        return found if chunk.isascii() and chunk.isprintable() else [w.encode().decode("latin-1").translate(self.bytes) for w in found]

    def chunks(self, text: str) -> list[str]:
        return [c for c in SPACE.split(text) if c] if CONTROL.search(text) else text.split()

    def learn(self, chunks) -> None:
        """Encode the chunks not met yet: their distinct words go through the trie in one traversal."""
        split = {c: self.words(c) for c in chunks.difference(self.known)}
        found = self.trie.encode({w for ws in split.values() for w in ws if w.__class__ is str})
        known, shown, names = self.known, self.shown, self.names
        for c, ws in split.items():
            ids = found.get(ws[0]) if len(ws) == 1 else None
            if ids is None:
                ids = [i for w in ws for i in (found[w] if w.__class__ is str else [w])]
            known[c] = " ".join([shown[i] for i in ids]), " ".join([names[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's file names no decoder: tokens are joined by spaces."""
        return " ".join([self.names[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        self.learn(set(chunks))
        return [int(i) for c in chunks for i in self.known[c][0].split()]

    def digests(self, texts: list[str]):
        """(number of tokens, SHA-256 of the ids, SHA-256 of the decoded text) of each text."""
        if len(self.known) > self.max_chunks:
            self.known.clear()
        # Nothing here makes cycles, and the collector would walk the caches again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            split = [self.chunks(t) for t in texts]
            self.learn(set(chain.from_iterable(split)))
            out = []
            for cs in split:
                found = list(map(self.known.__getitem__, cs))
                ids = " ".join([i for i, _ in found])
                out.append((ids.count(" ") + 1 if cs else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(" ".join([t for _, t in found]).encode()).hexdigest()))
            return out
        finally:
            if collecting:
                gc.enable()


def codec(source: str) -> Codec:
    """One codec a Python worker."""
    kept, key = held_by("bpe"), hashlib.sha256(source.encode()).hexdigest()
    if key not in kept:
        kept.clear()
        kept[key] = Codec(source)
    return kept[key]


def by_size(texts, chars: int = 1_000_000):
    """Runs of texts of about so many characters, so that a traversal has much to share but bounded memory."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= chars:
            yield run
            run, n = [], 0
    if run:
        yield run


def digest_column(df: DataFrame, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """A struct n_tokens, ids_sha256, decoded_sha256 for each text. The vocabulary, a file of the driver's of fixed size, is broadcast."""
    ship(df.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: pd.Series) -> pd.DataFrame:
        own = codec(source.value)
        rows = [x for run in by_size(batches.fillna("")) for x in own.digests(run)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token count and digests of every whole text, encoded and decoded again.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256. Null texts count as empty: no tokens, the digests
    of the empty string. A row with a null or repeated doc_id is encoded as any other; an empty table gives
    no rows; other columns are ignored. No shuffle: each task shares prefixes among the words it meets.
    """
    return docs.select("doc_id", digest_column(docs, F.col("text"), vocabulary).alias("t")).select("doc_id", "t.*")

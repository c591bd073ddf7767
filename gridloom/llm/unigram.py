"""Token counts under a unigram model: forward scores along a trie, each shared prefix scored once."""

from __future__ import annotations

import math
import re

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import by_size
from gridloom.llm.common import WORD, held_by, ship
from gridloom.llm.trie import Trie

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
WORDS = re.compile(WORD)


def piece_scores(model: bytes) -> dict[str, float]:
    """The log probability of each piece, by Zipf's law over its rank in the vocabulary.

    The vocabulary's file holds merge ranks, not probabilities, and tokenizers are not trained here;
    rank r gets 1 / (r + 1), normalised. Control, unknown and byte pieces are left out.
    """
    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {t: -math.log(r + 1) - total for r, t in enumerate(pieces)}


class UnigramTrie(Trie):
    """State: (best score of the prefix, tokens of the segmentation that has it).

    A character in no piece is its UTF-8 bytes, each one token of a score 10 below the lowest. Of equal
    scores the one with fewer tokens counts, then the one whose last piece is shorter.
    """

    def __init__(self, scores: dict[str, float], **bounds):
        self.scores, self.longest = scores, max(map(len, scores))
        self.floor = min(scores.values()) - 10
        super().__init__(**bounds)

    def begin(self):
        return 0.0, 0

    def step(self, word, d, states, last):
        best = None
        for j in range(d - 1, max(-1, d - 1 - self.longest), -1):
            score = self.scores.get(word[j:d])
            if score is not None:
                s, n = states[j]
                if best is None or s + score > best[0] or s + score == best[0] and n + 1 < best[1]:
                    best = s + score, n + 1
        if best is None or word[d - 1] not in self.scores:
            s, n = states[d - 1]
            size = len(word[d - 1].encode("utf-8", "surrogatepass"))
            if best is None or s + size * self.floor > best[0]:
                best = s + size * self.floor, n + size
        return best

    def counts(self, words) -> dict[str, int]:
        return {word: states[-1][1] for word, states in self.walk(words)}


class Counter:
    def __init__(self, model: bytes, max_words: int = 200_000):
        self.trie, self.known, self.max_words = UnigramTrie(piece_scores(model), max_nodes=200_000), {}, max_words

    def count(self, texts: list[str]):
        split = [WORDS.findall(t) for t in texts]
        if len(self.known) > self.max_words:
            self.known.clear()
        new = {w for ws in split for w in ws}.difference(self.known)
        self.known |= {w[1:]: n for w, n in self.trie.counts({SPACE + w for w in new}).items()}
        return [(len(ws), sum(map(self.known.__getitem__, ws))) for ws in split]


def count_column(df: DataFrame, text: Column, vocabulary: str = VOCABULARY) -> Column:
    ship(df.sparkSession)
    with open(vocabulary, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("n_words long, n_tokens long")
    def count(texts: pd.Series) -> pd.DataFrame:
        kept = held_by("unigram")
        if kept.get("model") != model.value:
            kept |= {"model": model.value, "counter": Counter(model.value)}
        rows = [x for run in by_size(texts.fillna("")) for x in kept["counter"].count(run)]
        return pd.DataFrame(rows, columns=["n_words", "n_tokens"])

    return count(text)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Words and unigram tokens of every whole text: doc_id, n_words, n_tokens.

    Pre-tokens are the words with a leading space mark. Null and empty texts count 0; a null or repeated
    doc_id is counted as any other; an empty table gives no rows; other columns are ignored. No shuffle:
    each task has a trie of bounded size and stores the counts at its words' ends.
    """
    return docs.select("doc_id", count_column(docs, F.col("text"), vocabulary).alias("t")).select("doc_id", "t.*")

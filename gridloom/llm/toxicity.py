"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import by_size
from gridloom.llm.common import held_by, release, ship

#: Words of a window, words from one window's start to the next, GRU units a direction, numbers a word and a character input has, n-gram buckets.
LENGTH, STRIDE, UNITS, WIDTH, BUCKETS = 32, 16, 8, 8, 1 << 14  # buckets: 14 bits
#: The classifier is fitted on at most so many labelled documents of each label, none longer than SAMPLE_CHARS.
SAMPLE, SAMPLE_CHARS = 1500, 30_000
THRESHOLD = 0.7
#: Epochs, and below how many toxic texts the sample is parted in so many folds.
EPOCHS, FEW, FOLDS = 14, 200, 3
#: Adam's rate, and its factor from epoch to epoch.
RATE, FALL = 0.01, 0.9
#: Deviations from chance that a word's leaning must exceed to count.
SURE = 2.5
EDGE, INNER = re.compile(r"^[\W_]+|[\W_]+$"), re.compile(r"[^\W_]")
#: A word of over PIECE characters is read in pieces of so many, each with the last LAP characters of the one before.
PIECE, LAP = 64, 5
#: Words whose n-grams, and windows whose words, are worked on at a time: what stands beside the results is bounded by these.
PART = 8192


def words_of(text: str) -> list[str]:
    """The words of a text, that white space parts. A word of over PIECE characters, as in texts without white
    space, stands as its pieces: lower-cased, without its edges and marked by a space in front, which no word
    has. They overlap, so that every n-gram of the word lies whole in some piece.
    """
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    out = []
    for w in words:
        if len(w) <= PIECE:
            out.append(w)
            continue
        first, last = INNER.search(w), INNER.search(w[::-1])
        w = w[first.start() : len(w) - last.start()].lower() if first else ""
        out += [f" {w[i : i + PIECE]}" for i in range(0, max(1, len(w) - LAP), PIECE - LAP)]
    return out


def plain_words(words: list[str]) -> list[str]:
    """Words without their edges, lower-cased; pieces are so already."""
    return [w[1:] if w[:1] == " " else EDGE.sub("", w).lower() for w in words]


def _grams(words: list[str]):
    """Buckets of the character 3- to 6-grams of each word, with its ends marked: all in a row, and how many each has."""
    text = "".join([f"^{w}$$" for w in words])
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(c))
    padded, buckets = np.append(c, np.zeros(5, np.uint64)), np.empty((len(c), 4), np.uint16)
    h = padded[: len(c)] * np.uint64(0x9E3779B1) + padded[1 : 1 + len(c)]
    for k, n in enumerate((3, 4, 5, 6)):
        h = h * np.uint64(0x9E3779B1) + padded[n - 1 : n - 1 + len(c)]
        buckets[:, k] = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
    valid = left[:, None] >= np.array([3, 4, 5, 6])
    return buckets[valid], np.add.reduceat(valid.sum(1), ends - sizes)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    vocab: dict[str, int]
    p: dict[str, np.ndarray]
    #: From (highest window logit, mean of the three highest, log of the number of windows, 1) to the document's logit.
    final: np.ndarray = field(default_factory=lambda: np.array([1.0, 0, 0, 0]))

    def inputs(self, words: list[str]):
        """Word rows, gram buckets, where each word's grams begin, 1 / sqrt(number of grams)."""
        rows, grams, sizes = np.empty(len(words), np.int64), [], []
        for i in range(0, len(words), PART):
            plain = plain_words(words[i : i + PART])
            rows[i : i + PART] = [self.vocab.get(w, 0) for w in plain]
            for out, part in zip((grams, sizes), _grams(plain)):
                out.append(part)
        n = np.concatenate(sizes)
        return rows, np.concatenate(grams), np.cumsum(n) - n, (1 / np.sqrt(n)).astype(np.float32)

    def embed(self, rows, grams, at, scale):
        out = np.empty((len(rows), 2 * WIDTH), self.p["Ec"].dtype)
        out[:, :WIDTH] = self.p["Ew"][rows]
        for i in range(0, len(rows), PART):  # a word has some thirty grams
            j = min(i + PART, len(rows))
            part = grams[at[i] : at[j] if j < len(rows) else len(grams)]
            out[i:j, WIDTH:] = np.add.reduceat(self.p["Ec"][part], at[i:j] - at[i]) * scale[i:j, None]
        return out

    def project(self, e):
        """What every word adds to the gates, for both directions."""
        return np.concatenate([e @ self.p["Wf"] + self.p["bf"], e @ self.p["Wb"] + self.p["bb"]], axis=1)

    def table(self, rows, grams, at, scale):
        """What every word adds to the gates, with a row of zeros in front."""
        e = self.embed(rows, grams, at, scale)
        out = np.zeros((1 + len(e), 6 * UNITS), e.dtype)
        for i in range(0, len(e), PART):
            out[1 + i : 1 + i + PART] = self.project(e[i : i + PART])
        return out


def _gru(x, u, mask, keep=None):
    """x: (length, batch, 3 units); states (length, batch, units). keep: what the backward pass needs."""
    length, batch, k = x.shape[0], x.shape[1], UNITS
    h, out = np.zeros((batch, k), x.dtype), np.empty((length, batch, k), x.dtype)
    for t in range(length):
        a = h @ u
        zr = 1 / (1 + np.exp(-(x[t, :, : 2 * k] + a[:, : 2 * k])))
        n = np.tanh(x[t, :, 2 * k :] + zr[:, k:] * a[:, 2 * k :])
        new = n + zr[:, :k] * (h - n)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep is not None:
            keep.append((h, zr, n, a[:, 2 * k :]))
        h = out[t] = new
    return out


def _gru_back(dout, u, mask, kept):
    """Gradients of the inputs and of u."""
    k, du = UNITS, np.zeros_like(u)
    dx, dh = np.empty((*dout.shape[:2], 3 * k), dout.dtype), np.zeros(dout.shape[1:], dout.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h, zr, n, an = kept[t]
        z, r, d = zr[:, :k], zr[:, k:], dh + dout[t]
        m = mask[t][:, None]
        dn = d * m * (1 - z) * (1 - n * n)
        dz = d * m * (h - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        du += h.T @ da
        dh = d * np.where(m, z, 1) + da @ u.T
    return dx, du


def _pool(p, hf, hb, mask):
    """Attention over the positions -> pooled (batch, 2 units), weights (length, batch)."""
    score = hf @ p["va"][:UNITS] + hb @ p["va"][UNITS:]
    if mask is not None:
        score = np.where(mask, score, -1e9)
    w = np.exp(score - score.max(0))
    if mask is not None:
        w = w * mask
    w /= np.maximum(w.sum(0), 1e-9)
    return np.concatenate([(w[:, :, None] * hf).sum(0), (w[:, :, None] * hb).sum(0)], axis=1), w


def window_logits(p, table, ids, batch: int = 1024):
    """Logits of windows. table: (1 + words, 6 units), row 0 for no word; ids: (windows, length)."""
    out, k = np.empty(len(ids), np.float32), 3 * UNITS
    for i in range(0, len(ids), batch):
        part = ids[i : i + batch].T
        mask = part > 0 if (part == 0).any() else None
        hf = _gru(table[part, :k], p["Uf"], mask)
        hb = _gru(table[part[::-1], k:], p["Ub"], None if mask is None else mask[::-1])[::-1]
        out[i : i + batch] = _pool(p, hf, hb, mask)[0] @ p["wo"] + p["bo"][0]
    return out


def windows(ids: np.ndarray, sizes: np.ndarray):
    """All overlapping windows of texts laid end to end -> (windows, length) of ids, 0 beyond a text; the text of each.

    A text has windows from every STRIDE-th word on, the last one ending at its end; a shorter or empty text has one.
    """
    n = 1 + np.maximum(0, -(-(sizes - LENGTH) // STRIDE))
    of = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(nth * STRIDE, np.maximum(sizes - LENGTH, 0)[of])
    base, padded = np.cumsum(sizes) - sizes, np.append(ids, ids.dtype.type(0))
    out = np.empty((len(of), LENGTH), ids.dtype)
    for i in range(0, len(of), PART):
        own = of[i : i + PART]
        within = start[i : i + PART, None] + np.arange(LENGTH)
        out[i : i + PART] = padded[np.where(within < sizes[own, None], base[own, None] + within, len(ids))]
    return out, of


def text_features(logits: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """(highest logit, mean of the three highest, log of their number, 1) of each text's windows."""
    order = np.lexsort((-logits, of))
    logits, of = logits[order], of[order]
    n = np.bincount(of, minlength=texts)
    first = np.cumsum(n) - n
    top = np.stack([logits[first + np.minimum(i, n - 1)] for i in range(3)])
    return np.stack([top[0], top.mean(0), np.log(n), np.ones(texts)], axis=1)


def leaning(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """How far each word leans to toxic texts, -2 to 2: the deviations beyond SURE by which the toxic texts that
    it stands in exceed what chance gives. One text is added to the variance, so that rare words lean little."""
    share = n_toxic / max(1, n_toxic + n_other)
    expected = (toxic + other) * share
    deviations = (toxic - expected) / np.sqrt(expected * (1 - share) + 1)
    return np.clip(np.sign(deviations) * np.maximum(np.abs(deviations) - SURE, 0) / SURE, -2, 2)


def train(texts: list[str], labels: list[int], positives: float, seed: int = 4, epochs: int = EPOCHS, batch: int = 128, few: int = FEW, folds: int = FOLDS) -> Model:
    """Fit on whole texts. positives: the share of toxic documents among all labelled ones.

    Only a few windows of a toxic text are toxic: each epoch trains on every text's highest windows as
    the model has them by then (after a first epoch on windows at large). A word's first number begins as
    its leaning, so that the first highest windows are not chance.

    The last step goes from a text's highest window logits to its score, and is fitted on texts held back
    from the network: a third of the sample, and of its toxic texts. With fewer than `few` toxic texts, too few
    to do without, each of `folds` parts is held back in turn, the epoch is taken after which the texts held
    back are told apart best, and the network is then fitted on all texts up to that epoch.
    """
    rng = np.random.default_rng(seed)
    labels = np.array(labels, np.float32)
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w, len(number) + 1) for w in words_of(t)], np.int32) for t in texts]
    distinct = list(number)
    del number
    forms: dict[str, int] = {}
    form = np.fromiter((forms.setdefault(w, len(forms)) for w in plain_words(distinct)), np.int32, len(distinct))
    stands_in = [np.unique(form[r - 1]) for r in rows]
    seen = np.bincount(np.concatenate([np.zeros(0, np.int32), *stands_in]), minlength=len(forms))
    common = sorted((-c, w) for w, c in zip(forms, seen.tolist()) if c >= 3)[:20_000]
    vocab = {w: i + 1 for i, (_, w) in enumerate(common)}
    if not texts or labels.min() == labels.max():
        model = Model(vocab, _initial(vocab, rng))
        model.final = np.array([0, 0, 0, np.log((positives + 1e-3) / (1 - positives + 1e-3))])
        return model
    feats = Model(vocab, {}).inputs(distinct or [""])
    ids, of = windows(np.concatenate(rows), np.array([len(r) for r in rows]))
    place = np.zeros(len(forms), np.int32)
    place[[forms[w] for w in vocab]] = list(vocab.values())
    known = [(own := place[ws])[own > 0] for ws in stands_in]
    del distinct, forms, form, rows, stands_in, seen, common, place
    release()
    fold = np.empty(len(texts), int)
    for own in (np.flatnonzero(labels > 0), np.flatnonzero(labels <= 0)):
        fold[rng.permutation(own)] = np.arange(len(own)) % folds

    def network(fit, epochs, after):
        """A network fitted on the texts of fit; after(epoch, logits of the other texts' windows) is called each epoch asked for."""
        model = Model(vocab, _initial(vocab, rng))
        count = lambda own: np.bincount(np.concatenate([known[i] for i in np.flatnonzero(own)] or [np.zeros(0, int)]), minlength=len(vocab) + 1)[1:]
        model.p["Ew"][1:, 0] = leaning(count(fit & (labels > 0)), count(fit & (labels <= 0)), int((fit & (labels > 0)).sum()), int((fit & (labels <= 0)).sum()))
        _descend(model, ids, of, labels, fit, feats, rng, epochs, batch, lambda epoch, table: after(epoch, window_logits(model.p, table(), ids[~fit[of]])) if after else None)
        return model

    def features(held, logits):
        place = np.cumsum(held) - 1
        return text_features(logits, place[of[held[of]]], int(held.sum())).astype(float)

    def last_step(x, y):
        if y.min() == y.max():
            return np.array([1.0, 0, 0, 0]), 0.0
        weight = np.where(y > 0, positives / y.mean(), (1 - positives) / (1 - y.mean()))
        b = _logistic(x, y, weight)
        q = np.clip(_sigmoid(x @ b), 1e-6, 1 - 1e-6)
        return b, -(weight * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum()

    if (labels > 0).sum() >= few:
        held, found = fold == 0, {}
        model = network(~held, epochs, lambda epoch, logits: found.update(logits=logits) if epoch == epochs - 1 else None)
        model.final = last_step(features(held, found["logits"]), labels[held])[0]
        return model
    x = np.zeros((epochs, len(texts), 4))
    for f in range(folds):
        held = fold == f
        if held.any() and not held.all():
            network(~held, epochs, lambda epoch, logits, held=held: x.__setitem__((epoch, held), features(held, logits)))
    steps = [last_step(x[e], labels) for e in range(epochs)]
    best = min(range(epochs), key=lambda e: steps[e][1])
    model = network(np.ones(len(texts), bool), best + 1, None)
    model.final = steps[best][0]
    return model


def _initial(vocab: dict[str, int], rng) -> dict[str, np.ndarray]:
    init = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    p = {"Ew": init(len(vocab) + 1, WIDTH, scale=0.02), "Ec": init(BUCKETS, WIDTH, scale=0.02), "va": init(2 * UNITS, scale=0.3), "wo": init(2 * UNITS, scale=0.3), "bo": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {"W" + d: init(2 * WIDTH, 3 * UNITS, scale=0.3), "U" + d: init(UNITS, 3 * UNITS, scale=0.3), "b" + d: np.zeros(3 * UNITS, np.float32)}
    return p


def _descend(model: Model, ids, of, labels, fit, feats, rng, epochs: int, batch: int, after) -> None:
    """Adam over the windows of the texts of fit, at a rate that falls with each epoch."""
    p, momentum, step = model.p, {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}, 0
    mine = np.flatnonzero(fit[of])
    counts = np.diff(np.append(feats[2], len(feats[1])))
    balance = np.where(labels > 0, 0.5 / max(labels[fit].mean(), 1e-3), 0.5 / max(1 - labels[fit].mean(), 1e-3)).astype(np.float32)
    table = lambda: model.table(*feats)
    for epoch in range(epochs):
        if epoch == 0:
            chosen = rng.permutation(mine)[: 6 * fit.sum()]
        else:
            logits = window_logits(p, table(), ids[mine])
            order = mine[np.lexsort((-logits, of[mine]))]
            first = np.flatnonzero(np.diff(of[order], prepend=-1))
            nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            more = order[(nth >= 2) & (labels[of[order]] == 0)]
            chosen = rng.permutation(np.concatenate([order[nth < 2], rng.choice(more, min(int(fit.sum()) // 2, len(more)), replace=False)]))
        for i in range(0, len(chosen), batch):
            w = chosen[i : i + batch]
            g = _gradients(model, ids[w], labels[of[w]], balance[of[w]], feats, counts)
            step += 1
            rate = RATE * min(1, step / 20) * FALL**epoch
            for k, d in g.items():
                m, v = momentum[k]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6) + (1e-5 * p[k] if p[k].ndim > 1 else 0)
        after(epoch, table)


def _gradients(model, ids, y, weight, feats, counts):
    p, k = model.p, 3 * UNITS
    words, at = np.unique(ids, return_inverse=True)
    at = at.reshape(ids.shape)
    real = words > 0
    rows = words[real] - 1
    starts, n = feats[2][rows], counts[rows]
    pick = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
    grams, begin, scale = feats[1][pick], np.cumsum(n) - n, feats[3][rows]
    e = np.zeros((len(words), 2 * WIDTH), np.float32)
    if len(rows):
        e[real] = model.embed(feats[0][rows], grams, begin, scale)
    table = model.project(e)
    part, mask = at.T, ids.T > 0
    kf, kb = [], []
    hf = _gru(table[part, :k], p["Uf"], mask, kf)
    hb = _gru(table[part[::-1], k:], p["Ub"], mask[::-1], kb)[::-1]
    pooled, a = _pool(p, hf, hb, mask)
    d = ((_sigmoid(pooled @ p["wo"] + p["bo"][0]) - y) * weight / len(y)).astype(np.float32)
    g = {"wo": pooled.T @ d, "bo": np.array([d.sum()], np.float32)}
    dp = d[:, None] * p["wo"]
    h = np.concatenate([hf, hb], axis=2)
    da = (h * dp).sum(2)
    ds = a * (da - (a * da).sum(0))
    g["va"] = np.einsum("tb,tbk->k", ds, h)
    dh = a[:, :, None] * dp + ds[:, :, None] * p["va"]
    dxf, g["Uf"] = _gru_back(dh[:, :, :UNITS], p["Uf"], mask, kf)
    dxb, g["Ub"] = _gru_back(np.ascontiguousarray(dh[::-1, :, UNITS:]), p["Ub"], mask[::-1], kb)
    dx = np.concatenate([dxf, dxb[::-1]], axis=2).reshape(-1, 2 * k)
    order = np.argsort(part.reshape(-1), kind="stable")
    cells = part.reshape(-1)[order]
    dt = np.add.reduceat(dx[order], np.flatnonzero(np.diff(cells, prepend=-1)))
    dt[~real] = 0
    g |= {"Wf": e.T @ dt[:, :k], "Wb": e.T @ dt[:, k:], "bf": dt[:, :k].sum(0), "bb": dt[:, k:].sum(0)}
    de = dt[:, :k] @ p["Wf"].T + dt[:, k:] @ p["Wb"].T
    g["Ew"], g["Ec"] = np.zeros_like(p["Ew"]), np.zeros_like(p["Ec"])
    if len(rows):
        np.add.at(g["Ew"], feats[0][rows], de[real, :WIDTH])
        np.add.at(g["Ec"], grams, np.repeat(de[real, WIDTH:] * scale[:, None], n, axis=0))
    return g


def _logistic(x, y, weight, ridge: float = 1.0):
    """Weighted logistic regression by Newton's method with halved steps, drawn to a text's highest logit as it is."""
    start = np.array([1.0, 0, 0, 0])
    drawn, b = ridge * np.array([1.0, 1, 1, 0.01]), start.copy()

    def loss(b):
        z = x @ b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (drawn * (b - start) ** 2).sum() / 2

    now = loss(b)
    for _ in range(50):
        q = _sigmoid(x @ b)
        grad = x.T @ (weight * (q - y)) + drawn * (b - start)
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(drawn)
        move = np.linalg.solve(hess, grad)
        while (then := loss(b - move)) > now and np.abs(move).max() > 1e-9:
            move /= 2
        if then >= now:
            break
        b, now = b - move, then
    return b


class Scorer:
    """Scores texts, to six places; the projections of the words met are kept, up to a bound."""

    def __init__(self, model: Model, max_words: int = 100_000):
        self.model, self.max_words = model, max_words
        self.clear()

    def clear(self):
        self.number, self.table = {}, np.zeros((1, 6 * UNITS), np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.number) > self.max_words:
            self.clear()
        new = list(set(chain.from_iterable(split)).difference(self.number))
        if new:
            self.number |= {w: len(self.table) + i for i, w in enumerate(new)}
            self.table = np.concatenate([self.table, self.model.project(self.model.embed(*self.model.inputs(new)))])
        sizes = np.array([len(ws) for ws in split])
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int32, sizes.sum())
        ids, of = windows(ids, sizes)
        x = text_features(window_logits(self.model.p, self.table, ids), of, len(texts))
        return np.where(sizes > 0, _sigmoid(x @ self.model.final), 0).round(6)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learnt from; no label can belong to a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` toxic and as many other labelled documents, none of them held out.

    They are the first by a hash of doc_id, those of over SAMPLE_CHARS characters left out. Only the
    labels are sorted; the texts are picked out by the chosen ids, a set of at most 2 * sample.
    """
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = {bool(r.t): r["count"] for r in known.groupBy((F.col("toxic") == 1).alias("t")).count().collect()}
    ids: dict[int, int] = {}
    for is_toxic in (0, 1):
        for r in known.where((F.col("toxic") == 1) == bool(is_toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect():
            ids[r.doc_id] = is_toxic
    chosen = docs.sparkSession.createDataFrame(list(ids.items()), "_id long, _toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).where(F.length("text") <= SAMPLE_CHARS).orderBy("doc_id", F.xxhash64("text")).limit(4 * sample).collect()
    texts, toxic = [r.text for r in rows], [r._toxic for r in rows]
    del rows
    model = train(texts, toxic, n.get(True, 0) / max(1, sum(n.values())))
    release()
    return model


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of each whole text; the model, of fixed size, is broadcast."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        kept, model = held_by("toxicity"), sent.value
        if kept.get("model") is not model:
            kept |= {"model": model, "scorer": Scorer(model)}
        own = kept["scorer"]
        return pd.Series([x for run in by_size(texts.fillna("")) for x in own.score(run)], dtype=float)

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= THRESHOLD) of every document.

    The windows, STRIDE words apart, cover the whole text, whether white space parts it or not. Texts without words, null ones too, score 0; a null doc_id is
    scored and not held out; repeated rows score alike; an empty table gives no rows, and without labels
    of both kinds every score is their share; other columns are ignored.
    """
    model = fit(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below THRESHOLD, with all their columns."""
    model = fit(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    rows = rows.withColumn("_score", score_column(docs.sparkSession, model, F.col("_row.text")))
    return rows.where(F.col("_score") < THRESHOLD).select("_row.*")

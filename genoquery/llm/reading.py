"""Reading level of texts.

A sentence is the mean of its words, a word is its own feature plus its character
trigrams (both hashed), and a softmax regression with an L2 penalty gives the
sentence's level. It is fitted on the sentences of labelled documents; as a
document mixes levels, the sentences' own levels are re-estimated between fits.
A document's level is read off the word-weighted mean of its sentence levels,
calibrated on labels by regressions that have not seen the document. Only English running prose counts.

The fit uses a bounded sample: at most ``TRAIN_DOCS`` labelled documents, whole, of
at most ``TRAIN_CHARS`` characters each. Every document is judged over its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoquery.session import ship

BANDS = ["basic", "general", "expert"]
TRAIN_DOCS = 1000
TRAIN_CHARS = 20_000
BUCKETS = 1 << 15
LEAST_WORDS = 60
PENALTY = 1e-6  # on the squared weights, against the mean loss of a sentence
FOLDS = 2
CACHE_WORDS = 400_000
# Frequent function words.
ENGLISH = frozenset("the of and to in is was that it for on with as be by at this from are or not which have has had we you they if can may but a an his her he she what when so do did then each your our their will one there".split())
OTHER = frozenset("der die das und ist nicht ein eine den mit zu von für auf dem des im sich werden wurde el la los las de que una un y en se por del con para le les du et est dans une qui pas sur au il di che per non sono della het van een zijn voor niet och att som det är".split())
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+|(?<=[a-z][.!?])(?=[A-Z])")
_WORD = re.compile(r"[a-zß-öø-ÿœ]+(?:['’-][a-zß-öø-ÿœ]+)*")
_DNA = re.compile(r"[acgtn]{12,}")
_TAG = re.compile(r"<[^<>]{0,200}>|&#?\w{1,8};")


def sentences_of(text: str) -> list[tuple[list[str], int]]:
    """The words of each sentence, and its characters without blanks."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return [(_WORD.findall(s.lower()), len(s) - s.count(" ") - s.count("\t")) for s in _SENTENCE.split(text) if s]


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its character trigrams."""
    w = f"<{word}>".encode()
    return [zlib.crc32(w) % BUCKETS, *{BUCKETS + zlib.crc32(w[i : i + 3]) % BUCKETS for i in range(len(w) - 2)}]


class Model:
    """Weights of the sentence regression, the calibration of documents, and the words seen in fitting."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, known: frozenset, doc: np.ndarray):
        self.weights, self.bias, self.known, self.doc = weights, bias, known, doc


class Vocabulary(dict):
    """Word to row of ``rows``: three scores, whether known, English, other function word, letters, DNA."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, []

    def __missing__(self, word: str) -> int:
        f = features(word)
        w = self.model.weights
        # a word weighs as much as its trigrams together
        score = w[f[0]] + w[f[1:]].sum(0) / max(1, len(f) - 1)
        dna = bool(_DNA.fullmatch(word))
        self.rows.append((*score, word in self.model.known, word in ENGLISH, word in OTHER and word not in ENGLISH, 0 if dna else len(word), dna))
        self[word] = len(self.rows) - 1
        return self[word]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Sparse:
    """A sparse matrix by its entries."""

    def __init__(self, rows, cols, vals, shape: tuple[int, int]):
        self.rows, self.cols, self.vals, self.shape = rows, cols, vals, shape

    def dot(self, x: np.ndarray) -> np.ndarray:
        y = x[self.cols] * self.vals[:, None]
        return np.stack([np.bincount(self.rows, y[:, j], self.shape[0]) for j in range(x.shape[1])], 1)

    def back(self, x: np.ndarray) -> np.ndarray:
        y = x[self.rows] * self.vals[:, None]
        return np.stack([np.bincount(self.cols, y[:, j], self.shape[1]) for j in range(x.shape[1])], 1)


def regress(parts: list[Sparse], target: np.ndarray, weight: np.ndarray, penalty: float, steps: int, start=None) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on the product of sparse matrices by Adam, full batch, with an L2 penalty."""
    f, k = parts[-1].shape[1], target.shape[1]
    w, b = (np.zeros((f, k)), np.zeros(k)) if start is None else start
    m, v = np.zeros((f, k)), np.zeros((f, k))
    share = (weight / weight.sum())[:, None]
    for t in range(1, steps + 1):
        g = (softmax(scores(parts, w, b)) - target) * share
        grad = g
        for p in parts:
            grad = p.back(grad)
        grad = grad + penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b = b - 0.5 * g.sum(0)
    return w, b


def scores(parts: list[Sparse], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    for p in reversed(parts):
        w = p.dot(w)
    return w + b


def fit(rows: list[tuple[str, dict[str, int]]], steps: int = 50) -> Model:
    """A model from (text, votes per band) of labelled documents; votes may disagree. Without labels every level is as likely."""
    sent_words, sent_doc, prior, n_words = [], [], [], []
    seen: Counter = Counter()
    for text, votes in rows:
        got = np.array([votes.get(b, 0) for b in BANDS], float)
        if not got.sum():
            continue
        kept = [ws for ws, _ in sentences_of(text) if len(ws) >= 2]
        sent_words += kept
        sent_doc += [len(prior)] * len(kept)
        n_words += [len(ws) for ws in kept]
        prior.append((got + 0.1) / (got + 0.1).sum())
        seen.update({w for ws in kept for w in ws})
    known = frozenset(w for w, n in seen.items() if n >= 2)
    if not n_words:
        return Model(np.zeros((2 * BUCKETS, 3)), np.zeros(3), known, np.eye(3))
    ids: dict[str, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in sent_words for w in ws), np.int64)
    per = np.array(n_words, float)
    key, count = np.unique(np.repeat(np.arange(len(per)), n_words) * len(ids) + flat, return_counts=True)
    lists = [features(w) for w in ids]
    used = np.unique(np.concatenate([np.array(x) for x in lists]))
    lens = [len(x) for x in lists]
    value = np.concatenate([np.r_[1.0, np.full(n - 1, 1.0 / max(1, n - 1))] for n in lens])
    # sentence x distinct word and word x feature: their product is never formed
    parts = [
        Sparse(key // len(ids), key % len(ids), count / per[key // len(ids)], (len(per), len(ids))),
        Sparse(np.repeat(np.arange(len(ids)), lens), np.searchsorted(used, np.concatenate([np.array(x) for x in lists])), value, (len(ids), len(used))),
    ]
    doc = np.array(sent_doc)
    prior_s = np.array(prior)[doc]

    def levels_of(weight: np.ndarray) -> tuple[tuple, np.ndarray]:
        """The regression on sentences of this weight, and its scores of all."""
        target, state = prior_s, None
        for _ in range(2):
            state = regress(parts, target, weight, PENALTY, steps, state)
            z = scores(parts, *state)
            target = np.eye(3)[softmax(z + np.log(prior_s) * 0.5).argmax(1)] * 0.9 + 0.1 / 3
        return state, z

    state, z = levels_of(per)
    weights = np.zeros((2 * BUCKETS, 3))
    weights[used] = state[0]
    # documents are calibrated on scores of regressions that have not seen them
    fold = doc % FOLDS
    for k in range(FOLDS if len(prior) >= 4 * FOLDS else 0):
        z = np.where((fold == k)[:, None], levels_of(np.where(fold == k, 0.0, per))[1], z)
    p = softmax(z)
    mix = np.stack([np.bincount(doc, p[:, j] * per, len(prior)) for j in range(3)], 1)
    mix /= np.maximum(mix.sum(1, keepdims=True), 1e-9)
    lm = np.log(mix + 0.02)
    n = len(prior)
    dw, db = regress([Sparse(np.repeat(np.arange(n), 3), np.tile(np.arange(3), n), lm.ravel(), (n, 3))], np.array(prior), np.ones(n), 1e-3, 150)
    return Model(weights.astype(np.float32), state[1], known, np.vstack([dw, db]))


def judge(texts: list, model: Model, vocab: Vocabulary) -> list[tuple]:
    """(words, prose share, probabilities) of each text, or None for null and empty ones; words and share are those of English prose."""
    flat, counts, chars, owner = [], [], [], []
    for i, t in enumerate(texts):
        if not isinstance(t, str) or not t:
            continue
        for ws, c in sentences_of(t):
            if c:
                flat += ws
                counts.append(len(ws))
                chars.append(c)
                owner.append(i)
    n = len(texts)
    if not counts:
        return [None] * n
    ids = np.fromiter(map(vocab.__getitem__, flat), np.int64, len(flat))
    rows = np.array(vocab.rows, np.float32).reshape(-1, 8)
    counts, chars, owner = np.array(counts), np.array(chars), np.array(owner)
    ends = np.concatenate([[0], np.cumsum(counts)])
    sums = np.zeros((len(counts), 8))
    some = counts > 0
    if some.any():
        sums[some] = np.add.reduceat(rows[ids], ends[:-1][some], axis=0, dtype=float)
    length = np.maximum(counts, 1)
    p = softmax(sums[:, :3] / length[:, None] + model.bias)
    english = ((sums[:, 3] >= 0.6 * length) | (sums[:, 4] >= 0.15 * length)) & (sums[:, 5] <= np.maximum(sums[:, 4], 0.15 * length))
    prose = english & (sums[:, 6] >= 0.6 * chars) & (sums[:, 7] == 0)
    words = np.bincount(owner, counts * prose, n)
    share = np.bincount(owner, chars * prose, n) / np.maximum(np.bincount(owner, chars, n), 1)
    mix = np.stack([np.bincount(owner, p[:, j] * counts * prose, n) for j in range(3)], 1)
    mix /= np.maximum(mix.sum(1, keepdims=True), 1e-9)
    level = softmax(np.log(mix + 0.02) @ model.doc[:3] + model.doc[3] if len(model.doc) > 3 else np.log(mix + 0.02))
    have = np.bincount(owner, minlength=n) > 0
    return [(int(words[i]), float(share[i]), level[i].tolist()) if have[i] else None for i in range(n)]


def levels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, words, prose_share, band, confidence, p_basic, p_general, p_expert`` of every document that is mainly English prose.

    ``labels`` has ``doc_id, reader, band``; null bands and unknown bands are no vote, repeated labels are votes. Documents with
    fewer than ``LEAST_WORDS`` words of prose, or of which less than half is prose, have no row; nor have null and empty texts.
    """
    votes = labels.where(F.col("band").isin(BANDS)).groupBy(id_col).agg(*[F.count(F.when(F.col("band") == b, 1)).alias(b) for b in BANDS])
    # the bounded sample: the labelled documents that come first by a hash of their id, without those that are too long
    chosen = votes.orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_DOCS)
    train = docs.where(F.length(text_col) <= TRAIN_CHARS).select(id_col, text_col).join(F.broadcast(chosen), id_col).collect()
    model = fit([(r[text_col] or "", {b: r[b] for b in BANDS}) for r in sorted(train, key=lambda r: r[id_col])])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        vocab = Vocabulary(model)
        for b in batches:
            if len(vocab) > CACHE_WORDS:
                vocab = Vocabulary(model)
            ids, texts = b[id_col].tolist(), b[text_col].tolist()
            out, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 4_000_000):
                    size += len(texts[end] or "")
                    end += 1
                for i, r in zip(ids[at:end], judge(texts[at:end], model, vocab)):
                    if r and r[0] >= LEAST_WORDS and r[1] >= 0.5:
                        k = int(np.argmax(r[2]))
                        out.append((i, r[0], r[1], BANDS[k], r[2][k], *r[2]))
                at = end
            yield pd.DataFrame(out, columns=[id_col, "words", "prose_share", "band", "confidence", "p_basic", "p_general", "p_expert"])

    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, words long, prose_share double, band string, confidence double, p_basic double, p_general double, p_expert double")

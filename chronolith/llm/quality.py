"""Quality classifier: supervised subword embeddings.

Hashed words, pairs of neighbouring words and character n-grams have learned vectors (pairs of a word with itself are
one n-gram, whatever the word); a document is the mean of all of its vectors, and a softmax
layer reads it. Trained by numpy stochastic gradient descent on a bounded sample of labelled rows, in one task, from
bags of buckets that are made where the texts lie. As the output layer is linear, a vector enters a score only as its
product with that layer, so scoring needs one number per bucket, and a word's share is remembered.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import map_rows
from chronolith.llm.words import Scorer, held_out, learn, sample, score_texts

#: Labelled rows and characters of one text that training takes at most.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 200_000
BUCKETS, DIM, GRAMS = 1 << 17, 12, (2, 3, 4)
EPOCHS, RATE, SEED = 6, 0.4, 11
THRESHOLD = 0.3

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _fold(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their n-grams (UTF-8 bytes, with both ends marked), and the word of each."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    of = np.repeat(np.arange(len(raw)), sizes)
    starts = np.cumsum(sizes) - sizes
    buckets, owners = [], []
    power = np.cumprod(np.full(int(sizes.max(initial=1)), np.uint64(0x100000001B3)))
    place = np.arange(len(text)) - starts[of]
    whole = np.add.reduceat(text * power[place], starts) if len(raw) else np.zeros(0, np.uint64)
    buckets.append(_fold(whole + np.uint64(7))), owners.append(np.arange(len(raw)))
    for n in GRAMS:
        if len(text) < n:
            continue
        last = len(text) - n + 1
        inside = of[:last] == of[n - 1 :]
        h = np.zeros(last, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + text[k : k + last]
        buckets.append(_fold(h[inside] * np.uint64(2 * n + 1) + np.uint64(n))), owners.append(of[:last][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def keys(words: list[str]) -> np.ndarray:
    """A hash of 32 bits per word, which pairs are made of."""
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def pairs(key: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbouring words, from the words' keys."""
    a, b = key[:-1], key[1:]
    return _fold(np.where(a == b, np.uint64(3), (a << np.uint64(32) | b) ^ np.uint64(0x5851F42D4C957F2D)))


def _document(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Its buckets and how often each occurs."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    own = Counter(words)
    buckets, owners = subwords(list(own))
    two = pairs(keys(words))
    ids, inverse = np.unique(np.concatenate([buckets, two]), return_inverse=True)
    times = np.bincount(inverse, np.concatenate([np.array(list(own.values()), np.float64)[owners], np.ones(len(two))]), len(ids))
    return ids.astype(np.int32), times.astype(np.float32)


def _bag(text: str) -> bytes:
    """_document() packed: steps between buckets compress well, and a task holds a whole sample of bags."""
    ids, times = _document(text)
    return zlib.compress(np.diff(ids, prepend=0).astype(np.int32).tobytes() + times.tobytes(), 1)


def _unbag(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(bag)
    half = len(raw) // 2
    return np.cumsum(np.frombuffer(raw[:half], np.int32)), np.frombuffer(raw[half:], np.float32)


def train(rows: list[tuple[int, bytes, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias): the log-odds of label 1 are the mean weight of a text's buckets plus the bias.

    rows: (doc_id, bag, label). Without rows, or with one label alone, the weights are zero and the bias says how often label 1 occurs.
    """
    labels = np.array([y for _, _, y in rows], np.int64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, times = _unbag(rows[k][1])
            step = rate * (1 - done / steps)
            done += 1
            total = times.sum()
            hidden = times @ vectors[ids] / total if total else np.zeros(DIM, np.float32)
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out.T @ p
            out -= step * np.outer(p, hidden)
            bias -= step * 0.1 * p
            if total:
                # as each of the text's vectors is one of the mean's parts, it moves by the whole gradient
                vectors[ids] -= step * np.minimum(times * (len(ids) / total), 4)[:, None] * back
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """train() of a sample() in one task of the cluster."""

    def one(got):
        weights, bias = train(got)
        return weights.astype(np.float32).tobytes() + np.float64(bias).tobytes()

    model = learn(rows, _bag, one)
    return np.frombuffer(model[:-8], np.float32), float(np.frombuffer(model[-8:])[0])


def _scorer(weights: np.ndarray, bias: float):
    def words(new: list[str]) -> np.ndarray:
        buckets, owners = subwords(new)
        return np.stack([np.bincount(owners, weights[buckets], len(new)), np.bincount(owners, minlength=len(new)), keys(new)], axis=1)

    def add(values: np.ndarray, _) -> np.ndarray:
        two = pairs(values[:, 2].astype(np.uint64))
        return values[:, :2].sum(axis=0) + (weights[two].sum(dtype=np.float64), len(two))

    def finish(s):
        return (float(1 / (1 + np.exp(-np.clip((s[0] / s[1] if s is not None else 0.0) + bias, -500, 500)))),)

    return Scorer(words, add), finish


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of docs from its whole text; null and empty texts score the bias alone."""
    return score_texts(docs, lambda: _scorer(weights, bias), "doc_id long, score double", id_col, text_col)


def filter_texts(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all of their columns, whose score is at least threshold."""
    place = docs.columns.index(text_col)

    def make():
        scorer, finish = _scorer(weights, bias)

        def one(batch):
            keep = []
            for at in range(0, batch.num_rows, 64):
                keep += [finish(s)[0] >= threshold for s in scorer.sums(batch.column(place).slice(at, 64).to_pylist())]
            return batch.filter(pa.array(keep, pa.bool_()))

        return one

    return map_rows(docs, make, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs, label column quality.

    Learns from labelled rows that are not held out, at most rows of them. Repeated rows and null ids are scored
    like any other (a null id is never held out); an empty table gives no rows; other columns are no input.
    """
    weights, bias = fit(sample(docs, labels, "quality", rows, chars))
    scored = score(docs, weights, bias)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all of the ordered thresholds; a document's result
is its expected severity. Features are words (lower case, letters only) and beginnings of words that tell toxic
documents from others in the labelled sample. x holds each one's count n as log(1 + n), which long texts don't dilute,
and its density as log(1 + 100 n / words), which short texts don't hide.

The labels say toxic or not. Grades are made from them: 0 for not toxic; toxic documents have grade 1 to GRADES - 1 by
how sure a yes-or-no model is of them that has learnt from the other folds alone, in equal parts. So no document is
graded by a model, or by words, chosen with its help.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.words import Scorer, held_out, learn, sample, score_texts

#: Labelled rows and characters of one text that training takes at most; words that become features.
SAMPLE_ROWS, SAMPLE_CHARS, FEATURES = 6000, 200_000, 256
GRADES, FOLDS = 4, 3
#: A word is a feature if toxic documents hold it this often and this many times as often as others.
LEAST, LIFT = 4, 2.0
#: Lengths of the beginnings of words.
PREFIXES = (5, 7)

_OTHER = re.compile(r"[\W\d_]+")


def normal(word: str) -> str:
    return word.lower() if word.isalpha() else _OTHER.sub("", word).lower()


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by ^; none for a word without letters."""
    w = normal(word)
    return [w, *("^" + w[:k] for k in PREFIXES if len(w) > k)] if w else []


def values(n: np.ndarray, words) -> np.ndarray:
    """x from counts n (features last) and numbers of words."""
    return np.concatenate([np.log1p(n), np.log1p(100 * n / np.maximum(words, 1))], axis=-1)


def choose(bags: list[dict[str, int]], toxic: np.ndarray, features: int = FEATURES) -> list[str]:
    """The words whose presence tells most (G statistic), most telling first, ties by the word."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    seen: dict[str, list[int]] = {}
    for bag, t in zip(bags, toxic):
        for w in bag:
            seen.setdefault(w, [0, 0])[int(t)] += 1
    good = []
    for w, (b, a) in seen.items():
        p1, p0 = a / max(n1, 1), (b + 0.5) / (n0 + 1)
        if a >= LEAST and p1 >= LIFT * p0:
            good.append((-a * float(np.log(p1 / p0)), w))
    return [w for _, w in sorted(good)[:features]]


def bag(text: str) -> bytes:
    """Number of words, and how often each feature occurs."""
    held: dict[str, int] = {}
    length = 0
    for found in map(features, text.split()):
        length += bool(found)
        for w in found:
            held[w] = held.get(w, 0) + 1
    return json.dumps([length, held]).encode("utf-8", "replace")


def _matrix(bags: list[dict[str, int]], lengths: np.ndarray, words: list[str]) -> np.ndarray:
    x = np.array([[b.get(w, 0) for w in words] for b in bags], np.float64).reshape(len(bags), len(words))
    return values(x, lengths[:, None])


def _binary(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 12) -> np.ndarray:
    """Weights, bias last, of a logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * len(x))
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + pull * w)
    return w


def severity(bags: list[dict[str, int]], lengths: np.ndarray, toxic: np.ndarray, ridge: float) -> np.ndarray:
    """Grades of labelled documents: 0, or 1 to GRADES - 1 by the rank of their out-of-fold log-odds."""
    sure, fold = np.zeros(len(bags)), np.arange(len(bags)) % FOLDS
    for f in range(FOLDS):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        words = choose([bags[k] for k in rest], toxic[rest])
        if words and len(own):
            w = _binary(_matrix([bags[k] for k in rest], lengths[rest], words), toxic[rest].astype(float), ridge)
            sure[own] = _matrix([bags[k] for k in own], lengths[own], words) @ w[:-1] + w[-1]
    grade = np.zeros(len(bags), np.int64)
    order = np.flatnonzero(toxic)[np.argsort(sure[toxic], kind="stable")]
    grade[order] = 1 + np.arange(len(order)) * (GRADES - 1) // max(len(order), 1)
    return grade


def train(rows: list[tuple[int, bytes, int]], rounds: int = 400, ridge: float = 1e-3) -> tuple[dict[str, tuple[float, float]], np.ndarray]:
    """(weights of count and density per feature, ordered thresholds), by gradient descent with momentum on the mean log-likelihood.

    rows: (doc_id, bag(), label).
    """
    read = [json.loads(b) for _, b, _ in rows]
    bags, lengths = [b for _, b in read], np.array([n for n, _ in read], np.float64)
    toxic = np.array([y > 0 for _, _, y in rows], bool)
    words = choose(bags, toxic)
    if not words or not toxic.any():
        return {}, 2.0 + np.arange(GRADES - 1.0)
    grade, x = severity(bags, lengths, toxic, ridge), _matrix(bags, lengths, words)
    size = x.shape[1]
    params, speed = np.concatenate([np.zeros(size), [2.0], np.zeros(GRADES - 2)]), 0.0
    scale = np.zeros_like(params)
    for r in range(rounds):
        w, theta = params[: size], params[size] + np.concatenate([[0.0], np.cumsum(np.exp(params[size + 1 :]))])
        eta = (x @ w)[:, None] - theta
        s = 1 / (1 + np.exp(-np.clip(eta, -40, 40)))
        # P(grade = k) = s[k - 1] - s[k]
        full = np.concatenate([np.ones((len(rows), 1)), s, np.zeros((len(rows), 1))], axis=1)
        p = np.maximum(full[np.arange(len(rows)), grade] - full[np.arange(len(rows)), grade + 1], 1e-12)
        slope = s * (1 - s)
        sign = (grade[:, None] == np.arange(1, GRADES)).astype(float) - (grade[:, None] == np.arange(GRADES - 1))
        d_eta = slope * sign / p[:, None]
        g_theta = -d_eta.mean(axis=0)
        g_gap = np.array([g_theta[k + 1 :].sum() * np.exp(params[size + 1 + k]) for k in range(GRADES - 2)])
        g = np.concatenate([x.T @ d_eta.sum(axis=1) / len(rows) - ridge * w, [g_theta.sum()], g_gap])
        speed = 0.9 * speed + 0.1 * g
        scale = 0.99 * scale + 0.01 * g * g
        params = params + 0.05 * (speed / (1 - 0.9 ** (r + 1))) / (np.sqrt(scale / (1 - 0.99 ** (r + 1))) + 1e-8)
    theta = params[size] + np.concatenate([[0.0], np.cumsum(np.exp(params[size + 1 :]))])
    half = len(words)
    return {w: (float(params[k]), float(params[half + k])) for k, w in enumerate(words)}, theta


def fit(rows: DataFrame) -> tuple[dict[str, tuple[float, float]], np.ndarray]:
    """train() of a sample() in one task of the cluster."""

    def one(got):
        weights, theta = train(got)
        return json.dumps([weights, theta.tolist()]).encode()

    weights, theta = json.loads(learn(rows, bag, one))
    return {w: (a, b) for w, (a, b) in weights.items()}, np.array(theta)


def score(docs: DataFrame, weights: dict[str, tuple[float, float]], theta: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade) of every row of docs; null and blank texts have no features."""
    names = sorted(weights)
    index, w = {x: k for k, x in enumerate(names)}, np.array([weights[x][0] for x in names] + [weights[x][1] for x in names])

    def make():
        def words(new: list[str]) -> np.ndarray:
            out = np.full((len(new), 2 + len(PREFIXES)), -1, np.int32)
            for row, word in zip(out, new):
                found = features(word)
                row[-1] = bool(found)
                for k, x in enumerate(found):
                    row[k] = index.get(x, -1)
            return out

        def count(at: np.ndarray, _) -> np.ndarray:
            hit = at[:, :-1]
            return np.append(np.bincount(hit[hit >= 0], minlength=len(names)), at[:, -1].sum())

        def finish(n):
            eta = (float(values(n[:-1].astype(float), n[-1]) @ w) if n is not None else 0.0) - theta
            p = 1 / (1 + np.exp(-np.clip(eta, -40, 40)))
            return float(p.sum()), float(p[0]), int((p >= 0.5).sum())

        return Scorer(words, count), finish

    return score_texts(docs, make, "doc_id long, expected_severity double, p_toxic double, grade int", id_col, text_col)


def grade_texts(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, held_out, expected_severity, p_toxic, grade, toxic) per row of docs, label column toxic.

    expected_severity lies between 0 and GRADES - 1, grade is the median grade, toxic says that it isn't 0. Repeated
    rows and null ids are graded like any other; an empty table gives no rows; other columns are no input.
    """
    weights, theta = fit(sample(docs, labels, "toxic", rows, chars))
    out = score(docs, weights, theta)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_severity", "p_toxic", "grade", (F.col("grade") > 0).alias("toxic"))

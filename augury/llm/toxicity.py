"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a linear support vector machine.

The kernel counts common subsequences of four characters in a word (blanks mark its ends), where each step may
skip one character at a price, so that inserted characters and gaps are tolerated. A document's vector is the
best normalised kernel value of its words with each landmark, mapped by the landmarks' inverse root kernel matrix."""

from __future__ import annotations

from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model is fitted on at most so many labelled rows, chosen by hash, of at most so many bytes each; scoring covers every row.
MAX_TRAIN, MAX_BYTES, LANDMARKS, DECAY, THRESHOLD = 6000, 1 << 16, 96, 0.5, 0.3
_STEPS = list(product((1, 2), repeat=3))
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_TOP = np.uint64(44)
#: Characters of one array pass; a longer text is a pass of its own.
_PASS = 100_000
_TRIM = "\"'.,;:!?()[]{}|%$&*#"


def _words(text) -> str:
    words = text.lower().split() if isinstance(text, str) else []
    return " " + "".join(w + " " for w in (x.strip(_TRIM) for x in words) if w)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _grams(c: np.ndarray, wanted: np.ndarray | None = None):
    """(start position, hash, weight) of the subsequences of each step pattern that do not cross a blank."""
    blank = np.cumsum(c == 32)
    terms = [c * m for m in _MULT]
    for a, b, d in _STEPS:
        span = a + b + d
        n = len(c) - span
        if n <= 0:
            continue
        h = terms[0][:n] + terms[1][a : a + n] + terms[2][a + b : a + b + n] + terms[3][span : span + n]
        at = np.arange(n) if wanted is None else np.flatnonzero(wanted[h >> _TOP])
        at = at[blank[at + span - 1] == blank[at]]
        yield at, h[at], DECAY ** (span - 3)


def _norms(lengths: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of words of these lengths (both blanks counted)."""
    return np.sqrt(sum(np.maximum(lengths - sum(s), 0) * DECAY ** (2 * (sum(s) - 3)) for s in _STEPS))


class Landmarks:
    def __init__(self, words: list[str]):
        self.words = words
        rows = []
        for j, w in enumerate(words):
            got: Counter = Counter()
            for _, h, weight in _grams(_codes(_words(w)).astype(np.uint64)):
                for x in h.tolist():
                    got[x] += weight
            norm = sum(v * v for v in got.values()) ** 0.5 or 1.0
            rows += [(x, j, v / norm) for x, v in got.items()]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.col = np.array([r[1] for r in rows], np.int64)
        self.val = np.array([r[2] for r in rows])
        self.keys, self.first, self.count = np.unique(self.hash, return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> _TOP] = True

    def best(self, texts) -> np.ndarray:
        """Greatest normalised kernel value over the words of each text, per landmark."""
        out, m = np.zeros((len(texts), len(self.words))), len(self.words)
        rows, size = [], 0
        for i, t in enumerate(texts):
            rows.append(_words(t))
            size += len(rows[-1])
            if size >= _PASS or i + 1 == len(texts):
                if m:
                    self._pass(rows, out[i + 1 - len(rows) : i + 1])
                rows, size = [], 0
        return out

    def _pass(self, rows: list[str], out: np.ndarray) -> None:
        c, m = _codes("".join(rows)).astype(np.uint64), len(self.words)
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        blanks = np.flatnonzero(c == 32)
        word = np.cumsum(c == 32) - 1
        norm = _norms(np.diff(blanks, append=len(c)) + 1)
        cells, adds = [], []
        for at, h, weight in _grams(c, self.bits):
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            ok = self.keys[k] == h
            at, k = at[ok], k[ok]
            n = self.count[k]
            src = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cells.append(np.repeat(word[at], n) * m + self.col[src])
            adds.append(self.val[src] * weight)
        if cells and len(cell := np.concatenate(cells)):
            cell, back = np.unique(cell, return_inverse=True)
            value = np.bincount(back, np.concatenate(adds)) / np.maximum(norm[cell // m], 1e-9)
            np.maximum.at(out, (doc[blanks[cell // m]], cell % m), np.minimum(value, 1.0))


class Model:
    def __init__(self, landmarks: Landmarks, root: np.ndarray, weights: np.ndarray, platt: tuple[float, float]):
        self.landmarks, self.root, self.weights, self.platt = landmarks, root, weights, platt

    def score(self, texts) -> np.ndarray:
        z = self.landmarks.best(texts) @ self.root @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.platt[0] * z + self.platt[1], -30, 30)))


def _choose(texts, y, n: int) -> list[str]:
    """Words and word beginnings of training texts, by signed G statistic over documents; then frequent common words."""
    seen = {0: Counter(), 1: Counter()}
    for t, label in zip(texts, y):
        words = set(_words(t).split())
        heads = {w[:k] for w in words for k in (5, 7) if len(w) > k}
        seen[label].update(words | heads)
    pos, neg = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    gain = {}
    for w, a in seen[1].items():
        b, total = seen[0][w], a + seen[0][w]
        if a >= 2 and a / pos > b / neg:
            e = total * pos / (pos + neg)
            gain[w] = a * np.log(a / e) + (b * np.log(b / (total - e)) if b else 0)
    out: list[str] = []
    for w in sorted(gain, key=lambda w: (-gain[w], w)):
        if len(out) < n * 11 // 12 and len(w) >= 3:
            out.append(w)
    for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0])):
        if len(out) < n and len(w) >= 4 and w not in out:
            out.append(w)
    return out


def fit(texts, y, n: int = LANDMARKS) -> Model:
    y = np.asarray(y, int)
    marks = Landmarks(_choose(texts, y, n))
    m = len(marks.words)
    kernel = marks.best(marks.words)
    kernel = (kernel + kernel.T) / 2
    value, vector = np.linalg.eigh(kernel) if m else (np.zeros(0), np.zeros((0, 0)))
    root = (vector / np.sqrt(np.maximum(value, 0.05))) @ vector.T if m else kernel
    x = np.hstack([marks.best(texts) @ root, np.ones((len(texts), 1))])
    sign, w = 2 * y - 1.0, np.zeros(m + 1)
    ridge = np.eye(m + 1) * 0.2
    ridge[-1, -1] = 1e-6
    for _ in range(30):  # Newton steps on the squared hinge loss
        on = sign * (x @ w) < 1
        new = np.linalg.solve(x[on].T @ x[on] + ridge, x[on].T @ sign[on]) if on.any() else w
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    z, a, b = x @ w, 1.0, 0.0
    for _ in range(50):  # Platt scaling
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 1e-2 * a, (p - y).sum()])
        s = p * (1 - p) + 1e-6
        step = np.linalg.solve(np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]]), g)
        a, b = a - step[0], b - step[1]
    return Model(marks, root, w, (float(a), float(b)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_rows`` labelled rows of at most MAX_BYTES, none of them held out (crc32 of the doc_id text mod 4 is 2).

    Rows without a label of 0 or 1, a doc_id or a text are not looked at. Without both labels the model rejects nothing."""
    usable = labels.filter("toxic in (0, 1) and doc_id is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = docs.filter(F.octet_length("text") <= MAX_BYTES).select("doc_id", "text")
    got = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).toPandas()
    got = got.sort_values(["doc_id", "text"], na_position="first")
    if got["y"].nunique() < 2:
        return Model(Landmarks([]), np.zeros((0, 0)), np.array([-1.0]), (1.0, -3.0))
    return fit(got["text"].tolist(), got["y"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null and empty texts get the score of no evidence; a null doc_id is not held
    out. Repeated rows score alike, an empty table gives no rows, other columns are not looked at. A very long text is a pass
    of its own, with memory in proportion to it."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score(pdf["text"].tolist())})

    out = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")
    held = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns."""
    likely = F.pandas_udf(lambda s: pd.Series(model.score(s.tolist())), "double")
    return docs.filter(likely(F.col("text")) < THRESHOLD)

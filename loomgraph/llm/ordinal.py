"""Toxicity by cumulative-link ordinal regression.

Severity has grades 0 (clean) to 3. All thresholds share one weight vector over sparse
text features: P(grade > k) = logistic(w.x - threshold_k), thresholds in ascending
order, and the expected severity is the sum of these. The labels only say toxic or
not; the grade of a toxic training text is the third of toxic texts it falls in by
the share of its words whose stems mark toxic texts in the training sample, so grades
order texts by how dense the abuse is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labelled, map_text, text_or_empty

DIMENSIONS, SAMPLE, GRADES = 1 << 18, 5_000, 4
MEMO_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")


class Features:
    """Hashed words and their leading stems (4 to 8 letters) as distinct feature numbers of a
    text; a stem that two, or four, different words of the text share counts as more features."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.memo: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        from xxhash import xxh64_intdigest

        stems = {"=" + word} | {"^" + word[:n] for n in range(4, 9) if len(word) >= n}
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        got = tuple(xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 21) % self.dimensions for s in sorted(stems))
        self.memo[word] = got
        return got

    def of(self, text: str) -> np.ndarray:
        known, seen = self.memo.get, []
        for word in set(_WORD.findall(text.lower())):
            seen += known(word) or self._word(word)
        once, counts = np.unique(np.array(seen, dtype=np.int64), return_counts=True)
        more = [(once[counts >= n] * 2654435761 + n) % self.dimensions for n in (2, 4)]
        return np.unique(np.concatenate([once, *more]))


@dataclass(frozen=True)
class Model:
    """weights are shared by all thresholds, which ascend."""

    weights: np.ndarray
    thresholds: np.ndarray

    def beyond(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(self.weights[x].sum() - self.thresholds, -40, 40)))


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, dimensions: int, grades: int = GRADES) -> np.ndarray:
    """Grade 0 of clean rows; toxic rows in equal parts by the share of features that mark toxic rows."""
    p, q = np.full(dimensions, 0.5), np.full(dimensions, 0.5)
    for x, label in zip(rows, toxic, strict=True):
        (p if label else q)[x] += 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    marks = (np.log(p / n1) - np.log(q / n0) > 2.0) & (p > 5)
    share = np.array([marks[x].mean() if len(x) else 0.0 for x in rows])
    grade = np.zeros(len(rows), dtype=int)
    which = np.flatnonzero(toxic)
    order = which[np.argsort(share[which], kind="stable")]
    for k, part in enumerate(np.array_split(order, grades - 1)):
        grade[part] = k + 1
    return grade


def fit(rows: list[np.ndarray], grade: np.ndarray, dimensions: int = DIMENSIONS, grades: int = GRADES, rounds: int = 200, sparse: float = 2e-3) -> Model:
    """Weights (with an absolute-value penalty, so that common words get none) and thresholds
    that maximise the likelihood, by gradient steps with momentum, scaled by the gradient's running
    size, each followed by a soft threshold on the weights. Always `rounds` of them: the penalised loss
    falls so unevenly that a stop by its progress loses most of the recall. Without rows of both kinds
    the weights are zero and the thresholds give the smoothed shares."""
    n = len(rows)
    above = np.array([((grade > k).sum() + 0.5) / (n + 1) for k in range(grades - 1)]) if n else np.full(grades - 1, 0.5)
    start = -np.log(above / (1 - above))
    start = np.maximum.accumulate(start + 1e-3 * np.arange(grades - 1))
    if n == 0 or grade.max(initial=0) == 0 or grade.min() > 0:
        return Model(np.zeros(dimensions), start)
    seen = np.zeros(dimensions, dtype=np.int64)
    for row in rows:
        seen[row] += 1
    used = np.flatnonzero(seen)
    number = np.zeros(dimensions, dtype=np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    sizes = np.array([len(r) for r in rows])
    often = seen[used] / n
    # features of a few hundred rows at a time, so that no array is as long as all of them in 64 bits
    blocks = []
    for at in range(0, n, 400):
        part = rows[at : at + 400]
        blocks.append((slice(at, at + len(part)), number[np.concatenate(part)], sizes[at : at + len(part)]))
    w, gaps = np.zeros(len(used)), np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-3))]
    level = np.arange(grades)

    def thresholds(g: np.ndarray) -> np.ndarray:
        return g[0] + np.r_[0.0, np.cumsum(np.exp(g[1:]))]

    momentum_w, momentum_g = np.zeros_like(w), np.zeros_like(gaps)
    second_w, second_g = np.zeros_like(w), np.zeros_like(gaps)
    for t in range(1, rounds + 1):
        th = thresholds(gaps)
        z = np.concatenate([np.bincount(np.repeat(np.arange(len(k)), k), weights=w[flat], minlength=len(k)) for _, flat, k in blocks])
        below = 1 / (1 + np.exp(-np.clip(th[None, :] - z[:, None], -30, 30)))  # P(grade <= k)
        cdf = np.c_[np.zeros(n), below, np.ones(n)]
        at = np.arange(n)
        p = np.maximum(cdf[at, grade + 1] - cdf[at, grade], 1e-9)
        slope = np.c_[np.zeros(n), below * (1 - below), np.zeros(n)]
        up, down = slope[at, grade + 1], slope[at, grade]
        dz = (up - down) / p  # of the negative log-likelihood
        gw = np.zeros(len(used))
        for where, flat, k in blocks:
            gw += np.bincount(flat, weights=np.repeat(dz[where], k), minlength=len(used))
        gw /= n
        hit = (grade[:, None] == level[None, :]).astype(float)
        dth = np.array([(-(up / p) * hit[:, k] + (down / p) * hit[:, k + 1]).sum() for k in range(grades - 1)]) / n
        gg = np.r_[dth.sum(), [np.exp(gaps[j]) * dth[j:].sum() for j in range(1, grades - 1)]]
        momentum_w = 0.9 * momentum_w + 0.1 * gw
        momentum_g = 0.9 * momentum_g + 0.1 * gg
        second_w = 0.99 * second_w + 0.01 * gw * gw
        second_g = 0.99 * second_g + 0.01 * gg * gg
        fix1, fix2 = 1 - 0.9**t, 1 - 0.99**t
        step = 0.1 / (np.sqrt(second_w / fix2) + 1e-5)
        w = w - step * momentum_w / fix1
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse * np.sqrt(np.maximum(often, 1 / n)), 0)
        gaps = gaps - 0.05 * (momentum_g / fix1) / (np.sqrt(second_g / fix2) + 1e-8)
    weights = np.zeros(dimensions)
    weights[used] = w
    return Model(weights, thresholds(gaps))


_CACHE: dict[int, Features] = {}


def _features(dimensions: int) -> Features:
    return _CACHE.get(dimensions) or _CACHE.setdefault(dimensions, Features(dimensions))


def _forget() -> None:
    _CACHE.clear()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """A model of `labels.toxic` from at most `sample` labelled rows outside the held-out class;
    the driver gets their feature numbers only, a bounded amount."""
    texts = bounded_labelled(docs, labels, "toxic", sample).select("target", "doc_id", "text")

    def run(values: list) -> dict[str, list]:
        features = _features(dimensions)
        return {"features": [features.of(t).astype(np.int32).tobytes() for t in values]}

    got = map_text(texts, run, "features binary", after=_forget).orderBy("doc_id").collect()
    rows = [np.frombuffer(r["features"], dtype=np.int32) for r in got]
    toxic = np.array([r["target"] for r in got], dtype=int)
    return fit(rows, severity_grades(rows, toxic, dimensions), dimensions)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic (P(grade > 0)), grade (the likeliest).

    One row per row of `docs`; a null or empty text has no features and gets the
    intercept's grade; repeated rows stay; other columns are not read. Narrow, with
    the weights (a fixed size) as a broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(values: list) -> dict[str, list]:
        weights, th = sent.value
        features = _features(len(weights))
        z = np.array([weights[features.of(t)].sum(dtype=np.float64) for t in values])
        beyond = 1 / (1 + np.exp(-np.clip(z[:, None] - th[None, :], -40, 40)))
        full = np.c_[np.ones(len(z)), beyond, np.zeros(len(z))]
        likeliest = (full[:, :-1] - full[:, 1:]).argmax(axis=1)
        return {"severity": beyond.sum(axis=1).tolist(), "p_toxic": beyond[:, 0].tolist(), "grade": likeliest.tolist()}

    return map_text(docs.select("doc_id", text_or_empty().alias("text")), run, "severity double, p_toxic double, grade int", after=_forget)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """`grade` by a model trained on `labels`, and toxic: 1 where p_toxic reaches `threshold`."""
    found = grade(docs, train(docs, labels, sample))
    return found.withColumn("toxic", (F.col("p_toxic") >= threshold).cast("int"))

"""Quality classifier: naive Bayes features under a linear support vector machine.

Indicators of n-grams (of words, and of word shapes, so that words never seen
before still say something) are scaled by their log-count ratio between the classes;
a linear hinge-loss model over the scaled indicators is fitted by dual coordinate
descent, and its margin is turned to a probability by a logistic fit on folds that
the margin's model has not seen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labelled, give_back, held_out, map_text, text_or_empty

#: Columns of the hashed feature space; labelled rows that a model is fitted on at most.
DIMENSIONS, SAMPLE = 1 << 18, 6_000
#: Entries of a worker's memo of words.
MEMO_WORDS = 200_000

_SHAPES = [
    (re.compile(r"[^\W\d_]+"), lambda m: _case(m.group())),
    (re.compile(r"\d+"), lambda m: "0"),
]
_RUNS = re.compile(r"(.)\1+")


def _case(word: str) -> str:
    if word.islower():
        return "a"
    if word.isupper():
        return "A" if len(word) > 1 else "I"
    return "Aa" if word[:1].isupper() and word[1:].islower() else "aA"


def shape_of(word: str) -> str:
    """A word's form: runs of letters by case, of digits, and its other signs as they are."""
    for pattern, name in _SHAPES:
        word = pattern.sub(name, word)
    return _RUNS.sub(r"\1\1", word)


class Features:
    """Hashed n-gram indicators of whole texts, with a bounded memo of words."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.mask = np.uint64(dimensions - 1)
        self.memo: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        from xxhash import xxh64_intdigest

        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        got = self.memo[word] = (xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"), 9), xxh64_intdigest(shape_of(word).encode("utf-8", "surrogatepass"), 10))
        return got

    def of(self, text: str) -> np.ndarray:
        """The sorted distinct feature numbers of a text; an empty text has the one of an empty line."""
        words = text.split()
        known = self.memo.get
        pairs = [known(w) or self._word(w) for w in words]
        h = np.array(pairs, dtype=np.uint64).reshape(-1, 2)
        word, shape = h[:, 0], h[:, 1]
        again = np.zeros(len(word), dtype=bool)
        again[1:] = word[1:] == word[:-1]
        shape = np.where(again, np.uint64(0x5851F42D4C957F2D), shape)
        grams = [_mix(word, 1), _mix(shape, 2)]
        if len(word) > 1:
            grams += [_mix(word[:-1] * _A + word[1:], 3), _mix(shape[:-1] * _A + shape[1:], 4)]
        if len(word) > 2:
            grams.append(_mix((shape[:-2] * _A + shape[1:-1]) * _A + shape[2:], 5))
        # lines: how often one comes again, as an indicator of its own
        lines = text.split("\n")
        repeats = len(lines) - len(set(lines))
        share = 4 * repeats // max(1, len(lines))
        grams.append(_mix(np.array([share, 100 + min(repeats, 5)], dtype=np.uint64), 6))
        return np.unique((np.concatenate(grams) & self.mask).astype(np.int64))


_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind * 0xC2B2AE3D27D4EB4F % (1 << 64))) * _A
    return (x ^ (x >> np.uint64(29))) * _B >> np.uint64(20)


@dataclass(frozen=True)
class Model:
    """weights: by feature, the log-count ratio times the machine's weight."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    dimensions: int = DIMENSIONS

    def score(self, features: np.ndarray) -> float:
        margin = float(self.weights[features].sum()) / np.sqrt(max(1, len(features))) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, dimensions: int, alpha: float = 1.0) -> np.ndarray:
    """log((p + alpha) / |p|) - log((q + alpha) / |q|) over the documents of each class.

    Counts are of documents, |p| and |q| their smoothed sums."""
    p = np.full(dimensions, alpha)
    q = np.full(dimensions, alpha)
    for x, label in zip(rows, y, strict=True):
        (p if label else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dimensions: int, passes: int = 25, seed: int = 7
) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum of cost_i * hinge_i: one dual variable at a time, in a random order.

    y is -1 or 1. The bias is the weight of one more feature that is always 1. Ends
    after `passes` or when the projected gradients lie within 0.01.
    """
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(dimensions), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([1.0 + float(v @ v) for v in values])
    for _ in range(passes):
        high, low = -np.inf, np.inf
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (float(w[x] @ v) + bias) - 1.0
            pg = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == cost[i] else g
            high, low = max(high, pg), min(low, pg)
            if pg:
                old = alpha[i]
                alpha[i] = min(max(old - g / norm[i], 0.0), cost[i])
                step = (alpha[i] - old) * y[i]
                w[x] += step * v
                bias += step
        if high - low < 0.01:
            break
    return w, bias


def _machine(rows: list[np.ndarray], y: np.ndarray, dimensions: int, c: float) -> tuple[np.ndarray, float]:
    ratio = log_count_ratios(rows, y, dimensions)
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.array([(y <= 0).mean(), (y > 0).mean()])
    cost = c * np.where(y > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))
    w, bias = dual_coordinate_descent(rows, values, sign, cost, dimensions)
    return ratio * w, bias


def fit(rows: list[np.ndarray], y: np.ndarray, dimensions: int = DIMENSIONS, c: float = 1.0, folds: int = 3) -> Model:
    """Fit on feature rows and labels 0 or 1; with one class only (or no rows) the score is its share."""
    y = np.asarray(y)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(dimensions), 0.0, 1.0, float(np.log(share / (1 - share))), dimensions)
    margins = np.zeros(len(y))
    fold = np.random.default_rng(3).permutation(len(y)) % folds
    for k in range(folds):
        seen = fold != k
        if y[seen].min() == y[seen].max():
            seen = np.ones(len(y), dtype=bool)
        w, bias = _machine([rows[i] for i in np.flatnonzero(seen)], y[seen], dimensions, c)
        for i in np.flatnonzero(fold == k):
            margins[i] = w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + bias
    slope, offset = _logistic(margins, y)
    w, bias = _machine(rows, y, dimensions, c)
    return Model(w, bias, slope, offset, dimensions)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton's steps, with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta, x = np.array([1.0, 0.0]), np.c_[m, np.ones(len(m))]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * (beta - [1.0, 0.0]))
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """A model of `labels.quality` from at most `sample` labelled rows outside the held-out
    class. The driver gets their feature numbers only, a bounded amount."""
    texts = bounded_labelled(docs, labels, "quality", sample).select("target", "doc_id", "text")

    def run(values: list) -> dict[str, list]:
        features = _features(dimensions)
        return {"features": [features.of(t).astype(np.int32).tobytes() for t in values]}

    got = map_text(texts, run, "features binary", after=_forget).orderBy("doc_id").collect()
    rows = [np.frombuffer(r["features"], dtype=np.int32).astype(np.int64) for r in got]
    return fit(rows, np.array([r["target"] for r in got], dtype=int), dimensions)


_CACHE: dict[int, Features] = {}


def _features(dimensions: int) -> Features:
    return _CACHE.get(dimensions) or _CACHE.setdefault(dimensions, Features(dimensions))


def _forget() -> None:
    _CACHE.clear()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row per row of `docs`, from the text alone.

    A null text counts as empty; an empty text has a score like any other. Repeated
    rows stay, other columns are not read. Narrow: the model (its size is the feature
    space's, 1 MB by default) goes out once as a broadcast.
    """
    spark = docs.sparkSession
    small = replace(model, weights=model.weights.astype(np.float32))
    sent = spark.sparkContext.broadcast(small)

    def run(values: list) -> dict[str, list]:
        held = sent.value
        features = _features(held.dimensions)
        return {"score": [held.score(features.of(text)) for text in values]}

    return map_text(docs.select("doc_id", text_or_empty().alias("text")), run, "score double", after=_forget)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model trained on `labels`.

    With no usable labels every score is one half's smoothed share (0.5)."""
    scored = score(docs, train(docs, labels, sample))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, all columns as they are. Narrow.

    A null text is scored as an empty one; repeated rows stay or go together; very long texts are
    scored whole; columns of any other name are carried through; an empty table stays empty."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    sent = docs.sparkSession.sparkContext.broadcast(replace(model, weights=model.weights.astype(np.float32)))
    arrow, at_text = to_arrow_schema(docs.schema), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        features = Features(held.dimensions)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                good = [held.score(features.of(t or "")) >= threshold for t in part.column(at_text).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.filter(pa.array(good)).columns, arrow, strict=True)], schema=arrow)
        del features
        give_back()

    return docs.mapInArrow(run, docs.schema)

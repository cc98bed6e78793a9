"""Quality scores from preference pairs: a Bradley-Terry model of document features.

A pair says that one document is better than another; the model gives each document a strength that is additive in its
features, and the chance that one beats the other is the logistic function of the difference of strengths. It is fitted
by the logistic loss on feature differences. A quantile of the strengths is the threshold of the decision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_trie import in_blocks
from .common import learnable

FEATURES = ("words", "word_size", "upper", "symbols", "digits", "distinct", "repeats", "ends", "bare", "lines", "common", "caps")
#: Ranges of a feature's values, by quantiles of the sample: strengths may rise and fall along a feature.
RANGES = 12
_LETTERS = bytes(range(128, 256)) + b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ORDINARY_ENDS = _LETTERS + b"0123456789.,;:?!)\"'"
_SYMBOLS = bytes(c for c in range(33, 127) if c not in _ORDINARY_ENDS)


def features(text: str | None) -> list[float]:
    """Numbers that tell prose from junk, from the whole text; all are 0 for an empty one."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = counts[list(_LETTERS)].sum() or 1
    lower = raw.lower().split()
    seen = set(lower)
    lines = [x for x in raw.split(b"\n") if x]
    odd = sum(w[-1] not in _ORDINARY_ENDS for w in words)
    return [
        np.log1p(n),
        size / n,
        counts[65:91].sum() / letters,
        counts[list(_SYMBOLS)].sum() / size,
        counts[48:58].sum() / size,
        len(seen) / n**0.8,
        sum(map(bytes.__eq__, lower, lower[1:])) / n,
        odd / n,
        sum(len(w) == 1 and w in _SYMBOLS for w in words) / n,
        len(set(lines)) / max(1, len(lines)),
        counts[33] / size,
        sum(w.isupper() for w in words) / n,
    ]


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of each whole text; rows stay one for one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in in_blocks(batch, 4_000_000):
                x = [features(t) for t in block.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


class PairRanker:
    """Strengths that are a sum over features of a weight for the range the feature's value is in."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int, seed: int, rounds: int = 300):
        self.cuts = [np.unique(np.quantile(col, np.linspace(0, 1, RANGES + 1)[1:-1])) for col in x.T]
        design = self._design(x)
        self.weights = np.zeros(design.shape[1])
        self.threshold = 0.0
        yes, no = np.flatnonzero(good), np.flatnonzero(~good)
        if not len(yes) or not len(no):
            return
        rng = np.random.default_rng(seed)
        better, worse = rng.choice(yes, pairs), rng.choice(no, pairs)
        step = np.zeros_like(self.weights)
        for _ in range(rounds):
            strength = design @ self.weights
            lost = 1 / (1 + np.exp(strength[better] - strength[worse]))
            pull = np.bincount(better, lost, len(x)) - np.bincount(worse, lost, len(x))
            gradient = design.T @ pull / pairs - 1e-4 * self.weights
            step = 0.9 * step + 2.0 * gradient
            self.weights += step
        # as many documents fall below the threshold as are labelled 0
        self.threshold = float(np.quantile(design @ self.weights, len(no) / len(x)))

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(np.searchsorted(c, col, side="left")[:, None] == np.arange(len(c) + 1)).astype(float) for c, col in zip(self.cuts, x.T, strict=True)])

    def score(self, x: np.ndarray, at_threshold: float) -> np.ndarray:
        """0 to 1, `at_threshold` for a document at the threshold."""
        shift = np.log(at_threshold / (1 - at_threshold))
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights - self.threshold + shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, pairs: int = 100_000, seed: int = 5) -> PairRanker | None:
    """A ranker from at most `sample_rows` labelled documents of the learnable fold (the bound that lets the driver hold
    their features), picked by a hash of their id. None if there are no such rows. Null labels and ids are left out."""
    usable = labels.where(learnable(F.col("doc_id")) & F.col("quality").isNotNull()).select("doc_id", "quality")
    drawn = usable.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "quality").limit(sample_rows)
    # at most sample_rows rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id", "left_semi")
    quality = dict(drawn.groupBy("doc_id").agg(F.avg("quality")).collect())
    rows = featured(texts).orderBy("doc_id").collect()
    if not rows:
        return None
    return PairRanker(np.array([r["x"] for r in rows]), np.array([quality[r["doc_id"]] >= 0.5 for r in rows]), pairs, seed)


def score_quality(docs: DataFrame, ranker: PairRanker | None, at_threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text: score is 0 to 1, predicted 1 from `at_threshold` on.

    Null and empty texts are scored by their features like others; without a ranker every score is `at_threshold`.
    Rows stay one for one, repeats included; other columns aren't returned.
    """
    if ranker is None:
        return docs.select("doc_id", F.lit(at_threshold).alias("score"), F.lit(1).alias("predicted"))
    model = docs.sparkSession.sparkContext.broadcast(ranker)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in in_blocks(batch, 4_000_000):
                x = np.array([features(t) for t in block.column(1).to_pylist()])
                score = model.value.score(x, at_threshold)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(score), pa.array((score >= at_threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")

"""Quality classifier: regularised quadratic discriminant over document statistics.

Class means and covariances come from sums over all labelled training rows (small sums per class, no sample). Each
covariance is shrunk towards the pooled one and its diagonal; its Cholesky factor is computed once and sent with
the scoring tasks. A score is the posterior of label 1 from the difference of the two Mahalanobis log-densities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textloom.llm.common import materialize

FEATURES = ("words", "upper", "symbols", "stops", "digits", "distinct", "repeats", "length", "spread", "top", "lines", "foreign", "entropy", "blanks")
#: Weights of the pooled covariance and of its diagonal in each class covariance.
POOLED, DIAGONAL = 0.2, 0.1
#: What short texts are filled up with, in words and bytes.
WORDS, BYTES = 16, 100
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:'\"()-?"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_UPPER | _LOWER | _DIGIT | _STOP)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text; all 0 for a text without words."""
    data = (text or "").encode("utf-8", "replace")
    words = data.lower().split()
    if not words:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, upper, lower = len(words), int(c[_UPPER].sum()), int(c[_LOWER].sum())
    space, wide = int(c[_SPACE].sum()), int(c[128:].sum())
    solid = len(data) - space
    lengths = np.fromiter(map(len, words), np.float64, n)
    p = c[c > 0] / len(data)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    # short texts say little: every ratio and mean is taken together with a few words of ordinary writing
    part = lambda a, b, more: np.log1p(50.0 * a / (b + more))
    mean = (lengths.sum() + 6.0 * WORDS) / (n + WORDS)
    spread = (((lengths - mean) ** 2).sum() + 9.0 * WORDS) / (n + WORDS)
    size = len(data)
    return [
        float(np.log1p(n)),
        part(upper, upper + lower, BYTES),
        part(int(c[_SYMBOL].sum()), solid, BYTES),
        part(int(c[_STOP].sum()), solid, BYTES),
        part(int(c[_DIGIT].sum()), solid, BYTES),
        float(np.log1p(len(counts) + WORDS) / np.log1p(n + WORDS)),
        part(sum(map(bytes.__eq__, words, words[1:])), n, WORDS),
        float(np.log(mean)),
        float(np.log(spread)) / 2,
        part(max(counts.values()) - 1, n, WORDS),
        float((len(set(lines)) + 4) / (len(lines) + 4)),
        part(wide, solid, BYTES),
        float((-(p * np.log2(p)).sum() * size + 4.2 * BYTES) / (size + BYTES)),
        part(space, size, BYTES),
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            x = _statistics(part.column(1))
            ends = pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_featured, "doc_id long, x array<double>")


def crc_mod(column: str, n: int):
    """crc32 of an identifier's decimal text, modulo n; null gives null."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    sums = {}
    for batch in batches:
        x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, d)
        x = np.hstack([np.ones((len(x), 1)), x])
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for label in np.unique(y):
            own = x[y == label]
            sums[int(label)] = sums.get(int(label), 0) + own.T @ own
    rows = [(k, i, float(v)) for k, m in sums.items() for i, v in enumerate(m.ravel())]
    labels, at, values = zip(*rows) if rows else ((),) * 3
    yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(at, pa.int32()), pa.array(values, pa.float64())], names=["label", "at", "v"])


def _parts(texts: pa.Array, rows: int = 512) -> Iterator[pa.Array]:
    for lo in range(0, len(texts), rows):
        yield texts.slice(lo, rows)


def _statistics(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts.to_pylist()]).reshape(-1, len(FEATURES))


class Discriminant:
    """Means, inverse Cholesky factors and log priors of the two classes, from their moment matrices."""

    def __init__(self, moments: dict[int, np.ndarray]):
        self.prior = None if len(moments) == 2 else float(1 in moments) if moments else 0.5
        if self.prior is not None:
            return
        n = {k: m[0, 0] for k, m in moments.items()}
        mean = {k: m[0, 1:] / n[k] for k, m in moments.items()}
        cov = {k: m[1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k, m in moments.items()}
        total = sum(n.values())
        pooled = sum(n[k] * cov[k] for k in cov) / total
        floor = 1e-4 * np.eye(len(pooled))
        self.classes = []
        for k in (0, 1):
            own = (1 - POOLED - DIAGONAL) * cov[k] + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled)) + floor
            factor = np.linalg.cholesky(own)
            self.classes.append((mean[k], np.linalg.inv(factor).T, np.log(n[k] / total) - np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        logs = [c - 0.5 * (((x - m) @ inverse) ** 2).sum(1) for m, inverse, c in self.classes]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit(labelled: DataFrame) -> Discriminant:
    """The model of rows (x, label); null labels are left out; a missing class makes scores constant."""
    d = len(FEATURES) + 1
    sums = labelled.where("label in (0, 1)").select("x", F.col("label").cast("int").alias("label")).mapInArrow(_moments, "label int, at int, v double")
    moments: dict[int, np.ndarray] = {}
    for label, at, v in sums.groupBy("label", "at").agg(F.sum("v")).collect():  # 2 * d * d rows
        moments.setdefault(label, np.zeros(d * d))[at] = v
    return Discriminant({k: m.reshape(d, d) for k, m in moments.items()})


def _scored(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def quality_model(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> tuple[Discriminant, DataFrame]:
    """The model fitted on labelled rows outside the held-out fold, and the (doc_id, x) table of all documents."""
    x = materialize(features(docs), "features")
    train = labels.select(F.col("doc_id"), F.col("quality").alias("label")).where(crc_mod("doc_id", folds) != held)
    return fit(x.join(train, "doc_id")), x


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, reject_below: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Null and empty texts are scored by zero statistics. Null ids are not held out. Repeated rows are scored each;
    repeated labels each count in the fit. Extra columns are ignored. Without labels of both classes the score is the
    one class seen, or 0.5.
    """
    model, x = quality_model(docs, labels, folds, held)
    scored = x.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= reject_below).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, reject_below: float = 0.7) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns (and no others).

    Every row is judged by its own text, whatever its id; null and empty texts by zero statistics. The statistics are
    worked out for the fit and again for the decision, so that texts are neither shuffled nor written a second time.
    """
    model, _ = quality_model(docs, labels, folds, held)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.score(_statistics(part)) for part in _parts(texts)] or [np.empty(0)]))

    return docs.where(score(F.col("text").cast("string")) >= reject_below)

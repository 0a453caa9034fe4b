"""A quality classifier: regularised quadratic discriminant over statistics of whole texts.

Each class has a Gaussian over transformed statistics.  Its covariance is shrunk towards the pooled
covariance and that towards a multiple of the identity; scores are differences of log densities from
Mahalanobis distances, with the Cholesky factors of both classes computed once on the driver.  Fitting
needs only sums over all labelled rows, which Spark aggregates; nothing but those sums leaves it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_lake.llm import wordwise
from evidence_lake.llm.arrow import bounded_batches

#: Shares of the pooled covariance in a class covariance, and of the identity in the pooled one.
TOWARDS_POOLED, TOWARDS_IDENTITY = 0.1, 0.05
THRESHOLD = 0.3
#: Bytes of ordinary text that a text's shares of characters are diluted with.
PADDING = 200

_KINDS = ("upper", "lower", "digit", "space", "line", "stop", "comma", "bang", "bar", "symbol", "bracket", "other", "wide")
_OF_BYTE = np.full(256, _KINDS.index("other"))
for _kind, _bytes in {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "space": (0x20, 0x09),
    "line": (0x0A, 0x0D),
    "stop": b".?:;",
    "comma": b",",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~+=_\\/",
    "bracket": b"<>(){}[]\"'-",
    "wide": range(0x80, 0x100),
}.items():
    _OF_BYTE[list(_bytes)] = _KINDS.index(_kind)

FEATURES = (
    "log_words", "word_length", "word_spread", "distinct_words", "distinct_lines", "line_words",
    "upper", "digit", "stop", "comma", "bang", "bar", "symbol", "bracket", "other", "wide",
)


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a slice."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(row * len(_KINDS) + _OF_BYTE[data], minlength=n * len(_KINDS)).reshape(n, -1)
    starts, ends, first = wordwise.word_spans(data, offsets)
    words = np.diff(first)
    length = ends - starts
    of = np.repeat(np.arange(n), words)
    total = np.bincount(of, length, minlength=n)
    square = np.bincount(of, length.astype(float) ** 2, minlength=n)
    some = np.maximum(words, 1)
    mean = total / some
    spread = np.sqrt(np.maximum(square / some - mean**2, 0))
    hashes = wordwise.word_hashes(data, starts, ends)
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=n)
    lines = kinds[:, _KINDS.index("line")] + 1
    texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    distinct_lines = np.array([len(set(t.split(b"\n"))) for t in texts], dtype=float)
    # short texts count as padded with ordinary ones, so that a few characters decide nothing
    share = lambda kind: np.sqrt(kinds[:, _KINDS.index(kind)] / (sizes + PADDING))
    return np.column_stack(
        [
            np.log1p(words),
            np.log1p((total + 5 * 10) / (words + 10)),
            np.log1p(spread),
            # distinct words fall as a power of the length; the ratio of logs hardly depends on it
            np.log1p(distinct + 10) / np.log1p(some + 10),
            np.log1p(distinct_lines + 5) / np.log1p(np.maximum(lines, distinct_lines) + 5),
            np.log1p(words / lines),
            *[share(kind) for kind in FEATURES[6:]],
        ]
    )


def measured(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; NULL counts as empty."""
    parts = [_statistics(data, offsets) for _, _, data, offsets in wordwise.slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def features(text: Column) -> Column:
    """Array of FEATURES."""

    def of(texts: pa.Array) -> pa.Array:
        rows = measured(texts)
        ends = pa.array(np.arange(0, rows.size + 1, len(FEATURES)), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))

    return F.arrow_udf(of, "array<double>")(text)


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians in standardised coordinates: for each class the log prior, mean, inverse Cholesky
    factor and log determinant.  ``constant`` is the score where a class has no rows to learn from."""

    centre: np.ndarray | None
    scale: np.ndarray | None
    classes: tuple[tuple[float, np.ndarray, np.ndarray, float], ...]
    constant: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, by the model, for each row."""
        if not self.classes:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        log = []
        for prior, mean, inverse, determinant in self.classes:
            distance = (((z - mean) @ inverse.T) ** 2).sum(axis=1)
            log.append(prior - 0.5 * (distance + determinant))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(
    labelled: DataFrame,
    label: str = "quality",
    towards_pooled: float = TOWARDS_POOLED,
    towards_identity: float = TOWARDS_IDENTITY,
) -> Discriminant:
    """From rows (features, label 0/1); rows with a NULL label are left out."""
    d = len(FEATURES)
    x = [F.col("features")[i] for i in range(d)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = {
        int(r["y"]): r
        for r in labelled.where(F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int").alias("y"))
        .agg(F.count("*").alias("n"), *sums, *products)
        .collect()  # two rows at most
    }
    n = {y: rows[y]["n"] if y in rows else 0 for y in (0, 1)}
    if min(n.values()) < 2:
        return Discriminant(None, None, (), (n[1] + 1) / (n[0] + n[1] + 2))
    mean, second = {}, {}
    for y, r in rows.items():
        mean[y] = np.array([r[f"s{i}"] for i in range(d)]) / n[y]
        upper = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                upper[i, j] = r[f"p{i}_{j}"]
        second[y] = (upper + np.triu(upper, 1).T) / n[y]
    every = n[0] + n[1]
    centre = (n[0] * mean[0] + n[1] * mean[1]) / every
    within = {y: second[y] - np.outer(mean[y], mean[y]) for y in (0, 1)}
    pooled = (n[0] * within[0] + n[1] * within[1]) / every
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    pooled = pooled / np.outer(scale, scale)
    pooled = (1 - towards_identity) * pooled + towards_identity * np.eye(d) * max(np.trace(pooled) / d, 1e-3)
    classes = []
    for y in (0, 1):
        own = within[y] / np.outer(scale, scale)
        factor = np.linalg.cholesky((1 - towards_pooled) * own + towards_pooled * pooled)
        determinant = 2 * np.log(np.diag(factor)).sum()
        classes.append((np.log(n[y] / every), (mean[y] - centre) / scale, np.linalg.inv(factor), determinant))
    return Discriminant(centre, scale, tuple(classes), 0.5)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from: crc32 of the id as text is divisible by 5.  False for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text"
) -> Discriminant:
    """Fit on the texts of all rows of ``docs`` that have a label and are not held out."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_label")).where(~held_out(F.col("_id")))
    texts = docs.select(F.col(doc_id).alias("_doc"), features(F.col(text)).alias("features"))
    return fit(texts.join(known, F.col("_doc") == F.col("_id")).select("features", "_label"), "_label")


def score(model: Discriminant, text: Column) -> Column:
    """The model's score of a text, from 0 to 1."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(measured(texts)))

    return F.arrow_udf(of, "double")(text)


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from ``threshold`` on).

    Scores depend on the text alone; NULL and empty texts are texts without words.  Rows that repeat a
    doc_id are scored each; repeated labels count each time; NULL ids have no label and are not held out.
    Without labels of both classes every score is the smoothed share of class 1.  Columns of ``docs`` with
    the new names are replaced.
    """
    scored = docs.drop("held_out", "predicted").withColumn(
        "score", score(learn(docs, labels, label, doc_id, text), F.col(text))
    )
    return scored.withColumns(
        {"held_out": held_out(F.col(doc_id)), "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0)}
    )

"""Operator 9: a quality classifier by regularised quadratic discriminants.

A document becomes a few transformed statistics of its whole text (one pass,
written once). The training rows give, for each class, a count, a mean and a
covariance from one aggregate of sums and products; two rows reach the
driver. Covariances are shrunk towards the pooled diagonal, and their inverse
Cholesky factors are computed once and travel with the scoring function. The
score is the logistic of the difference of the two log-densities (Mahalanobis
distance and log-determinant) plus the log prior odds.

Only statistics of the text are inputs. Training uses every labelled row whose
CRC-32 of the id's digits is not 0 modulo 5; nothing is sampled.

Edge cases: null and empty texts have all-zero counts and get a score as any
other; a null id is not held out and has no label; rows that share an id share
its label; conflicting labels all count; if a class has fewer than two
training rows every score is the share of label 1 (0.5 without labels);
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featflow.llm import text as T
from featflow.llm.quality_rules import _per_range, measures
from featflow.llm.store import written

FEATURES = ("log_words", "word_length", "symbols", "duplicate_lines", "repeated_words", "capitals", "line_words", "marks", "digits")
SHRINKAGE = 0.15
FLOOR = 1e-3
THRESHOLD = 0.3

_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:()'\"-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def statistics(words: T.Words) -> np.ndarray:
    """(documents x FEATURES): counts as ratios, under roots and logs that
    bring them near to normal."""
    m = {k: v.astype(float) for k, v in measures(words).items()}
    n = np.maximum(m["n_words"], 1)
    chars = np.maximum(m["word_chars"], 1)
    marks = _per_range(_MARK[words.data], words.offsets) / chars
    digits = _per_range(_DIGIT[words.data], words.offsets) / chars
    letters = np.maximum(m["n_upper"] + m["n_lower"], 1)
    return np.column_stack([
        np.log1p(m["n_words"]), np.minimum(m["word_chars"] / n, 50.0), np.sqrt(np.minimum(m["n_symbols"] / n, 25.0)),
        np.sqrt(m["n_dup_lines"] / np.maximum(m["n_lines"], 1)), np.sqrt(m["n_repeat_words"] / n), np.sqrt(m["n_upper"] / letters),
        np.log1p(n / np.maximum(m["n_lines"], 1)), np.sqrt(np.minimum(marks, 4.0)), np.sqrt(np.minimum(digits, 1.0))])


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words in T.blocks(batch):
            x = statistics(words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id")] + [pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1])],
                                             names=["doc_id", *FEATURES])


class Model(NamedTuple):
    """Means, inverse Cholesky factors and log offsets of classes 0 and 1."""
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = (x - mean) @ factor.T
            density.append(offset - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit_moments(count: list[float], total: list[np.ndarray], product: list[np.ndarray], shrinkage: float = SHRINKAGE) -> Model:
    """The model from each class's count, sums and sums of products."""
    n = sum(count)
    if min(count) < 2:
        return Model([], [], [], count[1] / n if n else 0.5)
    means = [t / c for t, c in zip(total, count)]
    cov = [p / c - np.outer(m, m) for p, c, m in zip(product, count, means)]
    pooled = np.diag((count[0] * cov[0] + count[1] * cov[1]) / n)
    factors, offsets = [], []
    for c, k in zip(cov, count):
        shrunk = (1 - shrinkage) * c + shrinkage * np.diag(pooled) + FLOOR * np.eye(len(c))
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(k / n) - np.log(np.diag(lower)).sum()))
    return Model(means, factors, offsets, count[1] / n)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Fit on the labelled rows of ``stats`` that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")) \
        .where("label in (0, 1) and doc_id is not null").distinct()
    rows = stats.where(~held_out(F.col("doc_id"))).join(known, "doc_id")
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}     # two rows
    count, total, product = [], [], []
    for k in (0, 1):
        r = found.get(k)
        count.append(float(r["n"]) if r else 0.0)
        total.append(np.array([r[f"s{i}"] for i in range(d)]) if r else np.zeros(d))
        p = np.zeros((d, d))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"] if r else 0.0
        product.append(p)
    return fit_moments(count, total, product)


def _score_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.scores(x), pa.float64())],
                                         names=["doc_id", "held_out", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats, _ = written(own.mapInArrow(_statistic_rows, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)), "statistics")
    model = fit(stats, labels, label_col)
    scored = stats.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(
        partial(_score_rows, model=model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _judge_rows(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [model.scores(statistics(words)) >= threshold for _, words in T.blocks(batch, "__text")]
        mask = pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))
        yield batch.filter(mask).drop_columns(["__text"])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, all columns."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    trained = own.where(~held_out(F.col("doc_id")))       # statistics, not texts, meet the labels
    model = fit(trained.mapInArrow(_statistic_rows, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)), labels, label_col)
    return docs.withColumn("__text", F.col(text_col).cast("string")).mapInArrow(
        partial(_judge_rows, model=model, threshold=threshold), docs.schema)

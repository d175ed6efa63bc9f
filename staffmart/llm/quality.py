"""Quality by a regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics. Per class the mean and covariance come from sums over all labelled rows outside the
held-out fold; covariances are shrunk towards the pooled one and towards a multiple of the identity. The Cholesky factors are computed once
and sent to the tasks; a text's score is the logistic of the difference of the two log-densities (Mahalanobis distance and
log-determinant) and of the class shares.

Defined results: a NULL or empty text has the statistics of no words; NULL ids are scored and never used for learning; ids
labelled more than once count as good only if all labels say so; without two rows of each class every score is the share of good ones, or 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.llm.perplexity import base_counts
from staffmart.llm.text import fold, split_words, sums, text_column
from staffmart.operators.joins import lookup
from staffmart.session import materialise

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
TO_POOLED, TO_IDENTITY = 0.1, 0.02  # shrinkage
STATISTICS = ("words", "word_length", "symbols", "symbol_words", "punctuation", "digits", "capitals", "distinct", "repeated", "dup_lines", "line_words")


def statistics(texts: pa.Array) -> pa.Array:
    """The transformed statistics of every text."""
    texts = pa.concat_arrays([texts])
    flat, bounds = split_words(texts)
    coded = flat.dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    base = base_counts(texts, ids, bounds, words)
    n, chars = np.maximum(base["n_words"], 1), np.maximum(base["word_chars"], 1)
    per_word = lambda pattern: pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    total = lambda values: sums(values[ids], bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    _, first = np.unique(doc * max(len(words), 1) + ids, return_index=True)
    distinct = np.bincount(doc[first], minlength=len(texts))
    lines = pc.add(pc.count_substring(texts, "\n"), 1).to_numpy(zero_copy_only=False)
    share = lambda count, of: np.log((count + 0.1) / (of + 1.0))
    columns = (
        np.log1p(base["n_words"]),
        np.log(chars / n),
        share(base["n_symbols"], chars),
        share(total((per_word(r"[#*$%&|<>]") > 0).astype(np.int64)), n),
        share(total(per_word(r"[.,;:!?]")), chars),
        share(total(per_word(r"[0-9]")), chars),
        share(total(per_word(r"[A-Z]")), chars),
        np.log((distinct + 1.0) / (n + 1.0)) / np.log(n + 2.0),
        share(base["n_repeat_words"], n),
        share(base["n_dup_lines"], lines),
        np.log1p(base["n_words"] / lines),
    )
    edges = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(columns))
    return pa.ListArray.from_arrays(edges, pa.array(np.stack(columns, axis=1).astype(np.float64).ravel()))


@dataclass
class Discriminant:
    """Per class: mean, Cholesky factor of the shrunk covariance, log-determinant; and the log of the class odds."""

    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_odds: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        densities = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            white = np.linalg.solve(factor, (rows / self.scale - mean).T)
            densities.append(-0.5 * (white**2).sum(axis=0) - 0.5 * log_det)
        gap = densities[1] - densities[0] + self.log_odds
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fit(labelled: DataFrame) -> Discriminant | float:
    """From rows (cls, x); the constant score if a class is missing."""
    size = len(STATISTICS)
    x = lambda i: F.get("x", F.lit(i))
    moments = [F.sum(x(i)).alias(f"s{i}") for i in range(size)]
    moments += [F.sum(x(i) * x(j)).alias(f"s{i}_{j}") for i in range(size) for j in range(i, size)]
    rows = {r["cls"]: r for r in labelled.groupBy("cls").agg(F.count("*").alias("n"), *moments).collect()}
    counts = {c: rows[c]["n"] if c in rows else 0 for c in (0, 1)}
    if min(counts.values()) < 2:
        return counts[1] / sum(counts.values()) if sum(counts.values()) else 0.5
    means, covariances = [], []
    for c in (0, 1):
        mean = np.array([rows[c][f"s{i}"] for i in range(size)]) / counts[c]
        second = np.array([[rows[c][f"s{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]) / counts[c]
        means.append(mean)
        covariances.append(second - np.outer(mean, mean))
    pooled = (counts[0] * covariances[0] + counts[1] * covariances[1]) / sum(counts.values())
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    pooled = pooled / np.outer(scale, scale)
    factors, log_dets = [], []
    for covariance in covariances:
        own = covariance / np.outer(scale, scale)
        shrunk = (1 - TO_POOLED - TO_IDENTITY) * own + TO_POOLED * pooled + TO_IDENTITY * np.eye(size)
        factors.append(np.linalg.cholesky(shrunk))
        log_dets.append(float(2 * np.log(np.diag(factors[-1])).sum()))
    return Discriminant(scale, [m / scale for m in means], factors, log_dets, float(np.log(counts[1] / counts[0])))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, quality_score) of every text, learnt from the labels outside the held-out fold."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    vectors = materialise(docs.select("id", text_column(statistics, "array<double>", F.col("text")).alias("x")), "statistics")
    marked = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("cls"))
    marked = marked.where(F.col("id").isNotNull() & F.col("cls").isin(0, 1) & (fold(F.col("id"), FOLDS) != HELD_OUT))
    model = fit(lookup(vectors, materialise(marked.withColumnRenamed("id", "marked"), "labels"), [("id", "marked")], how="inner"))
    if isinstance(model, float):
        return vectors.select("id", F.lit(model).alias("quality_score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "quality_score": pa.array(shared.value.score(x))})

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, quality_score double")

"""Toxicity by class-conditional Kneser-Ney models.

Two character models of running text, of toxic and of ordinary labelled texts, share their backoff counts for short contexts, so a
rare expression that neither class has settled gets the same smoothing in both. The log-likelihoods of its words in their context
under both are summed and divided by the text's length. Its most toxic words also count on their own, and so does the share of
toxic words, as a few of them make a long text toxic; each word is weighed both in its context and alone. A logistic
curve, fitted on labelled texts that the models have not seen, turns this into a score from 0 to 1.

Defined results: a NULL or empty text has no evidence and gets the curve's value at zero evidence; NULL ids are scored
and never used for learning; ids labelled more than once count as toxic if any label says so; repeated rows and ties get equal scores; texts of any length
are scored whole; an empty table gives an empty result; other columns are handed on; without labels of both classes every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.llm import kneser_ney
from staffmart.llm.text import fold, split_words, sums, text_column
from staffmart.operators.joins import lookup
from staffmart.session import materialise

FOLDS = 5  # fold 0 is held out
ORDER = 5
SHARED = 1  # counts of n-grams up to this length are shared by both classes
THRESHOLD = 0.5
CALIBRATION = 4  # one in so many training texts fits the curve, the others the models
TOP = 5  # the most toxic words of a text that count on their own
STEPS = (1.0, 2.0, 3.0, 4.0, 6.0)  # differences beyond which words are counted
MOST = 2.0  # a character counts at most so much for or against toxicity
FEATURES = 2 * (4 + len(STEPS)) + 1


@dataclass
class Classifier:
    model: kneser_ney.Model | None
    weights: tuple[float, ...]
    intercept: float


def evidence(model: kneser_ney.Model, texts: pa.Array) -> pa.Array:
    """Per text the numbers the curve is fitted on: for its words in context and for its words alone the mean difference per
    character, the differences of its most toxic words and the shares of words beyond each of ``STEPS``; then its length."""
    words, bounds = split_words(pa.concat_arrays([texts]))
    values, lengths = kneser_ney.word_values(model, words, bounds, MOST)
    count, rows = np.diff(bounds), len(texts)
    columns = []
    for gap in values:
        columns.append(sums(gap, bounds) / np.maximum(sums(lengths, bounds), 1))
        ranked = gap[np.lexsort((-gap, np.repeat(np.arange(rows), count)))]
        top = np.zeros((TOP, rows))
        for k in range(TOP):
            top[k, count > k] = ranked[bounds[:-1][count > k] + k]
        columns += [top[0], top[1], top.mean(axis=0)]
        columns += [sums((gap > step).astype(np.float64), bounds) / np.maximum(count, 1) for step in STEPS]
    flat = np.array([*columns, np.log1p(count)]).T.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * FEATURES), pa.array(flat))


def evidence_column(model: kneser_ney.Model, text: Column) -> Column:
    return text_column(lambda texts: evidence(model, texts), "array<double>", text, kneser_ney.SCORED_BYTES)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Learn from the labelled rows of ``docs`` outside fold 0, all of them."""
    marked = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("cls"))
    marked = materialise(marked.where(F.col("id").isNotNull() & F.col("cls").isin(0, 1) & (fold(F.col("id"), FOLDS) != 0)), "labels")
    rows = lookup(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), marked, [("id", "id")], how="inner")
    rows = rows.withColumn("fits", F.pmod(F.xxhash64("id"), F.lit(CALIBRATION)) == 0)
    classes = {r["cls"] for r in marked.select("cls").distinct().collect()}
    if classes != {0, 1}:
        return Classifier(None, (), float("-inf"))
    model = kneser_ney.fit(rows.where(~F.col("fits")), ORDER, SHARED, (-1.0, 1.0))
    seen = rows.where("fits").select("cls", array_to_vector(evidence_column(model, F.col("text"))).alias("features"))
    seen = materialise(seen, "evidence")
    if seen.select("cls").distinct().count() < 2:
        return Classifier(model, (0.0, 1.0) + (0.0,) * (FEATURES - 2), -1.0)  # too few labels for a curve: no evidence is no toxicity
    # a unit normal prior on the weights of standardised evidence
    curve = LogisticRegression(labelCol="cls", regParam=1 / seen.count(), maxIter=50).fit(seen)
    return Classifier(model, tuple(float(w) for w in curve.coefficients), float(curve.intercept))


def score(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with the column toxic_score, from 0 to 1, in place of any column of that name."""
    if classifier.model is None:
        return docs.withColumn("toxic_score", F.lit(0.0))
    e = evidence_column(classifier.model, F.col(text_col))
    linear = F.lit(classifier.intercept)
    column = "_" * (1 + max(map(len, docs.columns)))  # longer than any of theirs
    for place, weight in enumerate(classifier.weights):
        linear = linear + F.lit(weight) * F.get(column, F.lit(place))
    return docs.withColumn(column, evidence_column(classifier.model, F.col(text_col))).withColumn("toxic_score", 1 / (1 + F.exp(-linear))).drop(column)

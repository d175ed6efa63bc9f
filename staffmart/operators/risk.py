"""Flight-risk model: training, evaluation and the ranked list of active staff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.operators.features import LABEL, ROW_KEY
from staffmart.session import scratch_root

# Settings of the boosted trees.
TREES, LEARNING_RATE, DEPTH, SUBSAMPLE, SEED = 150, 0.03, 4, 0.8, 42

RANKED_COLUMNS = ("FullName", "Email", "PayZone", "SatisfactionScore", "FlightRiskScore")


def fit_risk(
    train: DataFrame, features: Sequence[str], trees: int = TREES, seed: int = SEED
) -> Model:
    """Boosted trees over ``features`` with column ``weight``. Give it a stored training table.

    The boosting loop checkpoints its running predictions to the shared folder, so its lineage stays
    short over many trees.
    """
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(train.sparkSession))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    booster = GBTClassifier(
        labelCol=LABEL,
        featuresCol="features",
        weightCol="weight",
        maxIter=trees,
        stepSize=LEARNING_RATE,
        maxDepth=DEPTH,
        subsamplingRate=SUBSAMPLE,
        seed=seed,
    )
    return Pipeline(stages=[assembler, booster]).fit(train)


def percent(probability: Column) -> Column:
    """A probability in percent, two decimals, halves to even."""
    return F.bround(probability * 100, 2)


def score(model: Model, df: DataFrame) -> DataFrame:
    """Probability of leaving in percent."""
    risk = vector_to_array(F.col("probability"))[1]
    return model.transform(df).withColumn("FlightRiskScore", percent(risk))


def rank_risk(scored: DataFrame, key: str = ROW_KEY) -> DataFrame:
    """The whole list, highest risk first, ties by key."""
    return scored.orderBy(F.desc("FlightRiskScore"), key).select(*RANKED_COLUMNS)


def top_k(scored: DataFrame, k: int = 5, key: str = ROW_KEY) -> DataFrame:
    return scored.orderBy(F.desc("FlightRiskScore"), key).limit(k).select(*RANKED_COLUMNS)


def accuracy(predicted: DataFrame, label: str = LABEL) -> DataFrame:
    return predicted.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))


def classification_report(predicted: DataFrame, label: str = LABEL) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    One aggregation to the confusion counts; everything else works on those few rows.
    """
    truth, guess, n = F.col("truth"), F.col("guess"), F.col("n")
    confusion = predicted.groupBy(
        F.col(label).cast("int").alias("truth"), F.col("prediction").cast("int").alias("guess")
    ).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            truth.alias("class"),
            F.when(truth == guess, n).otherwise(zero).alias("hits"),
            zero.alias("guessed"),
            n.alias("support"),
        ),
        F.struct(guess.alias("class"), zero.alias("hits"), n.alias("guessed"), zero.alias("support")),
    )

    def quotient(part, whole):
        return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))

    classes = (
        confusion.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "guessed", "support")])
        .withColumn("precision", quotient(F.col("hits"), F.col("guessed")))
        .withColumn("recall", quotient(F.col("hits"), F.col("support")))
        .withColumn(
            "f1",
            quotient(
                F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")
            ),
        )
    )
    support = F.sum("support")
    scores = ("precision", "recall", "f1")
    nothing = F.lit(None).cast("double")
    per_class = classes.select(F.col("class").cast("string").alias("row"), *scores, "support")
    hit_rate = classes.agg(
        F.lit("accuracy").alias("row"),
        nothing.alias("precision"),
        nothing.alias("recall"),
        (F.sum("hits") / support).alias("f1"),
        support.alias("support"),
    )
    macro = classes.agg(
        F.lit("macro avg").alias("row"), *[F.avg(c).alias(c) for c in scores], support.alias("support")
    )
    weighted = classes.agg(
        F.lit("weighted avg").alias("row"),
        *[(F.sum(F.col(c) * F.col("support")) / support).alias(c) for c in scores],
        support.alias("support"),
    )
    rows = per_class.unionByName(hit_rate).unionByName(macro).unionByName(weighted)
    return rows.select("row", *[F.round(c, 6).alias(c) for c in scores], "support")

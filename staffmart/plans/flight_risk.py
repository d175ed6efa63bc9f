"""From the star to scored active staff."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.operators.features import (
    CATEGORICAL,
    LABEL,
    NUMERIC,
    active_rows,
    class_weight,
    feature_frame,
    impute,
    stratified_split,
)
from staffmart.operators.risk import TREES, classification_report, fit_risk, score
from staffmart.session import materialise


def encoded_features(star: Mapping[str, DataFrame], as_of: dt.date) -> tuple[DataFrame, list[str]]:
    """Imputed, encoded and split feature table, stored once, with its feature column names.

    Each category becomes one sparse vector with a place per level, whatever the levels are called and however many there
    are; a missing value is all zeros.
    """
    filled = materialise(impute(feature_frame(star, as_of)), "filled")  # read for levels, split and marking
    places, levels = [f"{c}Place" for c in CATEGORICAL], [f"{c}Levels" for c in CATEGORICAL]
    # "keep" gives missing values the last place, which the encoder drops.
    indexer = StringIndexer(inputCols=list(CATEGORICAL), outputCols=places, handleInvalid="keep", stringOrderType="alphabetAsc")
    encoder = OneHotEncoder(inputCols=places, outputCols=levels, dropLast=True)
    encoded = Pipeline(stages=[indexer, encoder]).fit(filled).transform(filled).drop(*places)
    return materialise(stratified_split(encoded), "features"), [*NUMERIC, *levels]


def train_risk(star: Mapping[str, DataFrame], as_of: dt.date, trees: int = TREES):
    """(model, stored feature table). Training sees the rows outside the test share."""
    table, features = encoded_features(star, as_of)
    train = class_weight(table.where(~F.col("is_test"))).select(LABEL, "weight", *features)
    return fit_risk(train, features, trees), table


def evaluate_risk(model, table: DataFrame) -> DataFrame:
    """Accuracy and class report of the trained model on the test share of its feature table."""
    return classification_report(model.transform(table.where("is_test")))


def scored_active(star: Mapping[str, DataFrame], as_of: dt.date, trees: int = TREES) -> DataFrame:
    """Active staff with FlightRiskScore; no active staff gives no rows."""
    model, table = train_risk(star, as_of, trees)
    found = score(model, active_rows(table))
    return found.select(*table.columns, "FlightRiskScore")

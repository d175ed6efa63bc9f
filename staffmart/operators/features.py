"""Feature frame, imputation, one-hot encoding, split and class weight for the risk model."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffmart.operators.fact import with_tenure
from staffmart.operators.joins import lookup

# The features, the label and the columns carried along.
NUMERIC = (
    "Age", "TenureDays", "EngagementScore", "SatisfactionScore", "WorkLifeBalanceScore", "TrainingCost",
)
CATEGORICAL = ("Gender", "MaritalStatus", "PayZone", "PerformanceScore", "TrainingOutcome")
LABEL = "AttritionFlag"
CARRIED = ("EmployeeStatus", "FullName", "Email")
ROW_KEY = "FactKey"

MEDIAN_COLUMNS = ("Age", "TenureDays")
# What a missing feature counts as. Gender and marital status stay missing.
CONSTANTS = {
    "TrainingCost": 0.0,
    "EngagementScore": 3.0,
    "SatisfactionScore": 3.0,
    "WorkLifeBalanceScore": 3.0,
    "PayZone": "Unknown",
    "PerformanceScore": "Fully Meets",
    "TrainingOutcome": "None",
}

# One column per level is refused beyond this; training uses sparse vectors, which have no such limit.
MAX_LEVELS = 1000
SPLIT_DIGITS = 4


def feature_frame(star: Mapping[str, DataFrame], as_of: dt.date) -> DataFrame:
    """Fact rows with a known employee, joined to that employee; numbers as double."""
    person = star["Dim_Employee"].select(
        F.col("EmployeeKey").alias("_person"), "Age", "Gender", "MaritalStatus", "FullName", "Email"
    )
    wanted = [c for c in (*NUMERIC, *CATEGORICAL, *CARRIED, LABEL) if c not in person.columns]
    rows = with_tenure(star["Fact_HR"], as_of).where("EmployeeKey <> -1")
    rows = rows.select(ROW_KEY, "EmployeeKey", *wanted)
    joined = lookup(rows, person.where("_person <> -1"), [("EmployeeKey", "_person")], "inner")
    return joined.select(
        ROW_KEY,
        *[F.col(c).cast("double").alias(c) for c in NUMERIC],
        *CATEGORICAL,
        LABEL,
        *CARRIED,
    )


def impute(
    df: DataFrame,
    medians: Sequence[str] = MEDIAN_COLUMNS,
    constants: Mapping[str, object] = CONSTANTS,
) -> DataFrame:
    """Fill gaps with exact medians and constants.

    The medians come from one scalar aggregation; its state is a count per distinct value, and ages
    and tenures have few of those.
    """
    middle = medians and df.agg(*[F.median(F.col(c).cast("double")).alias(c) for c in medians])

    def filled(name: str) -> Column:
        if name in medians:
            return F.coalesce(F.col(name).cast("double"), middle.select(name).scalar())
        if name in constants:
            return F.coalesce(F.col(name), F.lit(constants[name]))
        return F.col(name)

    return df.select(*[filled(name).alias(name) for name in df.columns])


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels per column from one distinct pass; a handful of names reaches the driver."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("level")) for c in columns])
    bound = MAX_LEVELS * len(columns)
    found = (
        df.select(F.inline(pairs)).where("level is not null").distinct().limit(bound + 1).collect()
    )
    levels = {c: sorted(row["level"] for row in found if row["c"] == c) for c in columns}
    too_many = [c for c in columns if len(levels[c]) > MAX_LEVELS]
    if too_many or len(found) > bound:
        raise ValueError(f"too many levels to encode: {too_many or list(columns)}")
    return levels


def one_hot_names(levels: Mapping[str, Sequence[str]]) -> list[str]:
    return [f"{c}_{level}" for c, found in levels.items() for level in found[1:]]


def one_hot(df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None):
    """0/1 columns per level except the alphabetically first; a missing value is all zeros."""
    levels = levels or category_levels(df, columns)
    flags = [
        F.coalesce((F.col(c) == level).cast("int"), F.lit(0)).alias(f"{c}_{level}")
        for c in columns
        for level in levels[c][1:]
    ]
    return df.select(*[c for c in df.columns if c not in columns], *flags)


def stratified_split(
    df: DataFrame, label: str = LABEL, key: str = ROW_KEY, fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Mark the ``fraction`` of each class with the smallest key hashes as ``is_test``, exactly.

    The hash that ends the test share of a class is found in two narrowing steps: counts per hash
    prefix give the prefix in which the share ends, and only rows of that one prefix are ranked.
    One limit per class then marks all rows in place, so the data itself is never sorted or moved.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    hashed = df.select(F.col(label).alias("_class"), digest.alias("_hash"), F.col(key).alias("_id"))
    hashed = hashed.withColumn("_prefix", F.substring("_hash", 1, SPLIT_DIGITS))
    sizes = hashed.groupBy("_class", "_prefix").agg(F.count(F.lit(1)).alias("_size"))

    # At most 16**SPLIT_DIGITS prefixes per class bound both windows.
    whole = Window.partitionBy("_class")
    so_far = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sizes.select(
        "_class",
        "_prefix",
        (F.sum("_size").over(so_far) - F.col("_size")).alias("_before"),
        "_size",
        F.floor(F.sum("_size").over(whole) * fraction + 0.5).alias("_share"),
    ).where("_share > _before and _share <= _before + _size")
    in_prefix = Window.partitionBy("_class").orderBy("_hash", "_id")
    limits = (
        hashed.join(F.broadcast(ends), ["_class", "_prefix"])
        .withColumn("_nth", F.row_number().over(in_prefix))
        .where("_nth = _share - _before")
        .select("_class", F.struct("_hash", "_id").alias("_limit"))
    )
    position = F.struct(digest.alias("_hash"), F.col(key).alias("_id"))
    marked = df.join(F.broadcast(limits), F.col(label) == F.col("_class"), "left")
    marked = marked.withColumn("is_test", F.coalesce(position <= F.col("_limit"), F.lit(False)))
    return marked.drop("_class", "_limit")


def class_weight(train: DataFrame, label: str = LABEL, factor: float = 0.6) -> DataFrame:
    """Weight leavers by ``factor`` times stayers per leaver, from the training rows alone."""
    counts = train.agg(
        F.count_if(F.col(label) == 0).alias("stay"), F.count_if(F.col(label) == 1).alias("leave")
    )
    balance = F.when(F.col("leave") > 0, F.col("stay") / F.col("leave") * factor).otherwise(
        F.raise_error(F.lit("no leavers to train on")).cast("double")
    )
    weight = counts.select(balance.alias("weight")).scalar()
    return train.withColumn("weight", F.when(F.col(label) == 1, weight).otherwise(F.lit(1.0)))


def active_rows(df: DataFrame) -> DataFrame:
    return df.where("EmployeeStatus = 'Active'")

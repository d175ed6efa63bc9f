"""Features and the flight-risk model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.catalog.inputs import star, star_root
from staffmart.catalog.staging_sql import star_cte
from staffmart.operators import features as feat
from staffmart.operators import risk
from staffmart.plans.flight_risk import scored_active
from staffmart.session import fresh_dir, materialise
from staffmart.sources.csv import write_ranked
from staffmart.sources.derived import AS_OF
from staffmart.sources.warehouse import read_star


def filled_features(spark, sf_dir):
    return feat.impute(feat.feature_frame(star(spark, sf_dir), AS_OF))


def feature_impute(spark, sf_dir):
    return filled_features(spark, sf_dir)


def one_hot_levels(spark, sf_dir):
    wide = feat.one_hot(filled_features(spark, sf_dir), feat.CATEGORICAL)
    names = [c for c in wide.columns if any(c.startswith(f"{k}_") for k in feat.CATEGORICAL)]
    return wide.select("FactKey", *[F.col(f"`{c}`").alias(c) for c in names])


def stratified_split(spark, sf_dir):
    marked = feat.stratified_split(filled_features(spark, sf_dir))
    return marked.select("FactKey", "AttritionFlag", "is_test")


def class_weight(spark, sf_dir):
    marked = feat.stratified_split(filled_features(spark, sf_dir))
    weighted = feat.class_weight(marked.where(~F.col("is_test")))
    return weighted.select("FactKey", F.round("weight", 6).alias("weight"))


def rule_predictions(spark, sf_dir):
    """Test rows with a fixed rule in place of a model, so that SQL can repeat the report."""
    marked = feat.stratified_split(filled_features(spark, sf_dir)).where("is_test")
    guess = (F.col("SatisfactionScore") <= 3) | (F.col("TenureDays") < 1500)
    return marked.withColumn("prediction", guess.cast("double"))


def classification_report(spark, sf_dir):
    return risk.classification_report(rule_predictions(spark, sf_dir))


def accuracy(spark, sf_dir):
    found = risk.accuracy(rule_predictions(spark, sf_dir))
    return found.select(F.round("accuracy", 6).alias("accuracy"))


def rule_scored(spark, sf_dir):
    """Active staff with a fixed rule in place of the model's probability, in steps that meet every rounding case."""
    steps = F.col("SatisfactionScore") * 100 + F.pmod(F.col("TenureDays"), F.lit(300.0))
    return feat.active_rows(filled_features(spark, sf_dir)).withColumn("FlightRiskScore", risk.percent(steps / 800))


def risk_rank_by_rule(spark, sf_dir):
    path = fresh_dir(spark, "rule-ranked")
    write_ranked(risk.rank_risk(rule_scored(spark, sf_dir)), path)
    return spark.read.parquet(path)


def risk_top5_by_rule(spark, sf_dir):
    return risk.top_k(rule_scored(spark, sf_dir), 5)


_scored: dict[str, DataFrame] = {}


def scored(spark, sf_dir):
    """Scored active staff of a star: the model is trained once per loaded star, and both the ranked
    list and its head are read from the stored scores."""
    root = star_root(spark, sf_dir)
    if root not in _scored:
        _scored[root] = materialise(scored_active(read_star(spark, root), AS_OF), "scored")
    return _scored[root]


def flight_risk_ranked(spark, sf_dir):
    path = fresh_dir(spark, "ranked")
    write_ranked(risk.rank_risk(scored(spark, sf_dir)), path)
    return spark.read.parquet(path)


def flight_risk_top5(spark, sf_dir):
    return risk.top_k(scored(spark, sf_dir), 5)


QUERIES = {
    "feature_impute": feature_impute,
    "one_hot_levels": one_hot_levels,
    "stratified_split": stratified_split,
    "class_weight": class_weight,
    "accuracy": accuracy,
    "classification_report": classification_report,
    "risk_rank_by_rule": risk_rank_by_rule,
    "risk_top5_by_rule": risk_top5_by_rule,
    "flight_risk_ranked": flight_risk_ranked,
    "flight_risk_top5": flight_risk_top5,
}

FEATURES = f"""{star_cte()},
feature AS (
  SELECT FactKey, CAST(Age AS DOUBLE) AS Age, CAST(TenureDays AS DOUBLE) AS TenureDays,
         CAST(EngagementScore AS DOUBLE) AS EngagementScore,
         CAST(SatisfactionScore AS DOUBLE) AS SatisfactionScore,
         CAST(WorkLifeBalanceScore AS DOUBLE) AS WorkLifeBalanceScore,
         CAST(TrainingCost AS DOUBLE) AS TrainingCost,
         Gender, MaritalStatus, PayZone, PerformanceScore, TrainingOutcome,
         AttritionFlag, EmployeeStatus, FullName, Email
  FROM fact JOIN emp USING (EmployeeKey) WHERE EmployeeKey <> -1),
filled AS (
  SELECT * REPLACE (
    coalesce(Age, (SELECT median(Age) FROM feature)) AS Age,
    coalesce(TenureDays, (SELECT median(TenureDays) FROM feature)) AS TenureDays,
    coalesce(EngagementScore, 3) AS EngagementScore,
    coalesce(SatisfactionScore, 3) AS SatisfactionScore,
    coalesce(WorkLifeBalanceScore, 3) AS WorkLifeBalanceScore,
    coalesce(TrainingCost, 0) AS TrainingCost,
    coalesce(PayZone, 'Unknown') AS PayZone,
    coalesce(PerformanceScore, 'Fully Meets') AS PerformanceScore,
    coalesce(TrainingOutcome, 'None') AS TrainingOutcome)
  FROM feature)"""

SPLIT = f"""{FEATURES},
split AS (
  SELECT *, row_number() OVER (PARTITION BY AttritionFlag
                               ORDER BY md5('42|' || CAST(FactKey AS VARCHAR)), FactKey)
            <= floor(count(*) OVER (PARTITION BY AttritionFlag) * 0.2::DOUBLE + 0.5) AS is_test
  FROM filled)"""

GUESSED = f"""{SPLIT},
guessed AS (
  SELECT AttritionFlag AS y, CASE WHEN SatisfactionScore <= 3 OR TenureDays < 1500 THEN 1 ELSE 0 END AS p
  FROM split WHERE is_test)"""

RULE_RANKED = f"""{FEATURES},
ranked AS (
  SELECT FullName, Email, PayZone, SatisfactionScore, FactKey,
         round_even((SatisfactionScore * 100 + TenureDays % 300) / 800 * 100, 2) AS FlightRiskScore
  FROM filled WHERE EmployeeStatus = 'Active')"""

# Levels that occur in the derived staging, without the first of each column.
LEVELS = {
    "Gender": ("Male",),
    "MaritalStatus": ("Married", "Single"),
    "PayZone": ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    "PerformanceScore": ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    "TrainingOutcome": ("Failed", "None", "Passed"),
}
FLAGS = ",\n       ".join(
    f"CASE WHEN {c} = '{level}' THEN 1 ELSE 0 END AS \"{c}_{level}\""
    for c, levels in LEVELS.items()
    for level in levels
)

ORACLES = {
    "risk_rank_by_rule": f"WITH {RULE_RANKED} SELECT * EXCLUDE (FactKey) FROM ranked",
    "risk_top5_by_rule": f"""
WITH {RULE_RANKED} SELECT * EXCLUDE (FactKey) FROM ranked ORDER BY FlightRiskScore DESC, FactKey LIMIT 5""",
    "feature_impute": f"WITH {FEATURES} SELECT * FROM filled",
    "one_hot_levels": f"WITH {FEATURES} SELECT FactKey, {FLAGS} FROM filled",
    "stratified_split": f"WITH {SPLIT} SELECT FactKey, AttritionFlag, is_test FROM split",
    "class_weight": f"""
WITH {SPLIT},
train AS (SELECT * FROM split WHERE NOT is_test)
SELECT FactKey,
       round(CASE WHEN AttritionFlag = 1 THEN
         (SELECT count(*) FILTER (AttritionFlag = 0) / count(*) FILTER (AttritionFlag = 1) * 0.6::DOUBLE
          FROM train) ELSE 1.0::DOUBLE END, 6) AS weight
FROM train""",
    "accuracy": f"""
WITH {GUESSED} SELECT round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM guessed""",
    "classification_report": f"""
WITH {GUESSED},
classes AS (
  SELECT c, count(*) FILTER (y = c AND p = c) AS hits, count(*) FILTER (p = c) AS guesses,
         count(*) FILTER (y = c) AS support
  FROM guessed, (VALUES (0), (1)) AS v(c) GROUP BY c),
scores AS (
  SELECT c, support, hits, CASE WHEN guesses > 0 THEN hits / guesses ELSE 0::DOUBLE END AS pr,
         CASE WHEN support > 0 THEN hits / support ELSE 0::DOUBLE END AS rc
  FROM classes),
full_scores AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0::DOUBLE END AS f FROM scores)
SELECT CAST(c AS VARCHAR) AS "row", round(pr, 6) AS "precision", round(rc, 6) AS recall, round(f, 6) AS f1,
       support FROM full_scores
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM full_scores
UNION ALL
SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT)
FROM full_scores
UNION ALL
SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6),
       round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM full_scores""",
}

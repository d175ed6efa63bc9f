import pytest
from pyspark.sql import functions as F

from staffmart.operators.features import (
    category_levels,
    class_weight,
    impute,
    one_hot,
    one_hot_names,
    stratified_split,
)
from staffmart.operators.risk import (
    accuracy,
    classification_report,
    fit_risk,
    rank_risk,
    score,
    top_k,
)
from staffmart.plans.flight_risk import evaluate_risk
from staffmart.session import materialise


def test_median_is_exact_and_interpolated(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "Age int")
    assert sorted(r[0] for r in impute(df, ["Age"], {}).collect()) == [1.0, 2.0, 2.5, 3.0, 10.0]


def test_constants_fill_only_their_columns(spark):
    df = spark.createDataFrame([(None, None)], "PayZone string, Gender string")
    assert tuple(impute(df, [], {"PayZone": "Unknown"}).first()) == ("Unknown", None)


def test_missing_category_equals_the_first_level(spark):
    df = spark.createDataFrame([("M", 1), ("F", 2), (None, 3), ("X", 4)], "Gender string, i int")
    wide = one_hot(df, ["Gender"]).orderBy("i")
    assert wide.columns == ["i", "Gender_M", "Gender_X"]
    assert [tuple(r)[1:] for r in wide.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]


def test_too_many_levels_are_refused(spark, monkeypatch):
    monkeypatch.setattr("staffmart.operators.features.MAX_LEVELS", 5)
    with pytest.raises(ValueError, match="too many levels"):
        category_levels(spark.range(6).selectExpr("string(id) a"), ["a"])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 997])
def test_split_keeps_class_shares(spark, n):
    df = spark.range(3 * n).selectExpr("id FactKey", "int(id % 3 = 0) AttritionFlag")
    marked = stratified_split(df)
    assert marked.count() == 3 * n
    found = {r[0]: r[1] for r in marked.groupBy("AttritionFlag").agg(F.count_if("is_test")).collect()}
    assert found == ({0: int(2 * n * 0.2 + 0.5), 1: int(n * 0.2 + 0.5)} if n else {})


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(500).selectExpr("id FactKey", "int(id % 4 = 0) AttritionFlag")
    picks = [
        sorted(r[0] for r in stratified_split(df.repartition(p)).where("is_test").select("FactKey").collect())
        for p in (1, 5)
    ]
    assert picks[0] == picks[1]


def test_class_weight(spark):
    train = spark.range(10).selectExpr("int(id < 2) AttritionFlag")
    found = dict(tuple(r) for r in class_weight(train).distinct().collect())
    assert found == {0: 1.0, 1: pytest.approx(8 / 2 * 0.6)}
    with pytest.raises(Exception, match="no leavers"):
        class_weight(spark.range(3).selectExpr("int(id div 5) AttritionFlag")).collect()


def test_report_against_hand_counts(spark):
    pairs = [(0, 0.0)] * 5 + [(0, 1.0)] * 1 + [(1, 0.0)] * 2 + [(1, 1.0)] * 3
    df = spark.createDataFrame(pairs, "AttritionFlag int, prediction double")
    found = {r["row"]: tuple(r)[1:] for r in classification_report(df).collect()}
    assert found["0"] == (round(5 / 7, 6), round(5 / 6, 6), round(10 / 13, 6), 6)
    assert found["1"] == (0.75, 0.6, round(2 / 3, 6), 5)
    assert found["accuracy"] == (None, None, round(8 / 11, 6), 11)
    assert found["macro avg"][3] == found["weighted avg"][3] == 11
    assert accuracy(df).first()[0] == pytest.approx(8 / 11)


def test_report_without_any_hit(spark):
    df = spark.createDataFrame([(0, 1.0)], "AttritionFlag int, prediction double")
    found = {r["row"]: tuple(r)[1:] for r in classification_report(df).collect()}
    assert found["0"] == (0.0, 0.0, 0.0, 1) and found["1"] == (0.0, 0.0, 0.0, 0)


def test_model_learns_a_planted_signal_and_ranks(spark):
    df = spark.range(600).selectExpr(
        "id FactKey", "double(id % 5) a", "double(id % 7) b", "int(id % 5 < 2) AttritionFlag",
        "concat('n', id) FullName", "'e' Email", "'z' PayZone", "3.0 SatisfactionScore",
    )
    marked = stratified_split(df)
    model = fit_risk(class_weight(marked.where("not is_test")), ["a", "b"], trees=5)
    scored = score(model, marked.where("is_test"))
    assert accuracy(scored).first()[0] > 0.95
    listed = rank_risk(scored).collect()
    risks = [r["FlightRiskScore"] for r in listed]
    assert len(listed) == scored.count() and risks == sorted(risks, reverse=True)
    assert all(0 <= r <= 100 for r in risks)
    assert [r["FullName"] for r in top_k(scored, 5).collect()] == [r["FullName"] for r in listed[:5]]


def test_names_match_columns(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "p string, q string")
    levels = category_levels(df, ["p", "q"])
    assert one_hot_names(levels) == one_hot(df, ["p", "q"], levels).columns == ["p_b", "q_y"]


def test_halves_go_to_even(spark):
    assert spark.range(1).select(F.bround(F.lit(0.00125) * 100, 2)).first()[0] == 0.12


def test_the_trained_model_is_judged_on_its_test_rows(spark):
    rows = [(i, float(i % 7), float(i % 3), int(i % 7 > 4)) for i in range(400)]
    table = spark.createDataFrame(rows, "FactKey long, a double, b double, AttritionFlag int")
    marked = materialise(stratified_split(table), "marked")
    model = fit_risk(class_weight(marked.where("not is_test")), ["a", "b"], trees=2)
    report = {r["row"]: r for r in evaluate_risk(model, marked).collect()}
    assert report["accuracy"]["support"] == marked.where("is_test").count()
    assert report["0"]["support"] + report["1"]["support"] == report["accuracy"]["support"]
    assert report["accuracy"]["f1"] > 0.9

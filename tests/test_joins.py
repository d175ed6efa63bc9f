"""The skew-safe join gives the plain join's rows and leaves no task with the hot key to itself."""

import pytest
from pyspark.sql import functions as F

from staffmart.functions.text import folded
from staffmart.operators.fact import lookup_dims
from staffmart.operators.joins import fits_broadcast, hot_keys, lookup
from staffmart.operators.upsert import upsert, upsert_many
from staffmart.session import materialise

ROWS = 30_000


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the rows under one key, a third under NULL, the rest spread."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 5000)
    left = spark.range(ROWS).select(F.col("id").alias("row"), key.cast("int").alias("k"))
    right = spark.range(0, 6000, 2).select(
        F.col("id").cast("int").alias("r"), (F.col("id") * 10).alias("v")
    )
    return left, right.unionByName(spark.range(1).selectExpr("7 r", "bigint(70) v"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_equals_plain(sides, how):
    left, right = sides
    salted = lookup(left, right, [("k", "r")], how, small=False, rows_per_task=1000)
    plain = left.join(right, left.k == right.r, how).drop("r")
    assert salted.columns == plain.columns
    assert rows(salted) == rows(plain)


def test_hot_key_and_nulls_are_spread(spark, sides):
    left, right = sides
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        joined = lookup(left, right, [("k", "r")], small=False, rows_per_task=1000)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(r["count"] for r in sizes) < ROWS / 3 / 2


def test_salts_follow_the_counts(sides):
    """One scan for several lookups; the two hot keys, NULL one of them, get salts by their rows, no other key any."""
    found = hot_keys(sides[0], {"one": ["k"], "other": ["row"]}, rows_per_task=1000).collect()
    assert sorted((r["lookup"], r["salts"]) for r in found) == [("one", 10), ("one", 11)]


def test_salted_join_under_a_collation(spark):
    """All spellings of a hot key find its row, whatever salt they carry."""
    spellings = ["Head Office", "HEAD OFFICE  ", "head office", "hEAD oFFICE "]
    rows_of = spark.range(4000).select("id", F.element_at(F.array(*map(F.lit, spellings)), (F.col("id") % 4 + 1).cast("int")).alias("k"))
    left = rows_of.withColumn("k", folded(F.col("k")))
    right = spark.createDataFrame([("head OFFICE", 1), ("branch", 2)], "r string, v int").withColumn("r", folded(F.col("r")))
    found = lookup(left, right, [("k", "r")], small=False, rows_per_task=100)
    assert found.where("v = 1").count() == 4000


def test_size_check_never_guesses_small(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    stored = spark.read.parquet(path)
    assert fits_broadcast(stored)
    assert not fits_broadcast(stored, max_bytes=10)
    assert not fits_broadcast(stored.crossJoin(stored.toDF("b")).crossJoin(stored.toDF("c")))


def test_lookup_dims_beyond_the_broadcast_bound(spark):
    dims = {
        "Dim_Employee": spark.sql("select bigint(1) EmployeeKey, 10 EmployeeID union all select -1, -1"),
        "Dim_Job": spark.sql(
            "select bigint(1) JobKey, 'T' Title, 'D' Department union all select 2, 'T', null"
        ),
        "Dim_Location": spark.sql("select bigint(4) LocationKey, 3 LocationCode"),
        "Dim_Training": spark.sql("select bigint(5) TrainingKey, 'P' ProgramName, 'R' TrainerName"),
    }
    staged = spark.createDataFrame(
        [(10, "T", "D", 3, "P", "R"), (11, "T", None, None, "P", None), (None, None, "D", 9, None, "R")],
        "EmployeeID int, Title string, DepartmentType string, LocationCode int, "
        "Training_Program_Name string, Trainer string",
    )
    found = lookup_dims(staged, dims, small=dict.fromkeys(dims, False))
    keys = ("EmployeeID", "EmployeeKey", "JobKey", "LocationKey", "TrainingKey")
    assert rows(found.select(*keys)) == sorted(
        [(10, 1, 1, 4, 5), (11, None, None, None, None), (None, None, None, None, None)], key=str
    )


def test_upsert_against_a_plain_merge(spark):
    target = spark.createDataFrame(
        [(1, 1, "a", "x"), (2, 2, "b", "y"), (3, None, "c", "z")], "key long, id int, u string, f string"
    )
    source = spark.createDataFrame([(1, None, "new"), (9, "n", "n"), (None, "m", "m")], "id int, u string, f string")
    found = upsert(target, source, ["id"], "key", ["u"])
    old = {(1, 1, None, "x"), (2, 2, "b", "y"), (3, None, "c", "z")}
    got = {tuple(r) for r in found.collect()}
    assert old < got
    assert {r[1:] for r in got - old} == {(9, "n", "n"), (None, "m", "m")}
    assert {r[0] for r in got - old} == {4, 5}


@pytest.mark.parametrize("small", [True, False])
def test_one_source_row_updates_many_targets(spark, small):
    target = spark.range(100).selectExpr("id row", "if(id < 90, 1, int(id)) k", "'old' v")
    source = spark.createDataFrame([(1, "new"), (500, "p"), (500, "q"), (None, "r")], "k int, v string")
    found = upsert_many(target, source, "k", ["v"], small=small)
    assert {(r["v"], r["count"]) for r in found.groupBy("v").count().collect()} == {("new", 90), ("old", 10)}


def test_rows_that_files_hold_compressed_are_not_taken_for_few(spark):
    """Half a million equal texts take a few kilobytes of files and many megabytes as rows."""
    stored = materialise(spark.range(600_000).select("id", F.lit("the same text").alias("name")), "compressed")
    assert not fits_broadcast(stored) and fits_broadcast(stored.where("id < 5")) and fits_broadcast(stored.limit(5))
    found = lookup(spark.range(5).withColumnRenamed("id", "k"), stored, [("k", "id")])
    assert "BroadcastHashJoin [k" not in found._jdf.queryExecution().sparkPlan().toString().replace("BroadcastHashJoin [_hash", "")
    assert sorted(r["name"] for r in found.collect()) == ["the same text"] * 5

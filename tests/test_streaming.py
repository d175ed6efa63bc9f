import datetime as dt

import pytest

from pyspark.sql import functions as F

from staffmart.plans.star import load_star
from staffmart.schema import STAR_TABLES
from staffmart.session import fresh_dir
from staffmart.sources.warehouse import current_commit, read_star
from staffmart.streaming.incremental import append_new, drop_repeats, load_arrivals


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_arrivals_equal_batches_and_replays_change_nothing(spark, staging, as_of):
    first = staging({"Employee_ID": 1, "EmployeeStatus": "Active"}, {"Title": "T"})
    second = staging({"Employee_ID": 1, "EmployeeStatus": "Left"}, {"Employee_ID": 2})
    arrivals, streamed, batched = (fresh_dir(spark, n) for n in ("arrivals", "streamed", "batched"))
    progress = fresh_dir(spark, "progress")
    for batch in (first, second):
        batch.write.mode("append").parquet(arrivals)
        load_arrivals(spark, arrivals, streamed, progress, as_of)
        load_star(spark, batch, batched, as_of)
    one, other = read_star(spark, streamed), read_star(spark, batched)
    for name in STAR_TABLES:
        assert rows(one[name]) == rows(other[name])
    assert list(current_commit(spark, streamed)["streams"].values()) == [1]
    # nothing new: the same run loads nothing again
    load_arrivals(spark, arrivals, streamed, progress, as_of)
    assert current_commit(spark, streamed)["number"] == 2


def test_another_run_is_never_skipped(spark, staging, as_of):
    streamed = fresh_dir(spark, "streamed")
    for employee in (1, 2):
        arrivals = fresh_dir(spark, "arrivals")
        staging({"Employee_ID": employee}).write.parquet(arrivals)
        load_arrivals(spark, arrivals, streamed, fresh_dir(spark, "progress"), as_of)
    assert rows(read_star(spark, streamed)["Fact_HR"].select("EmployeeID")) == [(1,), (2,)]


def test_raw_csv_arrivals_are_cleaned(spark, as_of):
    arrivals, streamed = fresh_dir(spark, "arrivals"), fresh_dir(spark, "streamed")
    raw = spark.createDataFrame([(" 7 ", "Ann", "05/03/2021")], "`Employee ID` string, FirstName string, StartDate string")
    raw.write.option("header", True).csv(arrivals)
    load_arrivals(spark, arrivals, streamed, fresh_dir(spark, "progress"), as_of, csv_columns=raw.columns)
    fact = read_star(spark, streamed)["Fact_HR"]
    assert rows(fact.select("EmployeeID", "StartDate")) == [(7, dt.date(2021, 3, 5))]


def test_late_unique_rows_are_kept(spark):
    source, sink, progress = (fresh_dir(spark, n) for n in ("in", "out", "progress"))
    schema = "event_id long, ts timestamp"
    for when, ids in ((dt.datetime(2026, 1, 9), [1, 2]), (dt.datetime(2026, 1, 1), [2, 3, 3])):
        spark.createDataFrame([(i, when) for i in ids], schema).write.mode("append").parquet(source)
        append_new(spark.readStream.schema(schema).parquet(source), "event_id", sink, progress)
    found = spark.read.schema(schema).parquet(sink).select("event_id")
    assert rows(found) == [(1,), (2,), (3,)]


def test_repeats_are_dropped_across_batches(spark):
    source, sink, progress = (fresh_dir(spark, n) for n in ("in", "out", "progress"))
    start = dt.datetime(2026, 1, 1)
    schema = "event_id long, ts timestamp"
    for ids in ([1, 2, 2], [2, 3]):
        batch = spark.createDataFrame([(i, start) for i in ids], schema)
        batch.write.mode("append").parquet(source)
        kept = drop_repeats(spark.readStream.schema(schema).parquet(source), "event_id", "ts", "1 hour")
        query = (
            kept.writeStream.format("parquet")
            .option("checkpointLocation", progress)
            .trigger(availableNow=True)
            .start(sink)
        )
        query.awaitTermination()
    found = spark.read.schema(schema).parquet(sink).groupBy("event_id").agg(F.count(F.lit(1)))
    assert rows(found) == [(1, 1), (2, 1), (3, 1)]


def test_a_batch_costs_its_own_keys(spark):
    """State is looked up by key: after many rows a small batch updates few, and the table is not read."""
    source, sink, progress = (fresh_dir(spark, n) for n in ("in", "out", "progress"))
    schema = "event_id long, ts timestamp"
    spark.range(5000).selectExpr("id AS event_id", "timestamp'2026-01-09' AS ts").write.parquet(source)
    append_new(spark.readStream.schema(schema).parquet(source), "event_id", sink, progress)
    spark.createDataFrame([(7, dt.datetime(2020, 1, 1)), (9999, dt.datetime(2020, 1, 1))], schema).write.mode("append").parquet(source)
    batches = append_new(spark.readStream.schema(schema).parquet(source), "event_id", sink, progress)
    state = [op for batch in batches for op in batch["stateOperators"]]
    assert [op["numRowsUpdated"] for op in state if op["numRowsUpdated"]] == [1]
    assert state[-1]["numRowsTotal"] == 5001
    assert [batch["numInputRows"] for batch in batches if batch["numInputRows"]] == [2]
    assert spark.read.parquet(sink).count() == 5001
    with pytest.raises(ValueError, match="another checkpoint"):
        append_new(spark.readStream.schema(schema).parquet(source), "event_id", sink, fresh_dir(spark, "progress"))


def test_a_row_without_a_key_stops_the_stream(spark):
    source, sink, progress = (fresh_dir(spark, n) for n in ("in", "out", "progress"))
    spark.createDataFrame([(None, 1)], "event_id long, v int").write.parquet(source)
    with pytest.raises(Exception, match="row without event_id"):
        append_new(spark.readStream.schema("event_id long, v int").parquet(source), "event_id", sink, progress)

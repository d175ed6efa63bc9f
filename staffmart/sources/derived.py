"""A staging batch derived from order-management tables: one row per customer who ordered.

The first order of the period gives the start and the job, the last one the status and the exit.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffmart.operators.joins import fits_broadcast, lookup
from staffmart.schema import STAGING_SCHEMA
from staffmart.session import materialise

AS_OF = dt.date(2002, 1, 1)
SPLIT = dt.date(1998, 1, 1)
FIRST = dt.date(1900, 1, 1)
LAST = dt.date(2100, 1, 1)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(number: Column, *labels: str | None) -> Column:
    """Label by remainder; a None label is NULL."""
    return F.element_at(
        F.array(*[F.lit(label).cast("string") for label in labels]),
        (number % len(labels) + 1).cast("int"),
    )


def derived_staging(
    spark: SparkSession, sf_dir: str, first: dt.date = FIRST, last: dt.date = LAST
) -> DataFrame:
    """Staging rows from orders dated in [first, last).

    Orders, line items and events collapse per key with map-side minima before they shuffle, so a
    customer, order or user that holds a third of a table stays cheap. Parts and suppliers go
    through ``lookup``, which spreads frequent ones.
    """
    day = F.col("o_orderdate").cast("date")
    order = F.struct(day.alias("day"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    employed = (
        read(spark, sf_dir, "orders")
        .where((day >= F.lit(first)) & (day < F.lit(last)))
        .groupBy("o_custkey")
        .agg(F.min(order).alias("hired"), F.max(order).alias("latest"))
        .withColumn("first_order", F.col("hired.o_orderkey"))
    )
    job_line = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("line"))
        .select("l_orderkey", "line.l_partkey", "line.l_suppkey")
    )
    course = (
        read(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.min(F.struct("ts", "event_id", "event_type", "value")).alias("course"))
    )
    people = read(spark, sf_dir, "customer").join(employed, F.col("c_custkey") == F.col("o_custkey"))
    people = people.join(job_line, F.col("first_order") == F.col("l_orderkey"), "left")
    people = people.join(course, F.col("c_custkey") == F.col("user_id"), "left")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    small_parts, small_suppliers = fits_broadcast(parts), fits_broadcast(suppliers)
    if not (small_parts and small_suppliers):
        people = materialise(people, "people")  # read again for key frequencies
    base = people
    people = lookup(people, parts, [("l_partkey", "p_partkey")], small=small_parts, hot_from=base)
    people = lookup(people, suppliers, [("l_suppkey", "s_suppkey")], small=small_suppliers, hot_from=base)
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    people = lookup(people, nations, [("c_nationkey", "n_nationkey")], hot_from=base)
    people = lookup(people, regions, [("n_regionkey", "r_regionkey")], small=fits_broadcast(nations))

    person, latest = F.col("c_custkey"), F.col("latest.o_orderkey")
    name = F.split(F.col("c_name"), "#")
    named = person % 11 != 0
    status, event = F.col("latest.o_orderstatus"), F.col("course.event_id")
    left = status == "F"
    size = F.col("p_size")
    values = {
        "Employee_ID": person,
        "FirstName": F.when(named, name[0]),
        "LastName": F.when(named, name[1]),
        "StartDate": F.col("hired.day"),
        "ExitDate": F.when(left, F.col("latest.day")),
        "Title": F.col("p_type"),
        "Supervisor": F.col("s_name"),
        "ADEmail": F.concat(F.lower("c_name"), F.lit("@example.com")),
        "BusinessUnit": F.concat(F.lit("BU"), (size % 10).cast("string")),
        "EmployeeStatus": F.when(left, "Terminated").when(status == "O", "Active"),
        "EmployeeType": pick(person, "Full-Time", "Part-Time", "Contract"),
        "PayZone": F.col("c_mktsegment"),
        "TerminationType": F.when(left, pick(latest, "Voluntary", "Involuntary")),
        "DepartmentType": F.when(size <= 45, F.col("p_brand")),
        "Division": F.concat(F.lit("Division "), (size % 4).cast("string")),
        "DOB": F.date_add(F.lit("1960-01-01").cast("date"), (person * 7 % 15000).cast("int")),
        "State": F.col("n_name"),
        "JobFunctionDescription": F.col("p_name"),
        "GenderCode": pick(person, "Female", "Male", None),
        "LocationCode": F.col("c_nationkey"),
        "RaceDesc": pick(person, "A", "B", "C", "D", None),
        "MaritalDesc": pick(person, "Single", "Married", "Divorced", None),
        "Performance_Score": F.col("latest.o_orderpriority"),
        "Current_Employee_Rating": latest % 5 + 1,
        "Survey_Date": F.date_add(F.col("hired.day"), 90),
        "Engagement_Score": F.when(latest % 7 != 0, F.floor(latest / 5) % 5 + 1),
        "Satisfaction_Score": F.when(latest % 9 != 0, F.floor(latest / 25) % 5 + 1),
        "Work_Life_Balance_Score": F.when(latest % 13 != 0, F.floor(latest / 125) % 5 + 1),
        "Training_Date": F.col("course.ts").cast("date"),
        "Training_Program_Name": F.col("course.event_type"),
        "Training_Type": pick(event, "Internal", "External"),
        "Training_Outcome": pick(event, "Completed", "Passed", "Failed", None),
        "Location": F.col("r_name"),
        "Trainer": F.concat(F.lit("T"), (event % 10).cast("string")),
        "Training_Duration_Days": event % 5 + 1,
        "Training_Cost": F.round("course.value", 2),
    }
    return people.select(
        *[
            values.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in STAGING_SCHEMA.fields
        ]
    )

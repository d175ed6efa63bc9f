"""Cleaning, profiling and typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from staffmart.catalog.inputs import batch, raw_people, raw_people_csv
from staffmart.catalog.staging_sql import staging_cte
from staffmart.functions.dates import parse_date_dayfirst
from staffmart.operators.cleaning import cast_to_staging, clean, drop_exact_duplicates, nan_to_null
from staffmart.operators.profile import preview, profile
from staffmart.operators.upsert import ambiguous_matches, collapse_by_key, repeated_keys
from staffmart.session import fresh_dir
from staffmart.sources.csv import read_batch
from staffmart.sources.derived import AS_OF, read
from staffmart.sources.warehouse import write_staging

CLEANED = (
    "Employee_ID", "FirstName", "LastName", "StartDate", "ExitDate", "Title", "DepartmentType",
    "LocationCode", "Satisfaction_Score", "Training_Cost",
)


def csv_roundtrip_clean(spark, sf_dir):
    raw = raw_people_csv(spark, sf_dir)
    return write_staging(clean(raw, AS_OF), fresh_dir(spark, "mart")).select(*CLEANED)


def dedup_exact(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return drop_exact_duplicates(lines.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"))


def dates_dayfirst(spark, sf_dir):
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    month_first = F.when(F.dayofmonth(day) > 12, F.date_format(day, "MM/dd/yyyy"))
    text = (
        F.when(key % 97 == 0, "garbage")
        .when(key % 101 == 0, F.concat(F.date_format(day, "d/M/"), F.lit("2300")))
        .when(key % 64 == 0, F.date_format(day, "yyyyMMdd HHmmss"))
        .when(key % 64 == 32, F.date_format(day, "dMMMyyyy"))
        .when(key % 64 == 1, F.upper(F.date_format(day, "ddMMMyyyy")))
        .when(key % 64 == 33, F.date_format(day, "d 'of' MMMM yyyy"))
        .when(key % 64 == 2, F.concat(F.lit("10:20 "), F.date_format(day, "dd/MM/yyyy")))
        .when(key % 64 == 34, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10")))
        .when(key % 8 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 8 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 8 == 2, F.date_format(day, "d.M.yyyy"))
        .when(key % 8 == 3, F.coalesce(month_first, F.date_format(day, "d/M/yy")))
        .when(key % 8 == 4, F.date_format(day, "dd-MMM-yy"))
        .when(key % 8 == 5, F.date_format(day, "MMMM d, yyyy"))
        .when(key % 8 == 6, F.date_format(day, "yyyyMMdd"))
        .otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:11:12")))
    )
    texts = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("written"))
    return texts.select("o_orderkey", parse_date_dayfirst(F.col("written"), AS_OF).alias("day"))


def csv_messy_files(spark, sf_dir):
    """Customers written as two sets of files with the columns in another order, with quoted line breaks in the names."""
    people = read(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit('\n"second", line'))).otherwise(F.col("c_name"))
    people = people.select("c_custkey", name.alias("c_name"), "c_mktsegment")
    folder = fresh_dir(spark, "messy")
    for odd, columns in enumerate((["c_custkey", "c_name", "c_mktsegment"], ["c_mktsegment", "c_name", "c_custkey"])):
        part = people.where(F.col("c_custkey") % 2 == odd).select(*columns)
        part.write.mode("append").option("header", True).option("escape", '"').csv(folder)
    return read_batch(spark, folder, multiline=True).select("c_custkey", "c_name", "c_mktsegment")


def nan_cleared(spark, sf_dir):
    balance = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return nan_to_null(read(spark, sf_dir, "customer").select("c_custkey", balance.alias("c_acctbal")))


def typed_quarantine(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = read(spark, sf_dir, "orders").select(
        F.when(key % 50 == 0, "abc").otherwise(key.cast("string")).alias("Employee_ID"),
        F.when(key % 70 == 0, "99999999999").otherwise(F.col("o_custkey").cast("string")).alias(
            "LocationCode"
        ),
        F.when(key % 33 == 0, F.repeat(F.lit("x"), 60)).otherwise(F.col("o_orderpriority")).alias("PayZone"),
    )
    good, rejected = cast_to_staging(raw, "quarantine")
    good = good.select(
        *[F.col(c).cast("string").alias(c) for c in raw.columns], F.lit("").alias("reject_reason")
    )
    return good.unionByName(rejected)


def batch_profile(spark, sf_dir):
    raw = raw_people(spark, sf_dir)
    before = profile(raw).withColumn("stage", F.lit("raw"))
    return before.unionByName(profile(clean(raw, AS_OF)).withColumn("stage", F.lit("clean")))


def batch_preview(spark, sf_dir):
    shown = batch(spark, sf_dir, None).select("Employee_ID", "FirstName", "Title", "StartDate")
    return preview(shown, 10, ["Employee_ID"])


def collapse_max(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return collapse_by_key(orders, ["o_custkey"], ["o_orderstatus", "o_orderpriority", "day"])


def unique_check(spark, sf_dir):
    return repeated_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def ambiguous_match_check(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return ambiguous_matches(lines, read(spark, sf_dir, "orders"), "o_orderkey")


QUERIES = {
    "csv_roundtrip_clean": csv_roundtrip_clean,
    "dedup_exact": dedup_exact,
    "dates_dayfirst": dates_dayfirst,
    "csv_messy_files": csv_messy_files,
    "nan_cleared": nan_cleared,
    "typed_quarantine": typed_quarantine,
    "batch_profile": batch_profile,
    "batch_preview": batch_preview,
    "collapse_max": collapse_max,
    "unique_check": unique_check,
    "ambiguous_match_check": ambiguous_match_check,
}

PEOPLE_CTE = """
people AS (
  SELECT c_custkey AS k, c_name, c_mktsegment, c_nationkey, c_acctbal,
         CAST(DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS DATE) AS hired
  FROM customer
),
copies AS (
  SELECT * FROM people UNION ALL SELECT * FROM people WHERE k % 5 = 0
)"""

ORACLES = {
    "csv_roundtrip_clean": f"""
WITH {PEOPLE_CTE}
SELECT CAST(k AS INTEGER) AS Employee_ID, c_name AS FirstName,
       CASE k % 6 WHEN 4 THEN 'NAT' WHEN 5 THEN 'Lee' END AS LastName,
       hired AS StartDate,
       CASE WHEN k % 4 = 1 THEN CAST(hired + 400 AS DATE) END AS ExitDate,
       'Lead, "R&D"' AS Title, c_mktsegment AS DepartmentType,
       CAST(c_nationkey AS INTEGER) AS LocationCode,
       CASE WHEN k % 7 <> 0 THEN CAST(k % 5 + 1 AS INTEGER) END AS Satisfaction_Score,
       CAST(c_acctbal AS DECIMAL(12,2)) AS Training_Cost
FROM copies""",
    "dedup_exact": "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem",
    "dates_dayfirst": """
SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0 AND o_orderkey % 101 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""",
    "csv_messy_files": """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
       c_name || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '"second", line' ELSE '' END AS c_name, c_mktsegment
FROM customer""",
    "nan_cleared": "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal FROM customer",
    "typed_quarantine": """
WITH raw AS (
  SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'abc' ELSE CAST(o_orderkey AS VARCHAR) END AS Employee_ID,
         CASE WHEN o_orderkey % 70 = 0 THEN '99999999999' ELSE CAST(o_custkey AS VARCHAR) END AS LocationCode,
         CASE WHEN o_orderkey % 33 = 0 THEN repeat('x', 60) ELSE o_orderpriority END AS PayZone
  FROM orders)
SELECT Employee_ID, LocationCode, PayZone,
       concat_ws(',', CASE WHEN try_cast(Employee_ID AS INTEGER) IS NULL THEN 'Employee_ID' END,
                 CASE WHEN length(PayZone) > 50 THEN 'PayZone' END,
                 CASE WHEN try_cast(LocationCode AS INTEGER) IS NULL THEN 'LocationCode' END) AS reject_reason
FROM raw""",
    "batch_profile": f"""
WITH {PEOPLE_CTE}
SELECT 'raw' AS stage, count(*) AS row_count, 12 AS column_count,
       count(*) FILTER (k % 4 NOT IN (0, 1)) AS active, count(*) FILTER (k % 4 IN (0, 1)) AS terminated
FROM (SELECT k FROM copies UNION ALL SELECT k FROM people)
UNION ALL
SELECT 'clean', count(*), 11, count(*) FILTER (k % 4 <> 1), count(*) FILTER (k % 4 = 1) FROM copies""",
    "batch_preview": f"""
WITH {staging_cte('s')}
SELECT Employee_ID, FirstName, Title, StartDate FROM s ORDER BY Employee_ID LIMIT 10""",
    "collapse_max": """
SELECT o_custkey, max(o_orderstatus) AS o_orderstatus, max(o_orderpriority) AS o_orderpriority,
       CAST(max(o_orderdate) AS DATE) AS day
FROM orders GROUP BY o_custkey""",
    "unique_check": """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "ambiguous_match_check": """
SELECT l_orderkey AS o_orderkey, count(*) AS copies FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
GROUP BY l_orderkey HAVING count(*) > 1""",
}

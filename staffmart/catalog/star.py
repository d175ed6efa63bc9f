"""Dimensions, fact and workforce measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from staffmart.catalog.inputs import TWO_BATCHES, batch, raw_people, star, star_root
from staffmart.catalog.staging_sql import AS_OF_SQL, FACT_COLUMNS, SPLIT_SQL, numbered, staging_cte, star_cte, two_batch_cte
from staffmart.operators import kpi
from staffmart.operators.fact import with_tenure
from staffmart.operators.joins import lookup
from staffmart.operators.keys import allocate_keys
from staffmart.plans.adhoc import run_sql
from staffmart.plans.star import load_report, load_star
from staffmart.session import fresh_dir
from staffmart.sources.derived import AS_OF, read
from staffmart.sources.warehouse import read_table, write_staging
from staffmart.streaming.incremental import load_arrivals


def dim_upsert_update(spark, sf_dir):
    return star(spark, sf_dir, TWO_BATCHES)["Dim_Employee"]


def dim_upsert_insert_only(spark, sf_dir):
    found = star(spark, sf_dir, TWO_BATCHES)
    places = found["Dim_Location"].select(
        F.lit("location").alias("dim"),
        F.col("LocationKey").alias("member"),
        F.col("LocationCode").cast("string").alias("code"),
        F.col("State").alias("first_attribute"),
        F.col("City").alias("second_attribute"),
    )
    courses = found["Dim_Training"].select(
        F.lit("training").alias("dim"),
        F.col("TrainingKey").alias("member"),
        F.col("ProgramName").alias("code"),
        F.col("TrainerName").alias("first_attribute"),
        F.col("TrainingType").alias("second_attribute"),
    )
    return places.unionByName(courses)


def dim_null_composite(spark, sf_dir):
    return star(spark, sf_dir, TWO_BATCHES)["Dim_Job"]


def fact_lookup(spark, sf_dir):
    keys = ("EmployeeID", "EmployeeKey", "JobKey", "LocationKey", "TrainingKey", "AttritionFlag")
    return star(spark, sf_dir)["Fact_HR"].select("FactKey", *keys)


def two_batch_columns(fact):
    tenure = with_tenure(fact, AS_OF)
    return tenure.select(
        "FactKey", *FACT_COLUMNS, "TenureDays", F.col("LastUpdateDate").cast("date").alias("LastUpdateDate")
    )


def fact_upsert_two_batches(spark, sf_dir):
    return two_batch_columns(star(spark, sf_dir, TWO_BATCHES)["Fact_HR"])


def fact_upsert_shuffled(spark, sf_dir):
    """The two batches as if nothing could be broadcast or numbered in one task: bucketed keys, salted lookups, tables in parts."""
    root = fresh_dir(spark, "star")
    for which in TWO_BATCHES:
        staging = write_staging(batch(spark, sf_dir, which), root)
        share = max(1, staging.count() // 8)
        star_rows = load_star(spark, staging, root, AS_OF, small=False, rows_per_task=share, rows_per_part=share)
    return two_batch_columns(star_rows["Fact_HR"])


def lookup_skewed(spark, sf_dir):
    """Order lines and their suppliers, the first line of every order under one supplier and the second under none."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    first = F.when(F.col("l_linenumber") == 1, F.lit(1)).when(F.col("l_linenumber") != 2, F.col("l_suppkey"))
    lines = lines.withColumn("l_suppkey", first.cast("long"))
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    share = max(1, lines.count() // 64)
    return lookup(lines, suppliers, [("l_suppkey", "s_suppkey")], small=False, rows_per_task=share)


def keys_bucketed(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return allocate_keys(customers, "member", ("c_mktsegment", "c_custkey"), small=False)


def spelled(col, kind):
    """A text in one of several spellings that a case-insensitive key takes for the same."""
    return F.when(kind % 3 == 0, F.upper(col)).when(kind % 3 == 1, F.concat(F.lower(col), F.lit("  "))).otherwise(col)


def dim_collated_keys(spark, sf_dir):
    """Jobs and flags of all facts after two batches whose titles, departments and statuses are spelled in several ways."""
    root = fresh_dir(spark, "star")
    for which in TWO_BATCHES:
        rows, person = batch(spark, sf_dir, which), F.col("Employee_ID")
        rows = rows.withColumns({
            "Title": spelled(F.col("Title"), person),
            "DepartmentType": spelled(F.col("DepartmentType"), F.floor(person / 3)),
            "EmployeeStatus": spelled(F.col("EmployeeStatus"), F.floor(person / 9)),
        })
        found = load_star(spark, write_staging(rows, root), root, AS_OF, fold_case=True)
    jobs = found["Dim_Job"].select("JobKey", "Title", "Department")
    return found["Fact_HR"].join(jobs, "JobKey").select("EmployeeID", "Title", "Department", "AttritionFlag")


def quarantined_load(spark, sf_dir):
    """A load of the untidy extract with values that don't fit: its report, and its rejected rows by fault."""
    root = fresh_dir(spark, "star")
    raw, key = raw_people(spark, sf_dir), F.col("`Employee ID`").cast("double").cast("long")
    raw = raw.withColumns({
        "LocationCode": F.when(key % 9 == 0, "west").otherwise(F.col("LocationCode")),
        "Satisfaction Score": F.when(key % 10 == 3, "99999999999").otherwise(F.col("`Satisfaction Score`")),
    })
    report = load_report(spark, raw, root, AS_OF, rejects=f"{root}-rejects").where("success")
    counts = report.select(F.explode(F.create_map(*[x for c in ("records", "active", "terminated", "rejected") for x in (F.lit(c), F.col(c))])))
    loaded = read_table(spark, root, "Fact_HR").agg(F.count(F.lit(1)).alias("value")).select(F.lit("facts").alias("key"), "value")
    faults = spark.read.parquet(f"{root}-rejects").groupBy(F.col("reject_reason").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    found = counts.unionByName(loaded).unionByName(faults)
    return found.select(F.col("key").alias("what"), F.col("value").alias("n"))


def incremental_equals_batch(spark, sf_dir):
    arrivals, root = fresh_dir(spark, "arrivals"), fresh_dir(spark, "star")
    checkpoint = fresh_dir(spark, "progress")
    for which in TWO_BATCHES:
        batch(spark, sf_dir, which).write.mode("append").parquet(arrivals)
        load_arrivals(spark, arrivals, root, checkpoint, AS_OF)
    return two_batch_columns(read_table(spark, root, "Fact_HR"))


def star_load_report(spark, sf_dir):
    return load_report(spark, raw_people(spark, sf_dir), fresh_dir(spark, "star"), AS_OF)


def star_kpi_by_department(spark, sf_dir):
    return kpi.kpi_by(star(spark, sf_dir), "Dim_Job", "Department", AS_OF)


def training_cost_by_department(spark, sf_dir):
    return kpi.measure_by(star(spark, sf_dir), "TrainingCost", "Dim_Job", "Department").withColumn(
        "total_TrainingCost", F.col("total_TrainingCost").cast("decimal(28,2)")
    )


def headcount_by_state(spark, sf_dir):
    return kpi.headcount(star(spark, sf_dir), "Dim_Location", "State")


def avg_tenure_by_gender(spark, sf_dir):
    return kpi.avg_tenure(star(spark, sf_dir), "Dim_Employee", "Gender", AS_OF)


def turnover_by_year(spark, sf_dir):
    return kpi.turnover(star(spark, sf_dir)["Fact_HR"], AS_OF, "year")


def turnover_by_department_quarter(spark, sf_dir):
    return kpi.turnover_by(star(spark, sf_dir), "Dim_Job", ["Department"], AS_OF, "quarter")


def time_intelligence_by_priority(spark, sf_dir):
    """Per order priority, none of them known in every third month of the calendar."""
    orders = read(spark, sf_dir, "orders").where(F.month("o_orderdate") % 3 != 0)
    priority = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority")
    orders = orders.select(priority, "o_orderdate", F.round("o_totalprice", 2).cast("decimal(18,2)").alias("price"))
    return kpi.time_intelligence(orders, "o_orderdate", F.col("price"), ["priority"]).select(
        "priority",
        "month",
        *[F.col(c).cast("decimal(28,2)").alias(c) for c in ("total", "running_total", "previous_month", "year_to_date")],
    )


def time_intelligence(spark, sf_dir):
    """February and July orders lie in no report, so every year has months without rows."""
    orders = read(spark, sf_dir, "orders").where(~F.month("o_orderdate").isin(2, 7))
    return kpi.time_intelligence(orders, "o_orderdate", F.round("o_totalprice", 2).cast("decimal(18,2)")).select(
        "month",
        *[
            F.col(c).cast("decimal(28,2)").alias(c)
            for c in ("total", "running_total", "previous_month", "year_to_date")
        ],
    )


def hires_by_calendar_month(spark, sf_dir):
    """Hires per month of the calendar table, months without hires included."""
    fact = star(spark, sf_dir)["Fact_HR"]
    hires = fact.groupBy(F.col("StartDate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    span = fact.agg(F.min("StartDate").alias("a"), F.max("StartDate").alias("b")).first()
    calendar = kpi.dim_date(spark, span["a"], span["b"])
    joined = calendar.join(hires, "date", "left")
    return joined.groupBy("year", "quarter", "month").agg(
        F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("n"), F.lit(0)).alias("hires")
    )


def attrition_drivers(spark, sf_dir):
    return kpi.attrition_drivers(star(spark, sf_dir)["Fact_HR"], AS_OF)


def distribution_share(spark, sf_dir):
    return kpi.distribution(star(spark, sf_dir), "Dim_Job", "BusinessUnit")


def training_effect(spark, sf_dir):
    return kpi.training_effect(star(spark, sf_dir), AS_OF)


def kpi_rollup(spark, sf_dir):
    return kpi.kpi_rollup(star(spark, sf_dir), "Department", "BusinessUnit")


GOVERNED = """
SELECT l.State, t.ProgramName, COUNT(*) AS people, MAX(f.TenureDays) AS longest_tenure
FROM Fact_HR f
JOIN Dim_Location l ON f.LocationKey = l.LocationKey
JOIN Dim_Training t ON f.TrainingKey = t.TrainingKey
JOIN Dim_Employee e ON f.EmployeeKey = e.EmployeeKey
JOIN Dim_Job j ON f.JobKey = j.JobKey
WHERE e.Age >= 20 AND j.Title <> 'MEDIUM'
GROUP BY l.State, t.ProgramName;
"""


def governed_sql(spark, sf_dir):
    return run_sql(spark, GOVERNED, star_root(spark, sf_dir), AS_OF)


QUERIES = {
    "star_kpi_by_department": star_kpi_by_department,
    "dim_upsert_update": dim_upsert_update,
    "dim_upsert_insert_only": dim_upsert_insert_only,
    "dim_null_composite": dim_null_composite,
    "fact_lookup": fact_lookup,
    "fact_upsert_two_batches": fact_upsert_two_batches,
    "fact_upsert_shuffled": fact_upsert_shuffled,
    "lookup_skewed": lookup_skewed,
    "keys_bucketed": keys_bucketed,
    "dim_collated_keys": dim_collated_keys,
    "quarantined_load": quarantined_load,
    "incremental_equals_batch": incremental_equals_batch,
    "star_load_report": star_load_report,
    "training_cost_by_department": training_cost_by_department,
    "headcount_by_state": headcount_by_state,
    "avg_tenure_by_gender": avg_tenure_by_gender,
    "turnover_by_year": turnover_by_year,
    "turnover_by_department_quarter": turnover_by_department_quarter,
    "time_intelligence": time_intelligence,
    "time_intelligence_by_priority": time_intelligence_by_priority,
    "hires_by_calendar_month": hires_by_calendar_month,
    "attrition_drivers": attrition_drivers,
    "distribution_share": distribution_share,
    "training_effect": training_effect,
    "kpi_rollup": kpi_rollup,
    "governed_sql": governed_sql,
}

STAR = star_cte()
TWO = two_batch_cte()
TWO_BATCH_FACT = f"""
WITH {TWO}
SELECT FactKey, {', '.join(FACT_COLUMNS)},
       CAST(date_diff('day', StartDate, coalesce(ExitDate, {AS_OF_SQL})) AS INTEGER) AS TenureDays,
       {AS_OF_SQL} AS LastUpdateDate
FROM fact2"""

def spelled_sql(col, kind):
    return f"CASE WHEN {kind} % 3 = 0 THEN upper({col}) WHEN {kind} % 3 = 1 THEN lower({col}) || '  ' ELSE {col} END"


SPELLED = ",".join(
    f"""{staging_cte(f"s{n}", period)},
d{n} AS (
  SELECT Employee_ID, {spelled_sql("Title", "Employee_ID")} AS Title,
         {spelled_sql("DepartmentType", "(Employee_ID // 3)")} AS Department, {spelled_sql("EmployeeStatus", "(Employee_ID // 9)")} AS Status
  FROM s{n}),
folded{n} AS (
  SELECT lower(rtrim(Title)) AS t, lower(rtrim(Department)) AS d, min(Title) AS Title, min(Department) AS Department
  FROM d{n} WHERE Title IS NOT NULL GROUP BY ALL)"""
    for n, period in ((1, f"day < {SPLIT_SQL}"), (2, f"day >= {SPLIT_SQL}"))
)

ORACLES = {
    "star_kpi_by_department": f"""
WITH {STAR}
SELECT Department, count(*) AS employees, count(*) FILTER (AttritionFlag = 0) AS headcount,
       round(avg(CAST(AttritionFlag AS DOUBLE)), 6) AS attrition_rate,
       round(avg(TenureDays), 6) AS avg_tenure_days,
       CAST(sum(TrainingCost) AS DECIMAL(28,2)) AS training_cost
FROM fact JOIN job USING (JobKey) GROUP BY Department""",
    "dim_upsert_update": f"""
WITH {TWO}
SELECT EmployeeKey, EmployeeID, FullName, Age, Gender, Race, MaritalStatus, Supervisor, Email FROM emp2""",
    "dim_upsert_insert_only": f"""
WITH {TWO}
SELECT 'location' AS dim, LocationKey AS member, CAST(LocationCode AS VARCHAR) AS code,
       State AS first_attribute, City AS second_attribute FROM loc2
UNION ALL
SELECT 'training', TrainingKey, ProgramName, TrainerName, TrainingType FROM trn2""",
    "dim_null_composite": f"""
WITH {TWO}
SELECT JobKey, Title, Department, BusinessUnit, Division, JobFunctionDescription FROM job2""",
    "fact_lookup": f"""
WITH {STAR}
SELECT FactKey, EmployeeID, EmployeeKey, JobKey, LocationKey, TrainingKey, AttritionFlag FROM fact""",
    "fact_upsert_two_batches": TWO_BATCH_FACT,
    "fact_upsert_shuffled": TWO_BATCH_FACT,
    "lookup_skewed": """
SELECT l_orderkey, l_linenumber, k AS l_suppkey, s_name
FROM (SELECT *, CAST(CASE WHEN l_linenumber = 1 THEN 1 WHEN l_linenumber <> 2 THEN l_suppkey END AS BIGINT) AS k FROM lineitem)
LEFT JOIN supplier ON s_suppkey = k""",
    "keys_bucketed": f"SELECT c_custkey, c_mktsegment, {numbered('member', ('c_mktsegment', 'c_custkey'))} FROM customer",
    "dim_collated_keys": f"""
WITH {SPELLED},
jobs AS (
  SELECT * FROM folded1
  UNION ALL
  SELECT * FROM folded2 s WHERE NOT EXISTS (SELECT 1 FROM folded1 f WHERE f.t = s.t AND f.d = s.d)),
first_batch AS (
  SELECT Employee_ID, f.Title, f.Department, Status FROM d1 LEFT JOIN folded1 f ON f.t = lower(rtrim(d1.Title)) AND f.d = lower(rtrim(d1.Department))),
later AS (
  SELECT Employee_ID, j.Title, j.Department, Status FROM d2 LEFT JOIN jobs j ON j.t = lower(rtrim(d2.Title)) AND j.d = lower(rtrim(d2.Department))),
facts AS (
  SELECT f.Employee_ID, f.Title, f.Department, CASE WHEN l.Employee_ID IS NULL THEN f.Status ELSE l.Status END AS Status
  FROM first_batch f LEFT JOIN later l USING (Employee_ID)
  UNION ALL SELECT * FROM later WHERE Employee_ID NOT IN (SELECT Employee_ID FROM first_batch))
SELECT Employee_ID AS EmployeeID, coalesce(Title, 'Unknown Title') AS Title, coalesce(Department, 'Unknown Dept') AS Department,
       CASE WHEN lower(rtrim(Status)) = 'active' THEN 0 ELSE 1 END AS AttritionFlag
FROM facts""",
    "quarantined_load": """
WITH cleaned AS (
  SELECT c_custkey AS k, concat_ws(',', CASE WHEN c_custkey % 9 = 0 THEN 'LocationCode' END,
           CASE WHEN c_custkey % 10 = 3 THEN 'Satisfaction_Score' END) AS reason FROM customer
  UNION ALL SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 9 = 0 THEN 'LocationCode' END,
           CASE WHEN c_custkey % 10 = 3 THEN 'Satisfaction_Score' END) FROM customer WHERE c_custkey % 5 = 0)
SELECT 'records' AS what, count(*) FILTER (reason = '') AS n FROM cleaned
UNION ALL SELECT 'facts', count(*) FILTER (reason = '') FROM cleaned
UNION ALL SELECT 'active', count(*) FILTER (reason = '' AND k % 4 <> 1) FROM cleaned
UNION ALL SELECT 'terminated', count(*) FILTER (reason = '' AND k % 4 = 1) FROM cleaned
UNION ALL SELECT 'rejected', count(*) FILTER (reason <> '') FROM cleaned
UNION ALL SELECT reason, count(*) FROM cleaned WHERE reason <> '' GROUP BY reason""",
    "incremental_equals_batch": TWO_BATCH_FACT,
    "star_load_report": """
WITH n AS (
  SELECT count(*) + count(*) FILTER (c_custkey % 5 = 0) AS records,
         count(*) FILTER (c_custkey % 4 <> 1) + count(*) FILTER (c_custkey % 4 <> 1 AND c_custkey % 5 = 0)
           AS active
  FROM customer)
SELECT TRUE AS success,
       'loaded ' || records || ' records (' || active || ' active, ' || (records - active)
         || ' terminated)' AS message,
       records, active, records - active AS terminated
FROM n""",
    "training_cost_by_department": f"""
WITH {STAR}
SELECT Department, CAST(sum(TrainingCost) AS DECIMAL(28,2)) AS "total_TrainingCost"
FROM fact JOIN job USING (JobKey) GROUP BY Department""",
    "headcount_by_state": f"""
WITH {STAR}
SELECT State, count(*) FILTER (AttritionFlag = 0) AS headcount
FROM fact JOIN loc USING (LocationKey) GROUP BY State""",
    "avg_tenure_by_gender": f"""
WITH {STAR}
SELECT Gender, round(avg(TenureDays), 6) AS avg_tenure_days
FROM fact JOIN emp USING (EmployeeKey) GROUP BY Gender""",
    "turnover_by_year": f"""
WITH {STAR},
periods AS (
  SELECT CAST(p AS DATE) AS period, CAST(p + INTERVAL 1 YEAR AS DATE) AS next_period
  FROM (SELECT unnest(generate_series(
          (SELECT date_trunc('year', least(min(StartDate), min(ExitDate))) FROM fact),
          date_trunc('year', {AS_OF_SQL}), INTERVAL 1 YEAR)) AS p)),
counts AS (
  SELECT period,
         count(*) FILTER (StartDate < period AND (ExitDate IS NULL OR ExitDate >= period)) AS opening,
         count(*) FILTER (StartDate < next_period AND (ExitDate IS NULL OR ExitDate >= next_period)) AS closing,
         count(*) FILTER (ExitDate >= period AND ExitDate < next_period) AS exits
  FROM periods CROSS JOIN fact GROUP BY period)
SELECT period, opening, closing, exits,
       round(CASE WHEN opening + closing <> 0 THEN exits / ((opening + closing) / 2) END, 6) AS turnover_rate
FROM counts""",
    "turnover_by_department_quarter": f"""
WITH {STAR},
people AS (SELECT Department, StartDate, ExitDate FROM fact JOIN job USING (JobKey)),
periods AS (
  SELECT Department, CAST(p AS DATE) AS period, CAST(p + INTERVAL 3 MONTH AS DATE) AS next_period
  FROM (SELECT Department, unnest(generate_series(date_trunc('quarter', least(min(StartDate), min(ExitDate))),
          date_trunc('quarter', {AS_OF_SQL}), INTERVAL 3 MONTH)) AS p FROM people GROUP BY Department)),
counts AS (
  SELECT p.Department, period,
         count(*) FILTER (StartDate < period AND (ExitDate IS NULL OR ExitDate >= period)) AS opening,
         count(*) FILTER (StartDate < next_period AND (ExitDate IS NULL OR ExitDate >= next_period)) AS closing,
         count(*) FILTER (ExitDate >= period AND ExitDate < next_period) AS exits
  FROM periods p JOIN people f ON f.Department IS NOT DISTINCT FROM p.Department GROUP BY ALL)
SELECT Department, period, opening, closing, exits,
       round(CASE WHEN opening + closing <> 0 THEN exits / ((opening + closing) / 2) END, 6) AS turnover_rate
FROM counts""",
    "time_intelligence_by_priority": """
WITH days AS (
  SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority, date_trunc('month', CAST(o_orderdate AS DATE)) AS month,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders WHERE month(o_orderdate) % 3 <> 0),
calendar AS (
  SELECT priority, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM days GROUP BY priority),
monthly AS (
  SELECT c.priority, c.month, coalesce(sum(price), 0) AS total
  FROM calendar c LEFT JOIN days d ON d.month = c.month AND d.priority IS NOT DISTINCT FROM c.priority GROUP BY ALL)
SELECT priority, month, CAST(total AS DECIMAL(28,2)) AS total,
       CAST(sum(total) OVER (PARTITION BY priority ORDER BY month) AS DECIMAL(28,2)) AS running_total,
       CAST(lag(total) OVER (PARTITION BY priority ORDER BY month) AS DECIMAL(28,2)) AS previous_month,
       CAST(sum(total) OVER (PARTITION BY priority, year(month) ORDER BY month) AS DECIMAL(28,2)) AS year_to_date
FROM monthly""",
    "time_intelligence": """
WITH days AS (
  SELECT CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders
  WHERE month(o_orderdate) NOT IN (2, 7)),
monthly AS (
  SELECT CAST(m AS DATE) AS month, coalesce((SELECT sum(price) FROM days WHERE date_trunc('month', day) = m), 0) AS total
  FROM (SELECT unnest(generate_series(min(date_trunc('month', day)), max(date_trunc('month', day)), INTERVAL 1 MONTH)) AS m
        FROM days))
SELECT month, CAST(total AS DECIMAL(28,2)) AS total,
       CAST(sum(total) OVER (ORDER BY month) AS DECIMAL(28,2)) AS running_total,
       CAST(lag(total) OVER (ORDER BY month) AS DECIMAL(28,2)) AS previous_month,
       CAST(sum(total) OVER (PARTITION BY year(month) ORDER BY month) AS DECIMAL(28,2)) AS year_to_date
FROM monthly""",
    "hires_by_calendar_month": f"""
WITH {STAR},
calendar AS (
  SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(
    (SELECT min(StartDate) FROM fact), (SELECT max(StartDate) FROM fact), INTERVAL 1 DAY)) AS d))
SELECT CAST(year(day) AS INTEGER) AS year, CAST(quarter(day) AS INTEGER) AS quarter,
       CAST(month(day) AS INTEGER) AS month, count(DISTINCT day) AS days, count(FactKey) AS hires
FROM calendar LEFT JOIN fact ON StartDate = day GROUP BY 1, 2, 3""",
    "attrition_drivers": f"""
WITH {STAR}
SELECT PayZone,
       CASE WHEN TenureDays < 365 THEN '<1y' WHEN TenureDays < 1095 THEN '1-3y'
            WHEN TenureDays < 1825 THEN '3-5y' WHEN TenureDays IS NOT NULL THEN '5y+' END AS tenure_band,
       count(*) AS employees, CAST(sum(AttritionFlag) AS BIGINT) AS leavers,
       round(avg(CAST(AttritionFlag AS DOUBLE)), 6) AS attrition_rate
FROM fact GROUP BY 1, 2""",
    "distribution_share": f"""
WITH {STAR}
SELECT BusinessUnit, count(*) AS employees,
       round(count(*) / (SELECT count(*) FROM fact), 6) AS share
FROM fact JOIN job USING (JobKey) GROUP BY BusinessUnit""",
    "training_effect": f"""
WITH {STAR}
SELECT ProgramName, count(*) AS employees, round(avg(TenureDays), 6) AS avg_tenure_days,
       round(avg(TenureDays) - (SELECT avg(TenureDays) FROM fact), 6) AS tenure_difference
FROM fact JOIN trn USING (TrainingKey) GROUP BY ProgramName""",
    "kpi_rollup": f"""
WITH {STAR}
SELECT Department, BusinessUnit, CAST(GROUPING(Department) * 2 + GROUPING(BusinessUnit) AS INTEGER) AS level,
       count(*) AS employees, CAST(sum(AttritionFlag) AS BIGINT) AS leavers,
       CAST(sum(TrainingCost) AS DECIMAL(28,2)) AS training_cost
FROM fact JOIN job USING (JobKey) GROUP BY ROLLUP (Department, BusinessUnit)""",
    "governed_sql": f"""
WITH {STAR}
SELECT State, ProgramName, count(*) AS people, max(TenureDays) AS longest_tenure
FROM fact JOIN loc USING (LocationKey) JOIN trn USING (TrainingKey)
JOIN emp USING (EmployeeKey) JOIN job USING (JobKey)
WHERE Age >= 20 AND Title <> 'MEDIUM' GROUP BY State, ProgramName""",
}

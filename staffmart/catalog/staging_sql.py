"""DuckDB common table expressions that repeat staging, dimensions and fact.

Surrogate keys have no meaning of their own, so their numbering rule (order of columns, md5 buckets) is shared with the library; everything
else is stated anew.
"""

from __future__ import annotations

from staffmart.operators.fact import FACT_KEY_ORDER

AS_OF_SQL = "DATE '2002-01-01'"
SPLIT_SQL = "DATE '1998-01-01'"


def staging_cte(name: str, period: str = "TRUE") -> str:
    """Staging rows from the orders whose ``day`` satisfies ``period``."""
    return f"""
{name}_orders AS (
  SELECT * FROM (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders) WHERE {period}
),
{name}_hired AS (
  SELECT * FROM {name}_orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) = 1
),
{name}_latest AS (
  SELECT * FROM {name}_orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) = 1
),
{name}_line AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1
),
{name}_course AS (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
),
{name} AS (
  SELECT
    CAST(c_custkey AS INTEGER) AS Employee_ID,
    CASE WHEN c_custkey % 11 <> 0 THEN split_part(c_name, '#', 1) END AS FirstName,
    CASE WHEN c_custkey % 11 <> 0 THEN split_part(c_name, '#', 2) END AS LastName,
    h.day AS StartDate,
    CASE WHEN t.o_orderstatus = 'F' THEN t.day END AS ExitDate,
    p_type AS Title,
    s_name AS Supervisor,
    lower(c_name) || '@example.com' AS ADEmail,
    'BU' || CAST(p_size % 10 AS VARCHAR) AS BusinessUnit,
    CASE t.o_orderstatus WHEN 'F' THEN 'Terminated' WHEN 'O' THEN 'Active' END AS EmployeeStatus,
    ['Full-Time', 'Part-Time', 'Contract'][c_custkey % 3 + 1] AS EmployeeType,
    c_mktsegment AS PayZone,
    CAST(NULL AS VARCHAR) AS EmployeeClassificationType,
    CASE WHEN t.o_orderstatus = 'F'
         THEN ['Voluntary', 'Involuntary'][t.o_orderkey % 2 + 1] END AS TerminationType,
    CAST(NULL AS VARCHAR) AS TerminationDescription,
    CASE WHEN p_size <= 45 THEN p_brand END AS DepartmentType,
    'Division ' || CAST(p_size % 4 AS VARCHAR) AS Division,
    CAST(DATE '1960-01-01' + CAST(c_custkey * 7 % 15000 AS INTEGER) AS DATE) AS DOB,
    n_name AS State,
    p_name AS JobFunctionDescription,
    ['Female', 'Male', NULL][c_custkey % 3 + 1] AS GenderCode,
    CAST(c_nationkey AS INTEGER) AS LocationCode,
    ['A', 'B', 'C', 'D', NULL][c_custkey % 5 + 1] AS RaceDesc,
    ['Single', 'Married', 'Divorced', NULL][c_custkey % 4 + 1] AS MaritalDesc,
    t.o_orderpriority AS Performance_Score,
    CAST(t.o_orderkey % 5 + 1 AS INTEGER) AS Current_Employee_Rating,
    CAST(h.day + 90 AS DATE) AS Survey_Date,
    CASE WHEN t.o_orderkey % 7 <> 0 THEN CAST(t.o_orderkey // 5 % 5 + 1 AS INTEGER) END AS Engagement_Score,
    CASE WHEN t.o_orderkey % 9 <> 0 THEN CAST(t.o_orderkey // 25 % 5 + 1 AS INTEGER) END
      AS Satisfaction_Score,
    CASE WHEN t.o_orderkey % 13 <> 0 THEN CAST(t.o_orderkey // 125 % 5 + 1 AS INTEGER) END
      AS Work_Life_Balance_Score,
    CAST(ts AS DATE) AS Training_Date,
    event_type AS Training_Program_Name,
    ['Internal', 'External'][event_id % 2 + 1] AS Training_Type,
    ['Completed', 'Passed', 'Failed', NULL][event_id % 4 + 1] AS Training_Outcome,
    r_name AS Location,
    'T' || CAST(event_id % 10 AS VARCHAR) AS Trainer,
    CAST(event_id % 5 + 1 AS INTEGER) AS Training_Duration_Days,
    CAST(round(value, 2) AS DECIMAL(12,2)) AS Training_Cost
  FROM customer
  JOIN {name}_hired h ON h.o_custkey = c_custkey
  JOIN {name}_latest t ON t.o_custkey = c_custkey
  LEFT JOIN {name}_line ON l_orderkey = h.o_orderkey
  LEFT JOIN part ON p_partkey = l_partkey
  LEFT JOIN supplier ON s_suppkey = l_suppkey
  LEFT JOIN {name}_course ON user_id = c_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
)"""


def numbered(key: str, order: tuple[str, ...], start: str = "0") -> str:
    """Surrogate key: position by hash bucket, then by the natural key, after ``start``."""
    texts = ", ".join(f"CAST({c} AS VARCHAR)" for c in order)
    columns = ", ".join(f"{c} NULLS FIRST" for c in order)
    return (
        f"{start} + row_number() OVER (ORDER BY substr(md5(concat_ws('|', {texts})), 1, 4), {columns})"
        f" AS {key}"
    )


# Fixed values below: names and order of the star's columns, the unknown members, and the columns a later batch changes.
# Per dimension: surrogate key, natural key, columns with their collapse, unknown member, update list.
EMPLOYEE = (
    "EmployeeKey",
    ("EmployeeID",),
    """SELECT Employee_ID AS EmployeeID,
         coalesce(max(FirstName), '') || ' ' || coalesce(max(LastName), '') AS FullName,
         CAST(2002 - year(max(DOB)) AS INTEGER) AS Age, max(GenderCode) AS Gender, max(RaceDesc) AS Race,
         max(MaritalDesc) AS MaritalStatus, max(Supervisor) AS Supervisor, max(ADEmail) AS Email
       FROM {s} WHERE Employee_ID IS NOT NULL GROUP BY Employee_ID""",
    "SELECT -1, 'Unknown Employee', -1, 'Unknown', 'Unknown', 'Unknown', 'Unknown', 'Unknown', -1",
    ("EmployeeID", "FullName", "Age", "Gender", "Race", "MaritalStatus", "Supervisor", "Email"),
    ("FullName", "Age", "MaritalStatus", "Supervisor", "Email"),
)
JOB = (
    "JobKey",
    ("Title", "Department"),
    """SELECT Title, DepartmentType AS Department, max(BusinessUnit) AS BusinessUnit,
         max(Division) AS Division, max(JobFunctionDescription) AS JobFunctionDescription
       FROM {s} WHERE Title IS NOT NULL GROUP BY Title, DepartmentType""",
    "SELECT 'Unknown Title', 'Unknown Dept', 'Unknown BU', 'Unknown Div', 'Unknown Description', -1",
    ("Title", "Department", "BusinessUnit", "Division", "JobFunctionDescription"),
    ("JobFunctionDescription",),
)
LOCATION = (
    "LocationKey",
    ("LocationCode",),
    """SELECT LocationCode, max(State) AS State, max(Location) AS City
       FROM {s} WHERE LocationCode IS NOT NULL GROUP BY LocationCode""",
    "SELECT -1, 'Unknown State', 'Unknown City', -1",
    ("LocationCode", "State", "City"),
    (),
)
TRAINING = (
    "TrainingKey",
    ("ProgramName", "TrainerName"),
    """SELECT Training_Program_Name AS ProgramName, max(Training_Type) AS TrainingType,
         Trainer AS TrainerName
       FROM {s} WHERE Training_Program_Name IS NOT NULL GROUP BY Training_Program_Name, Trainer""",
    "SELECT 'No Training', 'N/A', 'N/A', -1",
    ("ProgramName", "TrainingType", "TrainerName"),
    (),
)
DIMS = {"emp": EMPLOYEE, "job": JOB, "loc": LOCATION, "trn": TRAINING}


def dim_cte(name: str, dim: tuple, staging: str) -> str:
    """The dimension after a first load from ``staging``."""
    key, natural, collapse, unknown, columns, _ = dim
    return f"""
{name} AS (
  SELECT {', '.join(columns)}, CAST({key} AS BIGINT) AS {key} FROM (
    SELECT {', '.join(columns)}, {numbered(key, natural)} FROM ({collapse.format(s=staging)})
    UNION ALL {unknown})
)"""


def dim_merge_cte(name: str, dim: tuple, target: str, staging: str) -> str:
    """The dimension after merging ``staging`` into ``target``."""
    key, natural, collapse, _, columns, updates = dim
    match = " AND ".join(f"t.{c} = s.{c}" for c in natural)
    merged = ", ".join(
        f"CASE WHEN s.hit THEN s.{c} ELSE t.{c} END AS {c}" if c in updates else f"t.{c} AS {c}"
        for c in columns
    )
    start = f"(SELECT greatest(max({key}), 0) FROM {target})"
    return f"""
{name}_in AS (SELECT *, TRUE AS hit FROM ({collapse.format(s=staging)})),
{name} AS (
  SELECT {merged}, t.{key} FROM {target} t LEFT JOIN {name}_in s ON {match}
  UNION ALL
  SELECT {', '.join(columns)}, CAST({numbered(key, natural, start).replace(f' AS {key}', '')} AS BIGINT)
  FROM {name}_in s WHERE NOT EXISTS (SELECT 1 FROM {target} t WHERE {match})
)"""


FACT_BODY = """
    Employee_ID AS EmployeeID, coalesce(e.EmployeeKey, -1) AS EmployeeKey, coalesce(j.JobKey, -1) AS JobKey,
    coalesce(l.LocationKey, -1) AS LocationKey, coalesce(t.TrainingKey, -1) AS TrainingKey,
    StartDate, ExitDate, Survey_Date AS SurveyDate, Training_Date AS TrainingDate, EmployeeStatus,
    EmployeeType, EmployeeClassificationType, PayZone,
    CASE WHEN EmployeeStatus = 'Active' THEN 0 ELSE 1 END AS AttritionFlag,
    TerminationType, TerminationDescription, Performance_Score AS PerformanceScore,
    Current_Employee_Rating AS CurrentRating, Engagement_Score AS EngagementScore,
    Satisfaction_Score AS SatisfactionScore, Work_Life_Balance_Score AS WorkLifeBalanceScore,
    Training_Outcome AS TrainingOutcome, Training_Duration_Days AS TrainingDurationDays,
    Training_Cost AS TrainingCost"""

# The stored columns of the fact, and those a later batch changes.
FACT_COLUMNS = (
    "EmployeeID", "EmployeeKey", "JobKey", "LocationKey", "TrainingKey", "StartDate", "ExitDate",
    "SurveyDate", "TrainingDate", "EmployeeStatus", "EmployeeType", "EmployeeClassificationType",
    "PayZone", "AttritionFlag", "TerminationType", "TerminationDescription", "PerformanceScore",
    "CurrentRating", "EngagementScore", "SatisfactionScore", "WorkLifeBalanceScore", "TrainingOutcome",
    "TrainingDurationDays", "TrainingCost",
)
FACT_UPDATED = (
    "ExitDate", "EmployeeStatus", "EmployeeClassificationType", "PayZone", "AttritionFlag",
    "TerminationType", "TerminationDescription", "PerformanceScore", "CurrentRating", "SatisfactionScore",
    "TrainingOutcome",
)


def fact_rows(staging: str, suffix: str) -> str:
    return f"""SELECT {FACT_BODY}
  FROM {staging} s
  LEFT JOIN emp{suffix} e ON s.Employee_ID = e.EmployeeID
  LEFT JOIN job{suffix} j ON s.Title = j.Title AND s.DepartmentType = j.Department
  LEFT JOIN loc{suffix} l ON s.LocationCode = l.LocationCode
  LEFT JOIN trn{suffix} t ON s.Training_Program_Name = t.ProgramName AND s.Trainer = t.TrainerName"""


def star_cte() -> str:
    """emp, job, loc, trn and fact after one load of all orders; fact with TenureDays."""
    dims = ",".join(dim_cte(name, dim, "s") for name, dim in DIMS.items())
    return f"""{staging_cte('s')},{dims},
fact AS (
  SELECT *, CAST(date_diff('day', StartDate, coalesce(ExitDate, {AS_OF_SQL})) AS INTEGER) AS TenureDays,
         {numbered('FactKey', FACT_KEY_ORDER)}
  FROM ({fact_rows('s', '')})
)"""


def two_batch_cte() -> str:
    """emp2, job2, loc2, trn2 and fact2 after a load of the earlier and one of the later orders."""
    first = ",".join(dim_cte(f"{name}1", dim, "s1") for name, dim in DIMS.items())
    second = ",".join(dim_merge_cte(f"{name}2", dim, f"{name}1", "s2") for name, dim in DIMS.items())
    merged = ", ".join(
        f"CASE WHEN s.hit THEN s.{c} ELSE t.{c} END AS {c}" if c in FACT_UPDATED else f"t.{c} AS {c}"
        for c in FACT_COLUMNS
    )
    start = "(SELECT max(FactKey) FROM fact1)"
    return f"""{staging_cte('s1', f"day < {SPLIT_SQL}")},{staging_cte('s2', f"day >= {SPLIT_SQL}")},
{first},{second},
fact1 AS (SELECT *, {numbered('FactKey', FACT_KEY_ORDER)} FROM ({fact_rows('s1', '1')})),
fact2_in AS (SELECT *, TRUE AS hit FROM ({fact_rows('s2', '2')})),
fact2 AS (
  SELECT {merged}, t.FactKey FROM fact1 t LEFT JOIN fact2_in s ON t.EmployeeID = s.EmployeeID
  UNION ALL
  SELECT {', '.join(FACT_COLUMNS)}, {numbered('FactKey', FACT_KEY_ORDER, start)}
  FROM fact2_in s WHERE NOT EXISTS (SELECT 1 FROM fact1 t WHERE t.EmployeeID = s.EmployeeID)
)"""

"""Loading a staging batch into the star schema."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffmart.functions.dates import age_years
from staffmart.functions.text import exact, folded, full_name
from staffmart.operators.cleaning import StagingError, clean
from staffmart.operators.fact import upsert_fact
from staffmart.operators.joins import ROWS_PER_TASK
from staffmart.operators.keys import empty_table, seed_unknown
from staffmart.operators.profile import is_loadable
from staffmart.operators.upsert import assert_unique, collapse_by_key, unmatched, upsert
from staffmart.schema import NATURAL, STAR_TABLES, SURROGATE
from staffmart.session import materialise
from staffmart.sources.csv import read_batch
from staffmart.sources.warehouse import Snapshot, part_of, stage

Match = Callable[[Column], Column]

# The dimension columns a later batch may change; the others keep their first value.
DIM_UPDATES = {
    "Dim_Employee": ("FullName", "Age", "MaritalStatus", "Supervisor", "Email"),
    "Dim_Job": ("JobFunctionDescription",),
    "Dim_Location": (),
    "Dim_Training": (),
}

# Rows meant for a part of the fact and of the employee dimension.
ROWS_PER_PART = 1 << 20
# Dimensions whose natural key has to stay unique.
UNIQUE_DIMS = ("Dim_Employee", "Dim_Location")


def employee_members(staging: DataFrame, as_of: dt.date, match: Match = exact) -> DataFrame:
    attributes = (
        "FirstName", "LastName", "DOB", "GenderCode", "RaceDesc", "MaritalDesc", "Supervisor", "ADEmail",
    )
    one = collapse_by_key(staging, ["Employee_ID"], attributes, match)
    return one.select(
        F.col("Employee_ID").alias("EmployeeID"),
        full_name(F.col("FirstName"), F.col("LastName")).alias("FullName"),
        age_years(F.col("DOB"), as_of).alias("Age"),
        F.col("GenderCode").alias("Gender"),
        F.col("RaceDesc").alias("Race"),
        F.col("MaritalDesc").alias("MaritalStatus"),
        "Supervisor",
        F.col("ADEmail").alias("Email"),
    )


def job_members(staging: DataFrame, match: Match = exact) -> DataFrame:
    attributes = ("BusinessUnit", "Division", "JobFunctionDescription")
    one = collapse_by_key(staging, ["Title", "DepartmentType"], attributes, match)
    return one.withColumnRenamed("DepartmentType", "Department")


def location_members(staging: DataFrame, match: Match = exact) -> DataFrame:
    one = collapse_by_key(staging, ["LocationCode"], ["State", "Location"], match)
    return one.withColumnRenamed("Location", "City")


def training_members(staging: DataFrame, match: Match = exact) -> DataFrame:
    one = collapse_by_key(staging, ["Training_Program_Name", "Trainer"], ["Training_Type"], match)
    return one.select(
        F.col("Training_Program_Name").alias("ProgramName"),
        F.col("Training_Type").alias("TrainingType"),
        F.col("Trainer").alias("TrainerName"),
    )


def dim_members(staging: DataFrame, as_of: dt.date, match: Match = exact) -> dict[str, DataFrame]:
    """One row per natural key and dimension, named like the dimension, without surrogate keys."""
    return {
        "Dim_Employee": employee_members(staging, as_of, match),
        "Dim_Job": job_members(staging, match),
        "Dim_Location": location_members(staging, match),
        "Dim_Training": training_members(staging, match),
    }


def upsert_dim(
    name: str,
    members: DataFrame,
    current: DataFrame | None,
    null_safe: bool = False,
    reference_employee_key: bool = False,
    match: Match = exact,
    top: int | None = None,
) -> DataFrame:
    """The dimension after the batch. Before the first load it consists of the unknown member."""
    if current is None:
        current = seed_unknown(empty_table(members.sparkSession, name), name, reference_employee_key)
    return upsert(current, members, NATURAL[name], SURROGATE[name], DIM_UPDATES[name], null_safe, match, top)


def touched_parts(snapshot: Snapshot, name: str, keys: DataFrame, rows_per_part: int) -> tuple[int, list[int] | None]:
    """How many parts the table has after a load of ``keys`` (one column, stored), and those the load rewrites: None for all.

    A part is meant to hold ``rows_per_part`` rows. When parts have grown to four times as many, their number is set anew and
    the table is dealt again, which all loads together pay for once in a doubling or two.
    """
    have, (key,) = snapshot.parts(name), keys.columns
    rows = snapshot.rows(name) + keys.count()
    if not have or rows > 4 * rows_per_part * have:
        return max(1, -(-rows // rows_per_part)), None
    if have == 1:
        return 1, [0]
    found = keys.where(F.col(key).isNotNull()).select(part_of(F.col(key), have).alias("part")).distinct()
    return have, sorted(row["part"] for row in found.collect()) or [0]


def spread_nulls(key: str, order: str, parts: int, touched: list[int] | None) -> Column:
    """The part of a row; rows without a key match nothing, so they are dealt over the parts that are written anyway."""
    places = F.array(*[F.lit(part) for part in touched]) if touched else F.sequence(F.lit(0), F.lit(parts - 1))
    dealt = F.get(places, F.pmod(F.xxhash64(order), F.size(places)).cast("int"))
    return F.when(F.col(key).isNull(), dealt).otherwise(part_of(F.col(key), parts))


def load_star(
    spark: SparkSession,
    staging: DataFrame,
    root: str,
    as_of: dt.date,
    null_safe: bool = False,
    reference_employee_key: bool = False,
    streams: dict[str, int] | None = None,
    fold_case: bool = False,
    rows_per_part: int = ROWS_PER_PART,
    small: bool | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> dict[str, DataFrame]:
    """Merge a stored staging batch into the star under ``root`` and publish all five tables at once.

    Defaults compute what a case-sensitive MERGE would. ``null_safe`` lets NULL key parts match,
    ``fold_case`` ignores case and trailing blanks in text keys and in the status,
    ``reference_employee_key`` gives the unknown employee an ordinary key.

    The employee dimension and the fact are stored in parts by a hash of the employee id; a batch reads and writes only the
    parts that its employees are in, and of the employee dimension the fact looks up in those alone. Insert-only
    dimensions without new members are not written. The members of a dimension are collapsed once into a
    written table, because the merge reads them several times. The four dimensions are independent and run at the same time; the
    fact sees them as stored, with known sizes. ``small`` passes on a check of the batch's and the dimensions' sizes to the fact's joins,
    ``rows_per_task`` how many rows of one key they leave in a task.
    """
    match = folded if fold_case else exact
    snapshot = Snapshot(spark, root)

    def load_dim(item: tuple[str, DataFrame]) -> tuple[str, DataFrame]:
        name, members = item
        members = materialise(members, f"members-{name}")
        parts, touched, part = 1, [0] if snapshot.parts(name) else None, None
        if name == "Dim_Employee":
            parts, touched = touched_parts(snapshot, name, members.select("EmployeeID"), rows_per_part)
            part = part_of(F.col("EmployeeID"), parts)
        current, top = snapshot.read(name, touched), snapshot.top(name)
        if current is not None and not DIM_UPDATES[name] and unmatched(current, members, NATURAL[name], null_safe, match).isEmpty():
            return name, current
        merged = upsert_dim(name, members, current, null_safe, reference_employee_key, match, top)
        stored = snapshot.write(name, merged, part, parts, touched)
        if name in UNIQUE_DIMS:
            assert_unique(stored, NATURAL[name])  # equal keys share a part
        return name, stored

    members = dim_members(staging, as_of, match)
    with ThreadPoolExecutor(len(members)) as pool:
        loaded = dict(pool.map(inheritable_thread_target(spark)(load_dim), members.items()))
    parts, touched = touched_parts(snapshot, "Fact_HR", staging.select("Employee_ID"), rows_per_part)
    fact = upsert_fact(snapshot.read("Fact_HR", touched), staging, loaded, as_of, match, null_safe, snapshot.top("Fact_HR"), small, rows_per_task)
    snapshot.write("Fact_HR", fact, spread_nulls("EmployeeID", "FactKey", parts, touched), parts, touched)
    snapshot.commit(streams)
    return {name: snapshot.read(name) for name in STAR_TABLES}


def load_report(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    as_of: dt.date,
    rejects: str | None = None,
    **options,
) -> DataFrame:
    """Clean, stage and load one raw batch; returns one row with success, message and counts.

    Required columns are checked before anything is written. An empty batch and a failed load leave
    the star as it was; counts are taken after cleaning, while the batch is written. A value that does not fit fails the load; with
    ``rejects``, the path of a table, such rows are added to it as they came, with the columns at fault, the rest is
    loaded, and the report has their number. They are added once the load is published, so a failed load adds none.
    """
    names = ("records", "active", "terminated") + (("rejected",) if rejects else ())

    def report(success: bool, message: str, counts: Mapping[str, int] | None = None) -> DataFrame:
        return spark.range(1).select(
            F.lit(success).alias("success"),
            F.lit(message).alias("message"),
            *[F.lit((counts or {}).get(name, 0)).cast("long").alias(name) for name in names],
        )

    try:
        if "ExitDate" not in raw.columns:
            raise StagingError("column ExitDate is missing")
        if not is_loadable(raw):  # cleaning never removes the last row, so the raw batch decides
            return report(False, "no valid data to load")
        staged = stage(clean(raw, as_of), root, quarantine=rejects is not None)
        counts = staged.counts
        if counts["records"]:
            load_star(spark, staged.rows, root, as_of, **options)
        if rejects and counts["rejected"]:
            staged.rejected.write.mode("append").parquet(rejects)
    except Exception as error:  # the report is the interface: it carries the cause
        return report(False, f"load failed: {error}")
    if not counts["records"]:
        return report(False, f"no valid data to load ({counts['rejected']} rejected)", counts)
    message = f"loaded {counts['records']} records ({counts['active']} active, {counts['terminated']} terminated)"
    return report(True, message, counts)


def load_csv(
    spark: SparkSession, path: str, root: str, as_of: dt.date, multiline: bool = False, **options
) -> DataFrame:
    """Load CSV files. Quoted line breaks need ``multiline``; without it they fail the load instead of tearing rows."""
    return load_report(spark, read_batch(spark, path, multiline), root, as_of, **options)

"""Fact rows: dimension lookups, derived columns and the fact upsert."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.functions.dates import tenure_days
from staffmart.functions.text import exact
from staffmart.operators.joins import ROWS_PER_TASK, fits_broadcast, hot_keys, lookup, spread_out
from staffmart.operators.keys import allocate_keys
from staffmart.operators.upsert import AmbiguousMatchError
from staffmart.schema import NATURAL, STAR_SCHEMAS, SURROGATE
from staffmart.session import materialise

# Staging column -> fact column, where the name changes.
FACT_NAMES = {
    "Employee_ID": "EmployeeID",
    "Survey_Date": "SurveyDate",
    "Training_Date": "TrainingDate",
    "Performance_Score": "PerformanceScore",
    "Current_Employee_Rating": "CurrentRating",
    "Engagement_Score": "EngagementScore",
    "Satisfaction_Score": "SatisfactionScore",
    "Work_Life_Balance_Score": "WorkLifeBalanceScore",
    "Training_Outcome": "TrainingOutcome",
    "Training_Duration_Days": "TrainingDurationDays",
    "Training_Cost": "TrainingCost",
}

# The fact columns a later batch may change. All others keep their first value.
FACT_UPDATES = (
    "ExitDate", "EmployeeStatus", "EmployeeClassificationType", "PayZone", "TerminationType",
    "TerminationDescription", "AttritionFlag", "PerformanceScore", "CurrentRating",
    "SatisfactionScore", "TrainingOutcome", "LastUpdateDate",
)

# Staging columns a lookup compares with the natural key of each dimension.
LOOKUP_KEYS = {
    "Dim_Employee": ("EmployeeID",),
    "Dim_Job": ("Title", "DepartmentType"),
    "Dim_Location": ("LocationCode",),
    "Dim_Training": ("Training_Program_Name", "Trainer"),
}

FACT_COLUMNS = STAR_SCHEMAS["Fact_HR"].names
# Order in which new facts are numbered: everything that describes the row, keys excluded.
FACT_KEY_ORDER = tuple(
    name for name in FACT_COLUMNS if name not in ("FactKey", "LastUpdateDate", *SURROGATE.values())
)


def attrition_flag(status: Column, match: Callable[[Column], Column] = exact) -> Column:
    """0 for 'Active', 1 for any other status and for none."""
    return F.when(match(status) == match(F.lit("Active")), 0).otherwise(1)


def coalesce_key(key: Column, unknown: int = -1) -> Column:
    return F.coalesce(key, F.lit(unknown)).cast("long")


def stamp(df: DataFrame, as_of: dt.date) -> DataFrame:
    return df.withColumn("LastUpdateDate", F.lit(as_of).cast("timestamp"))


def lookup_dims(
    rows: DataFrame,
    dims: Mapping[str, DataFrame],
    small: Mapping[str, bool] | None = None,
    hot_from: DataFrame | None = None,
    match: Callable[[Column], Column] = exact,
    null_safe: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Left lookups of the four surrogate keys; unresolved ones stay NULL.

    Members with a NULL key part cannot match and leave first, which makes the rest unique; with ``null_safe``
    NULL parts match each other, and the unknown member is no candidate. Only the
    key columns of a dimension travel. Key frequencies, where they matter, are counted for all lookups in one scan of
    ``hot_from``, a stored table with the lookup columns, instead of on the joins so far.
    """
    types = dict(rows.dtypes)

    def marked(value: Column) -> Column:
        """With ``null_safe`` a text that tells NULL from every value, else the value."""
        return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("")) if null_safe else value

    def compared(name: str) -> Column:
        value = match(F.col(name)) if types[name] == "string" else F.col(name)
        return marked(value).alias(f"_m_{name}")

    keys = [c for columns in LOOKUP_KEYS.values() for c in columns]
    found = rows.select("*", *[compared(c) for c in keys])
    sizes = {name: fits_broadcast(dims[name]) if small is None else small[name] for name in LOOKUP_KEYS}
    hot = None
    if not all(sizes.values()):
        counted = (rows if hot_from is None else hot_from).select(*[compared(c) for c in keys])
        large = {name: [f"_m_{c}" for c in columns] for name, columns in LOOKUP_KEYS.items() if not sizes[name]}
        hot = hot_keys(counted, large, rows_per_task)
    for name, columns in LOOKUP_KEYS.items():
        natural = NATURAL[name]
        members = dims[name].select(SURROGATE[name], *[F.col(n).alias(f"_n_{n}") for n in natural])
        if null_safe:
            members = members.where(F.col(SURROGATE[name]) != -1)
        else:
            members = members.dropna(subset=[f"_n_{n}" for n in natural])
        members = members.withColumns(
            {f"_n_{n}": match(F.col(f"_n_{n}")) for n in natural if dict(dims[name].dtypes)[n] == "string"}
        )
        members = members.withColumns({f"_n_{n}": marked(F.col(f"_n_{n}")) for n in natural})
        found = lookup(
            found,
            members,
            [(f"_m_{column}", f"_n_{n}") for column, n in zip(columns, natural)],
            small=sizes[name],
            hot=None if sizes[name] else hot.where(F.col("lookup") == name),
        )
    return found.drop(*[f"_m_{c}" for c in keys])


def fact_source(
    staging: DataFrame, as_of: dt.date, match: Callable[[Column], Column] = exact
) -> DataFrame:
    """Staging rows under fact names, with the flag and the audit time; lookup columns stay aboard."""
    rows = staging.withColumnsRenamed(FACT_NAMES)
    flag = attrition_flag(F.col("EmployeeStatus"), match)
    return stamp(rows.withColumn("AttritionFlag", flag), as_of)


def new_facts(
    rows: DataFrame,
    source: DataFrame,
    dims: Mapping[str, DataFrame],
    existing: DataFrame | None = None,
    match: Callable[[Column], Column] = exact,
    null_safe: bool = False,
    top: int | None = None,
    small: bool | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Fact rows for ``rows``, those of the stored batch ``source`` that have none yet.

    Numbering comes before the lookups: it needs staging columns only, so its counting pass stays a
    scan, and the joins run once.
    """
    few = fits_broadcast(source) if small is None else small
    numbered = allocate_keys(rows, "FactKey", FACT_KEY_ORDER, existing, small=few, top=top)
    sizes = None if small is None else dict.fromkeys(LOOKUP_KEYS, small)
    found = lookup_dims(numbered, dims, sizes, hot_from=source, match=match, null_safe=null_safe, rows_per_task=rows_per_task)
    found = found.withColumns({key: coalesce_key(F.col(key)) for key in SURROGATE.values()})
    return found.select(*FACT_COLUMNS)


def upsert_fact(
    fact: DataFrame | None,
    staging: DataFrame,
    dims: Mapping[str, DataFrame],
    as_of: dt.date,
    match: Callable[[Column], Column] = exact,
    null_safe: bool = False,
    top: int | None = None,
    small: bool | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Update the changeable columns of known employees, insert rows for the others.

    A row without an employee id matches nothing and is inserted by every load. Two rows of one
    batch for an employee already in ``fact`` raise ``AmbiguousMatchError``.

    ``fact`` is read twice: its ids alone, to tell the batch's known employees from new ones, and
    its rows, to update them. The batch is collapsed to one row per employee, which says how often the
    employee occurs, whether the fact knows them, and what is new. ``top`` is the largest fact key
    where ``fact`` is only some parts of the table; ``small`` passes on a size check.
    """
    source = fact_source(staging, as_of, match)
    if fact is None:
        return new_facts(source, source, dims, match=match, null_safe=null_safe, top=top, small=small, rows_per_task=rows_per_task)
    batch_small = fits_broadcast(staging) if small is None else small
    per_id = source.where(F.col("EmployeeID").isNotNull()).groupBy(F.col("EmployeeID").alias("_id"))
    per_id = per_id.agg(F.count(F.lit(1)).alias("_rows"), F.max(F.struct(*FACT_UPDATES)).alias("_new"))
    known = known_ids(per_id, fact, batch_small)
    several = known.where("_known AND _rows > 1").select("_id", "_rows").take(3)
    if several:
        raise AmbiguousMatchError(f"several source rows match one target row, for example {several}")

    changes = known.where("_known").select("_id", "_new")
    updated = lookup(fact, changes, [("EmployeeID", "_id")], "left", small=batch_small, rows_per_task=rows_per_task)
    updated = updated.select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name) if name in FACT_UPDATES else F.col(name)
        for name in fact.columns
    ])
    fresh = lookup(source, known.where("_known").select("_id"), [("EmployeeID", "_id")], "left_anti", small=batch_small, rows_per_task=rows_per_task)
    if not batch_small:
        fresh = materialise(fresh, "fresh")  # read twice: to count and to number
    return updated.unionByName(new_facts(fresh, source, dims, fact, match, null_safe, top, small, rows_per_task))


def known_ids(per_id: DataFrame, fact: DataFrame, small: bool) -> DataFrame:
    """``per_id`` with the mark whether the fact holds the id: a stored table of the batch's size.

    The ids of the fact meet the batch's before they are reduced to one each, so a small batch lets few of them through.
    """
    ids = fact.select(F.col("EmployeeID").alias("_seen")).where("_seen IS NOT NULL")
    if small:
        per_id = materialise(per_id, "batch-ids")
        ids = ids.join(F.broadcast(per_id.select("_id")), F.col("_seen") == F.col("_id"), "left_semi")
    ids = ids.distinct().withColumn("_known", F.lit(True))
    marked = per_id.join(ids if small else spread_out(ids), F.col("_id") == F.col("_seen"), "left").drop("_seen")
    return materialise(marked.withColumn("_known", F.coalesce("_known", F.lit(False))), "known-ids")


def with_tenure(fact: DataFrame, as_of: dt.date) -> DataFrame:
    """Tenure is evaluated at read time: it grows daily while there is no exit."""
    return fact.withColumn("TenureDays", tenure_days(F.col("StartDate"), F.col("ExitDate"), as_of))

"""Workforce measures over the star.

A measure by a dimension attribute is first summed per surrogate key and only then joined: the fact
is read once, combined map-side, and what meets the dimension is one row per member, however the
fact rows are distributed over members.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staffmart.operators.fact import with_tenure
from staffmart.schema import SURROGATE

# Upper limits of the tenure bands, in days, and their names; the last band is open.
TENURE_BANDS = ((365, "<1y"), (3 * 365, "1-3y"), (5 * 365, "3-5y"))
LAST_BAND = "5y+"

PERIOD_STEP = {"month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}


def sums_by_member(
    fact: DataFrame, dim: DataFrame, dim_name: str, attributes: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """One row per dimension member used by the fact: its attributes and the named sums."""
    key = SURROGATE[dim_name]
    totals = fact.groupBy(key).agg(*[F.sum(column).alias(name) for name, column in sums.items()])
    return totals.join(dim.select(key, *attributes), key, "left")


def sums_by(
    fact: DataFrame, dim: DataFrame, dim_name: str, attribute: str, sums: Mapping[str, Column]
) -> DataFrame:
    members = sums_by_member(fact, dim, dim_name, [attribute], sums)
    return members.groupBy(attribute).agg(*[F.sum(name).alias(name) for name in sums])


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """Rounded quotient; NULL over zero."""
    return F.round(F.when(whole != 0, part / whole), digits)


def measure_by(star: Mapping[str, DataFrame], measure: str, dim: str, attribute: str) -> DataFrame:
    return sums_by(star["Fact_HR"], star[dim], dim, attribute, {f"total_{measure}": F.col(measure)})


def headcount(star: Mapping[str, DataFrame], dim: str, attribute: str) -> DataFrame:
    """Active rows: those without the attrition flag."""
    active = (F.col("AttritionFlag") == 0).cast("long")
    return sums_by(star["Fact_HR"], star[dim], dim, attribute, {"headcount": active})


def avg_tenure(star: Mapping[str, DataFrame], dim: str, attribute: str, as_of: dt.date) -> DataFrame:
    sums = {
        "days": F.col("TenureDays").cast("long"),
        "known": F.col("TenureDays").isNotNull().cast("long"),
    }
    found = sums_by(with_tenure(star["Fact_HR"], as_of), star[dim], dim, attribute, sums)
    return found.select(attribute, ratio(F.col("days"), F.col("known")).alias("avg_tenure_days"))


def kpi_by(star: Mapping[str, DataFrame], dim: str, attribute: str, as_of: dt.date) -> DataFrame:
    """Rows, headcount, attrition rate, average tenure and training cost in one pass over the fact."""
    sums = {
        "employees": F.lit(1).cast("long"),
        "headcount": (F.col("AttritionFlag") == 0).cast("long"),
        "days": F.col("TenureDays").cast("long"),
        "known": F.col("TenureDays").isNotNull().cast("long"),
        "training_cost": F.col("TrainingCost"),
    }
    found = sums_by(with_tenure(star["Fact_HR"], as_of), star[dim], dim, attribute, sums)
    return found.select(
        attribute,
        "employees",
        "headcount",
        ratio(F.col("employees") - F.col("headcount"), F.col("employees")).alias("attrition_rate"),
        ratio(F.col("days"), F.col("known")).alias("avg_tenure_days"),
        F.col("training_cost").cast("decimal(28,2)").alias("training_cost"),
    )


def dim_date(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per calendar day, without gaps."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("date")
    )
    day = F.col("date")
    return days.select(
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day"),
        F.weekday(day).alias("weekday"),
        F.trunc(day, "month").alias("month_start"),
    )


def dated_moves(fact: DataFrame, keys: Sequence[str], as_of: dt.date, period: str) -> DataFrame:
    """(keys, period, joined, parted, exits): each fact row becomes its dated events, summed per period in one pass."""
    start, gone = F.col("StartDate"), F.col("ExitDate")

    def event(when: Column, joined: int, parted: int, exits: int) -> Column:
        return F.struct(
            F.trunc(when, period).alias("period"),
            *[F.lit(n).alias(c) for n, c in ((joined, "joined"), (parted, "parted"), (exits, "exits"))],
        )

    parted = F.when(start.isNotNull() & gone.isNotNull(), F.greatest(start, gone))
    events = F.array(event(start, 1, 0, 0), event(parted, 0, 1, 0), event(gone, 0, 0, 1))
    moves = fact.select(*keys, F.inline(events)).where(F.col("period") <= F.lit(as_of))
    return moves.groupBy(*keys, "period").agg(*[F.sum(c).alias(c) for c in ("joined", "parted", "exits")])


def headcounts(moves: DataFrame, by: Sequence[str], as_of: dt.date, period: str) -> DataFrame:
    """Turnover of every group from its first event to the period of ``as_of``; the calendar fills periods without events."""
    last = F.trunc(F.lit(as_of), period)
    span = F.explode(F.sequence("first", last, F.expr(PERIOD_STEP[period]))).alias("period")
    calendar = moves.groupBy(*by).agg(F.min("period").alias("first")).where("first IS NOT NULL").select(*by, span)
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by] + [F.col("_period") == F.col("period")]
    sums = moves.select(*[F.col(c).alias(f"_{c}") for c in (*by, "period")], "joined", "parted", "exits")
    full = calendar.join(sums, same, "left").fillna(0, ["joined", "parted", "exits"])
    until = Window.partitionBy(*by).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closing = F.sum(F.col("joined") - F.col("parted")).over(until)
    found = full.withColumn("closing", closing).withColumn(
        "opening", F.col("closing") - F.col("joined") + F.col("parted")
    )
    return found.select(
        *by,
        "period",
        "opening",
        "closing",
        "exits",
        ratio(F.col("exits"), (F.col("opening") + F.col("closing")) / 2).alias("turnover_rate"),
    )


def turnover(fact: DataFrame, as_of: dt.date, period: str = "year") -> DataFrame:
    """Exits per period over the mean of opening and closing headcount, up to the period of ``as_of``.

    Headcounts are running sums over the few periods, so no row is compared with every period.
    """
    return headcounts(dated_moves(fact, [], as_of, period), [], as_of, period)


def turnover_by(
    star: Mapping[str, DataFrame], dim: str, attributes: Sequence[str], as_of: dt.date, period: str = "quarter"
) -> DataFrame:
    """Turnover of every combination of a dimension's attributes, each with a calendar of its own; NULL is a value.

    Events are summed per member and period before they meet the dimension, then per attribute and period. What the windows see is
    one row per attribute value and period.
    """
    key = SURROGATE[dim]
    members = dated_moves(star["Fact_HR"], [key], as_of, period).join(star[dim].select(key, *attributes), key, "left")
    sums = [F.sum(c).alias(c) for c in ("joined", "parted", "exits")]
    return headcounts(members.groupBy(*attributes, "period").agg(*sums), attributes, as_of, period)


def time_intelligence(df: DataFrame, day: str, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Monthly totals with running total, previous month and year to date, of all rows or of every group ``by``.

    Months without rows total 0, from a group's first month to its last; NULL is a group. The windows run over monthly
    totals: a few hundred rows a group for any amount of data.
    """
    found = df.where(F.col(day).isNotNull()).groupBy(*by, F.trunc(day, "month").alias("month")).agg(F.sum(value).alias("total"))
    span = F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))
    months = found.groupBy(*by).agg(span.alias("months")).select(*by, F.explode("months").alias("month"))
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by] + [F.col("_month") == F.col("month")]
    monthly = months.join(found.select(*[F.col(c).alias(f"_{c}") for c in (*by, "month")], "total"), same, "left")
    monthly = monthly.withColumn("total", F.coalesce("total", F.lit(0).cast(found.schema["total"].dataType)))
    in_group = Window.partitionBy(*by).orderBy("month")
    so_far = in_group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_year = Window.partitionBy(*by, F.year("month")).orderBy("month").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return monthly.select(
        *by,
        "month",
        "total",
        F.sum("total").over(so_far).alias("running_total"),
        F.lag("total").over(in_group).alias("previous_month"),
        F.sum("total").over(in_year).alias("year_to_date"),
    )


def tenure_band(days: Column) -> Column:
    band = F.when(days.isNull(), F.lit(None).cast("string"))
    for limit, name in TENURE_BANDS:
        band = band.when(days < limit, name)
    return band.otherwise(LAST_BAND)


def attrition_drivers(fact: DataFrame, as_of: dt.date) -> DataFrame:
    """Attrition rate by pay zone and tenure band."""
    banded = with_tenure(fact, as_of).withColumn("tenure_band", tenure_band(F.col("TenureDays")))
    flag = F.col("AttritionFlag").cast("long")
    counted = banded.groupBy("PayZone", "tenure_band").agg(
        F.count(F.lit(1)).alias("employees"), F.sum(flag).alias("leavers")
    )
    return counted.withColumn("attrition_rate", ratio(F.col("leavers"), F.col("employees")))


def distribution(star: Mapping[str, DataFrame], dim: str, attribute: str) -> DataFrame:
    """Rows per attribute value and their share of all rows (the total is a scalar subquery)."""
    counted = sums_by(star["Fact_HR"], star[dim], dim, attribute, {"employees": F.lit(1).cast("long")})
    whole = star["Fact_HR"].agg(F.count(F.lit(1)).alias("whole"))
    return counted.withColumn("share", ratio(F.col("employees"), whole.scalar()))


def training_effect(star: Mapping[str, DataFrame], as_of: dt.date) -> DataFrame:
    """Average tenure per programme and its distance from the overall average; descriptive only."""
    fact = with_tenure(star["Fact_HR"], as_of)
    sums = {
        "employees": F.lit(1).cast("long"),
        "days": F.col("TenureDays").cast("long"),
        "known": F.col("TenureDays").isNotNull().cast("long"),
    }
    found = sums_by(fact, star["Dim_Training"], "Dim_Training", "ProgramName", sums)
    overall = fact.agg(F.avg("TenureDays").alias("overall")).scalar()
    mean = F.when(F.col("known") != 0, F.col("days") / F.col("known"))
    return found.select(
        "ProgramName",
        "employees",
        F.round(mean, 6).alias("avg_tenure_days"),
        F.round(mean - overall, 6).alias("tenure_difference"),
    )


def kpi_rollup(star: Mapping[str, DataFrame], outer: str, inner: str) -> DataFrame:
    """Drill-down totals over two job attributes; the rollup expands members, not fact rows."""
    sums = {
        "employees": F.lit(1).cast("long"),
        "leavers": F.col("AttritionFlag").cast("long"),
        "training_cost": F.col("TrainingCost"),
    }
    members = sums_by_member(star["Fact_HR"], star["Dim_Job"], "Dim_Job", [outer, inner], sums)
    return members.rollup(outer, inner).agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("employees").alias("employees"),
        F.sum("leavers").alias("leavers"),
        F.sum("training_cost").cast("decimal(28,2)").alias("training_cost"),
    )

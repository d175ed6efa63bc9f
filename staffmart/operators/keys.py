"""Surrogate keys and unknown members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staffmart.schema import STAR_SCHEMAS, SURROGATE

KEY_BUCKET_DIGITS = 4

# The unknown member of each dimension (surrogate key -1 is added to it).
UNKNOWN_MEMBERS = {
    "Dim_Employee": {
        "EmployeeID": -1, "FullName": "Unknown Employee", "Age": -1, "Gender": "Unknown",
        "Race": "Unknown", "MaritalStatus": "Unknown", "Supervisor": "Unknown", "Email": "Unknown",
    },
    "Dim_Job": {
        "Title": "Unknown Title", "Department": "Unknown Dept", "BusinessUnit": "Unknown BU",
        "Division": "Unknown Div", "JobFunctionDescription": "Unknown Description",
    },
    "Dim_Location": {"LocationCode": -1, "State": "Unknown State", "City": "Unknown City"},
    "Dim_Training": {"ProgramName": "No Training", "TrainingType": "N/A", "TrainerName": "N/A"},
}


def key_bucket(order_by: Sequence[str], digits: int = KEY_BUCKET_DIGITS) -> Column:
    """Even spread of rows over 16**digits buckets, computed from the row itself."""
    texts = [F.col(name).cast("string") for name in order_by]
    return F.substring(F.md5(F.concat_ws("|", *texts)), 1, digits)


def allocate_keys(
    new_rows: DataFrame,
    key: str,
    order_by: Sequence[str],
    existing: DataFrame | None = None,
    digits: int = KEY_BUCKET_DIGITS,
    small: bool = False,
    top: int | None = None,
) -> DataFrame:
    """Number ``new_rows`` without gaps after the largest existing key, which is ``top`` where that is known.

    The order is (hash bucket, ``order_by``). A bucket is a pure function of the row, so counting
    and numbering agree even when a lost task is rerun, and no task sees more than its buckets.
    The offsets are at most 16**digits rows, which bounds both their window and their broadcast.
    ``small`` says that the rows passed the broadcast bound: one task then numbers them, alike.
    """
    bucketed = new_rows.withColumn("_bucket", key_bucket(order_by, digits))
    order = [F.asc_nulls_first(name) for name in order_by]
    start = F.greatest(F.coalesce(F.max(key), F.lit(0)), F.lit(0)).alias("_size")
    if small:
        nth = F.row_number().over(Window.orderBy("_bucket", *order))
        base = F.lit(max(top or 0, 0)) if existing is None or top is not None else existing.agg(start).scalar()
        return bucketed.withColumn(key, (base + nth).cast("long")).drop("_bucket")
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    if top is not None:
        sizes = sizes.unionByName(sizes.sparkSession.range(1).select(F.lit("").alias("_bucket"), F.lit(max(top, 0)).cast("long").alias("_size")))
    elif existing is not None:
        sizes = sizes.unionByName(existing.agg(start).withColumn("_bucket", F.lit("")))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_bucket").alias("_offset_bucket"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    within = Window.partitionBy("_bucket").orderBy(*order)
    return (
        bucketed.withColumn("_nth", F.row_number().over(within))
        .join(F.broadcast(offsets), F.col("_bucket") == F.col("_offset_bucket"))
        .withColumn(key, (F.col("_offset") + F.col("_nth")).cast("long"))
        .drop("_bucket", "_offset_bucket", "_offset", "_nth")
    )


def unknown_member(spark: SparkSession, dim: str, reference_employee_key: bool = False) -> DataFrame:
    """The one row an unresolved lookup points to.

    ``reference_employee_key`` gives the unknown employee surrogate key 1 (as an identity column
    would) instead of -1; every other dimension always uses -1.
    """
    key = 1 if reference_employee_key and dim == "Dim_Employee" else -1
    values = {SURROGATE[dim]: key, **UNKNOWN_MEMBERS[dim]}
    return spark.range(1).select(
        *[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in STAR_SCHEMAS[dim].fields]
    )


def seed_unknown(dim: DataFrame, name: str, reference_employee_key: bool = False) -> DataFrame:
    return unknown_member(dim.sparkSession, name, reference_employee_key).unionByName(dim)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.range(0).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in STAR_SCHEMAS[name].fields]
    )

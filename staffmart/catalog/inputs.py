"""What the named queries share: loaded stars and the raw batch they clean."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffmart.plans.star import load_star
from staffmart.session import filesystem, fresh_dir
from staffmart.sources.csv import read_batch
from staffmart.sources.derived import AS_OF, SPLIT, derived_staging, read
from staffmart.sources.warehouse import read_star, write_staging

DERIVED_FROM = ("customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events")
WHOLE = (None,)
TWO_BATCHES = ("before", "after")

_loaded: dict[tuple, str] = {}


def _state_of(spark: SparkSession, sf_dir: str) -> tuple:
    """Length and time of the input files; a star loaded from other files is not reused."""
    state = []
    for name in DERIVED_FROM:
        fs, path = filesystem(spark, f"{sf_dir}/{name}.parquet")
        status = fs.getFileStatus(path)
        summary = fs.getContentSummary(path)
        state.append((name, summary.getLength(), summary.getFileCount(), status.getModificationTime()))
    return tuple(state)


def batch(spark: SparkSession, sf_dir: str, which: str | None) -> DataFrame:
    if which == "before":
        return derived_staging(spark, sf_dir, last=SPLIT)
    if which == "after":
        return derived_staging(spark, sf_dir, first=SPLIT)
    return derived_staging(spark, sf_dir)


def star_root(spark: SparkSession, sf_dir: str, batches: tuple = WHOLE) -> str:
    """Folder of a star loaded from the tables in ``sf_dir``: once per application and input state,
    as a warehouse is loaded once and then queried."""
    key = (spark.sparkContext.applicationId, sf_dir, batches, _state_of(spark, sf_dir))
    if key not in _loaded:
        root = fresh_dir(spark, "star")
        for which in batches:
            load_star(spark, write_staging(batch(spark, sf_dir, which), root), root, AS_OF)
        _loaded[key] = root
    return _loaded[key]


def star(spark: SparkSession, sf_dir: str, batches: tuple = WHOLE) -> dict[str, DataFrame]:
    return read_star(spark, star_root(spark, sf_dir, batches))


def raw_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an untidy extract: copies that differ by index, spelling or blanks, padded text,
    null tokens, unreadable dates and quoted separators."""
    key = F.col("c_custkey")
    copies = F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(0), F.lit(1))
    )
    people = read(spark, sf_dir, "customer").withColumn("copy", F.explode(copies))
    copy = F.col("copy")
    hired = F.date_add(F.lit(dt.date(1995, 1, 1)), (key % 2000).cast("int"))
    left = F.date_format(F.date_add(hired, 400), "yyyy-MM-dd HH:mm:ss")
    name = F.when(key % 3 == 0, F.concat(F.lit("\t "), "c_name", F.lit(" "))).otherwise(
        F.col("c_name")
    )
    tokens = F.array(*[F.lit(t) for t in ("NaT", "  ", "None", "N/A", "NAT", "Lee")])
    return people.select(
        (key * 3 + copy).cast("string").alias("Unnamed: 0"),
        F.when(copy == 1, F.concat(key.cast("string"), F.lit(".0")))
        .otherwise(key.cast("string"))
        .alias("Employee ID"),
        F.when(copy == 2, F.concat(F.lit(" "), name)).otherwise(name).alias("FirstName"),
        F.element_at(tokens, (key % 6 + 1).cast("int")).alias("LastName"),
        F.date_format(hired, "dd/MM/yyyy").alias("StartDate"),
        F.when(key % 4 == 0, "garbage").when(key % 4 == 1, left).alias("ExitDate"),
        F.lit('Lead, "R&D"').alias("Title"),
        F.col("c_mktsegment").alias("DepartmentType"),
        F.when(key % 4 == 0, "Active").otherwise("Left").alias("EmployeeStatus"),
        F.col("c_nationkey").cast("string").alias("LocationCode"),
        F.when(key % 7 != 0, (key % 5 + 1).cast("string")).alias("Satisfaction Score"),
        F.round("c_acctbal", 2).cast("decimal(12,2)").cast("string").alias("Training Cost"),
    )


def raw_people_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untidy extract after a round trip through CSV files."""
    path = fresh_dir(spark, "extract")
    writer = raw_people(spark, sf_dir).write.option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path)
    return read_batch(spark, path)

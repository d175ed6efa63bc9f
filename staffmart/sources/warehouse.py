"""Stored tables: staging, versioned star snapshots and their views."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from staffmart.operators.cleaning import cast_to_staging, judged
from staffmart.operators.fact import with_tenure
from staffmart.schema import STAGING_SCHEMA, STAR_SCHEMAS, STAR_TABLES, SURROGATE
from staffmart.session import filesystem


class PublishConflict(RuntimeError):
    """Another load published while this one ran."""


# What is counted while a batch is written.
COUNTS = {
    "records": "count_if(_fits)",
    "active": "count_if(_fits AND ExitDate IS NULL)",
    "terminated": "count_if(_fits AND ExitDate IS NOT NULL)",
    "rejected": "count_if(NOT _fits)",
}


class Staged:
    """A stored batch, the rows it rejected in their original form with the reason, and the counts taken while it was written."""

    def __init__(self, rows: DataFrame, rejected: DataFrame | None, counts: Mapping[str, int]) -> None:
        self.rows, self.rejected, self.counts = rows, rejected, counts


def stage(df: DataFrame, root: str, quarantine: bool = False) -> Staged:
    """Replace the staging batch by ``df``; the previous batch stays readable until the new one is whole.

    The batch is cleaned, typed, counted and written in one pass. With ``quarantine`` rows with a value that does not fit are
    written beside the others, without it they stop the load.
    """
    spark = df.sparkSession
    path = f"{root}/staging/batch-{uuid.uuid4().hex}"
    if quarantine:
        values, faults = judged(df)
        bad = F.col("_reason") != ""
        original = F.when(bad, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        rows = df.withColumn("_reason", faults).select(*values, original.alias("_original"), "_reason", (~bad).alias("_fits"))
    else:
        rows = cast_to_staging(df).withColumn("_fits", F.lit(True))
    counts = Observation()
    observed = rows.observe(counts, *[F.expr(count).alias(name) for name, count in COUNTS.items()])
    observed.write.mode("errorifexists").partitionBy("_fits").parquet(path)
    found = {name: counts.get.get(name) or 0 for name in COUNTS}

    def part(fits: bool, schema: StructType) -> DataFrame:
        if not found["records" if fits else "rejected"]:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{path}/_fits={str(fits).lower()}")

    rejected = None
    if quarantine:
        kept = part(False, StructType([rows.schema["_original"], rows.schema["_reason"]]))
        rejected = kept.select("_original.*", F.col("_reason").alias("reject_reason"))
    _append_record(spark, f"{root}/staging/records", path)
    return Staged(part(True, STAGING_SCHEMA), rejected, found)


def write_staging(df: DataFrame, root: str) -> DataFrame:
    """``stage`` for a batch whose values have to fit. Its five readers scan narrow columns instead of repeating the cleaning."""
    return stage(df, root).rows


def read_staging(spark: SparkSession, root: str) -> DataFrame:
    folder = f"{root}/staging/records"
    path = _get(spark, f"{folder}/{_records(spark, folder)[-1]}")
    fs, fitting = filesystem(spark, f"{path}/_fits=true")
    if not fs.exists(fitting):
        return spark.createDataFrame([], STAGING_SCHEMA)
    return spark.read.schema(STAGING_SCHEMA).parquet(f"{path}/_fits=true")


def _records(spark: SparkSession, folder: str) -> list[str]:
    """Names of the whole records in a folder, oldest first."""
    fs, path = filesystem(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.endswith(".json"))


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a record that must not exist yet. It gets its name only when it is whole."""
    fs, target = filesystem(spark, path)
    _, draft = filesystem(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise PublishConflict(f"{path} was published by another load")


def _append_record(spark: SparkSession, folder: str, text: str) -> None:
    names = _records(spark, folder)
    number = int(names[-1].split(".")[0]) + 1 if names else 1
    _put(spark, f"{folder}/{number:010d}.json", text)


def _get(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = filesystem(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current_commit(spark: SparkSession, root: str) -> dict | None:
    """The newest commit record, or None before the first load."""
    names = _records(spark, f"{root}/commits")
    return json.loads(_get(spark, f"{root}/commits/{names[-1]}")) if names else None


def part_of(key: Column, parts: int) -> Column:
    """The part that holds a key; the same in every load."""
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(parts)).cast("int")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current snapshot; readers of older snapshots are not disturbed by a publish."""
    commit = current_commit(spark, root)
    if commit is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return _read_parts(spark, name, commit["tables"][name])


def _read_parts(spark: SparkSession, name: str, entry: Mapping, wanted: Collection[int] | None = None) -> DataFrame:
    """The parts of a table that a record names, or the ``wanted`` ones of them."""
    paths = [part["path"] for number, part in sorted(entry["paths"].items()) if wanted is None or int(number) in wanted]
    if not paths:
        return spark.createDataFrame([], STAR_SCHEMAS[name])
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(*paths)


def read_star(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """All five tables of one snapshot, or None before the first load."""
    commit = current_commit(spark, root)
    if commit is None:
        return None
    return {name: _read_parts(spark, name, commit["tables"][name]) for name in STAR_TABLES}


class Snapshot:
    """A star version in the making. Nothing is visible to readers until ``commit``.

    Tables are stored in parts. A commit record names the path and the rows of every part, so a load writes the parts that
    its batch touches and the record goes on naming the others where earlier loads left them. It also names the largest key.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root
        self.base = current_commit(spark, root)
        self.path = f"{root}/versions/{uuid.uuid4().hex}"
        self.tables = dict(self.base["tables"]) if self.base else {}

    def read(self, name: str, wanted: Collection[int] | None = None) -> DataFrame | None:
        """The table as last written here or published before, or some of its parts; None before the first load."""
        return _read_parts(self.spark, name, self.tables[name], wanted) if name in self.tables else None

    def parts(self, name: str) -> int:
        return self.tables[name]["parts"] if name in self.tables else 0

    def rows(self, name: str) -> int:
        return sum(part["rows"] for part in self.tables[name]["paths"].values()) if name in self.tables else 0

    def top(self, name: str) -> int | None:
        """The largest surrogate key, without a look at the table."""
        return self.tables[name]["top"] if name in self.tables else None

    def write(
        self, name: str, df: DataFrame, part: Column | None = None, parts: int = 1, replaced: Collection[int] | None = None
    ) -> DataFrame:
        """Write the table, or instead of the ``replaced`` parts the rows that now belong to them; returns what was written.

        Rebalancing brings a part's rows together and splits a part that holds far more than others, so no task writes a hot key alone.
        """
        schema, path = STAR_SCHEMAS[name], f"{self.path}/{name}"
        rows = df.select(*schema.names)
        if part is not None:
            rows = rows.withColumn("_part", part).hint("rebalance", "_part")
        else:
            rows = rows.withColumn("_part", F.lit(0))
        rows.write.mode("errorifexists").partitionBy("_part").parquet(path)
        key = SURROGATE.get(name, "FactKey")
        written = self.spark.read.schema(StructType([*schema.fields, StructField("_part", IntegerType())])).parquet(path)
        # One row for each part written.
        found = written.groupBy("_part").agg(F.count("*").alias("rows"), F.max(key).alias("top")).collect()
        kept = {} if replaced is None else {n: p for n, p in self.tables[name]["paths"].items() if int(n) not in replaced}
        made = {str(r["_part"]): {"path": f"{path}/_part={r['_part']}", "rows": r["rows"]} for r in found}
        tops = [r["top"] for r in found if r["top"] is not None] + [0 if replaced is None else self.tables[name]["top"]]
        self.tables[name] = {"parts": parts, "top": max(tops), "paths": {**kept, **made}}
        return _read_parts(self.spark, name, self.tables[name], {int(n) for n in made})

    def commit(self, streams: Mapping[str, int] | None = None) -> None:
        """Make the version current by creating the next commit record, which must not exist yet."""
        number = (self.base["number"] if self.base else 0) + 1
        applied = {**(self.base["streams"] if self.base else {}), **(streams or {})}
        record = {"number": number, "path": self.path, "tables": self.tables, "streams": applied}
        _put(self.spark, f"{self.root}/commits/{number:010d}.json", json.dumps(record))


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete parts of star versions, and staging batches, that none of the last ``keep`` records names.

    Returns the versions and batches that are gone altogether. Readers of a deleted part fail, so call it when no query of an
    older snapshot runs, and while no load runs: a version in the making has no record yet.
    """
    named, dropped = set(), []
    for name in _records(spark, f"{root}/commits")[-keep:]:
        for entry in json.loads(_get(spark, f"{root}/commits/{name}"))["tables"].values():
            named.update("/".join(part["path"].split("/")[-3:]) for part in entry["paths"].values())
    for name in _records(spark, f"{root}/staging/records")[-keep:]:
        named.add(_get(spark, f"{root}/staging/records/{name}").rsplit("/", 1)[-1])

    def children(path: str) -> list[str]:
        fs, folder = filesystem(spark, path)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def drop(path: str) -> None:
        fs, folder = filesystem(spark, path)
        fs.delete(folder, True)

    for version in children(f"{root}/versions"):
        held = [f"{version}/{table}/{part}" for table in children(f"{root}/versions/{version}") for part in children(f"{root}/versions/{version}/{table}")]
        if not named.intersection(held):
            drop(f"{root}/versions/{version}")
            dropped.append(version)
            continue
        for part in held:
            if "/_part=" in part and part not in named:
                drop(f"{root}/versions/{part}")
    for batch in children(f"{root}/staging"):
        if batch not in named and batch != "records":
            drop(f"{root}/staging/{batch}")
            dropped.append(batch)
    return dropped


def publish(spark: SparkSession, snapshot: Mapping[str, DataFrame], root: str) -> None:
    """Write all five tables, then make them current together; a failure leaves the old star visible."""
    missing = set(STAR_TABLES) - set(snapshot)
    if missing:
        raise ValueError(f"snapshot lacks {sorted(missing)}")
    version = Snapshot(spark, root)
    for name in STAR_TABLES:
        version.write(name, snapshot[name])
    version.commit()


def register_star(spark: SparkSession, root: str, as_of: dt.date) -> None:
    """Expose the current snapshot as five views; the fact view carries TenureDays."""
    for name, table in (read_star(spark, root) or {}).items():
        view = with_tenure(table, as_of) if name == "Fact_HR" else table
        view.createOrReplaceTempView(name)

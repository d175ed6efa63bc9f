"""Cleaning steps for a raw batch, in the order ``clean`` applies them, and typing to staging."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffmart.functions.dates import date_text, read_date_text
from staffmart.functions.text import strip_text, tokens_to_null
from staffmart.schema import (
    DATE_HEADERS,
    INDEX_HEADERS,
    RENAMES,
    STAGING_MAX_LENGTH,
    STAGING_SCHEMA,
    TEXT_NULL_TOKENS,
)

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


class StagingError(ValueError):
    """The batch does not have the shape of the staging table."""


def quoted(name: str) -> Column:
    """Column by its verbatim name (raw headers hold blanks, dots and brackets)."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_columns(df: DataFrame, change, wanted) -> DataFrame:
    """One projection that applies ``change`` to the fields ``wanted`` accepts."""
    return df.select(
        *[
            (change(quoted(f.name)) if wanted(f) else quoted(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def drop_if_present(df: DataFrame, names: Iterable[str] = INDEX_HEADERS) -> DataFrame:
    return df.drop(*names)


def canonical_numbers(df: DataFrame) -> DataFrame:
    """Give texts of known numeric columns one spelling, so that ``1`` and ``1.0`` are equal."""
    numeric = {
        f.name for f in STAGING_SCHEMA.fields if isinstance(f.dataType, (T.IntegerType, T.DecimalType))
    }

    def spell(col: Column) -> Column:
        # Plain decimals are respelled as text, so no digit is lost; other notations keep their spelling.
        plain = F.regexp_replace(strip_text(col), r"^[+]|(?<=^-|^|^[+])0+(?=\d)", "")
        plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        plain = F.when(plain == "-0", "0").otherwise(plain)
        return F.when(strip_text(col).rlike(r"^[+-]?\d+(\.\d*)?$"), plain).otherwise(col)

    return map_columns(df, spell, lambda f: is_text(f) and RENAMES.get(f.name, f.name) in numeric)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row duplicates, NULL equal to NULL. Copies collapse map-side, before the shuffle."""
    return canonical_numbers(df).dropDuplicates()


def trim_text(df: DataFrame) -> DataFrame:
    return map_columns(df, strip_text, is_text)


def null_tokens(df: DataFrame, tokens: Iterable[str] = TEXT_NULL_TOKENS) -> DataFrame:
    return map_columns(df, lambda col: tokens_to_null(col, tokens), is_text)


def parse_dates(df: DataFrame, as_of: dt.date, names: Iterable[str] = DATE_HEADERS) -> DataFrame:
    """Day-first dates; two projections, so that the shape tests share one unified text."""
    wanted = {f.name for f in df.schema.fields if f.name in set(names) and is_text(f)}
    unified = map_columns(df, date_text, lambda f: f.name in wanted)
    return map_columns(unified, lambda col: read_date_text(col, as_of), lambda f: f.name in wanted)


def rename_to_staging(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RENAMES)


def nan_to_null(df: DataFrame) -> DataFrame:
    return map_columns(
        df,
        lambda col: F.when(~F.isnan(col), col),
        lambda f: isinstance(f.dataType, (T.FloatType, T.DoubleType)),
    )


def clean(df: DataFrame, as_of: dt.date) -> DataFrame:
    """All cleaning steps. Duplicates go first: rows that differ only by blanks both survive."""
    df = drop_exact_duplicates(drop_if_present(df))
    df = parse_dates(null_tokens(trim_text(df)), as_of)
    return nan_to_null(rename_to_staging(df))


def typed(col: Column, kind: T.DataType) -> Column:
    """Lenient conversion of one value; NULL where it does not fit the type."""
    if isinstance(kind, T.IntegerType):
        number = col.try_cast("double")
        return F.when(number.between(INT_MIN, INT_MAX), number.try_cast("int"))
    return col.try_cast(kind)


def judged(df: DataFrame) -> tuple[list[Column], Column]:
    """The typed columns of the staging layout, bound by name (missing -> NULL, unknown -> error), and the names of those, with
    commas between, whose value does not fit a row."""
    unknown = [name for name in df.columns if name not in STAGING_SCHEMA.names]
    if unknown:
        raise StagingError(f"columns unknown to staging: {unknown}")
    values, faults = [], []
    for field in STAGING_SCHEMA.fields:
        name = field.name
        if name not in df.columns:
            values.append(F.lit(None).cast(field.dataType).alias(name))
            continue
        value = typed(F.col(name), field.dataType)
        values.append(value.cast(field.dataType).alias(name))
        faults.append(F.when(misfit(name, F.col(name), value), F.lit(name)))
    return values, F.concat_ws(",", *faults)


def misfit(name: str, raw: Column, value: Column) -> Column:
    bad = raw.isNotNull() & value.isNull()
    if name in STAGING_MAX_LENGTH:
        bad = bad | (F.length(raw) > STAGING_MAX_LENGTH[name])
    return F.coalesce(bad, F.lit(False))


def cast_to_staging(df: DataFrame, mode: str = "fail"):
    """Bind by name to the staging layout.

    ``fail``: a value that does not fit stops the job. ``quarantine``: returns (good, rejected),
    the rejected rows in their original form with the names of the offending columns.
    """
    values, faults = judged(df)
    if mode == "quarantine":
        marked = df.withColumn("reject_reason", faults)
        return marked.where("reject_reason = ''").select(*values), marked.where("reject_reason <> ''")
    if mode != "fail":
        raise ValueError(f"unknown mode {mode!r}")

    def strict(field: T.StructField) -> Column:
        name = field.name
        if name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(name)
        value = typed(F.col(name), field.dataType)
        message = F.concat(F.lit(f"value does not fit {name}: "), F.col(name).cast("string"))
        checked = F.when(misfit(name, F.col(name), value), F.raise_error(message)).otherwise(value)
        return checked.cast(field.dataType).alias(name)

    return df.select(*[strict(field) for field in STAGING_SCHEMA.fields])

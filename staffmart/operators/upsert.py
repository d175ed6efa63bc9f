"""Merging a batch into a dimension with the semantics of a SQL MERGE."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.functions.text import exact
from staffmart.operators.joins import fits_broadcast, lookup, spread_out
from staffmart.operators.keys import allocate_keys
from staffmart.session import materialise


class DuplicateKeyError(ValueError):
    """A key that has to be unique is not."""


class AmbiguousMatchError(ValueError):
    """Several source rows match the same target row."""


def collapse_by_key(
    df: DataFrame,
    keys: Sequence[str],
    attributes: Sequence[str],
    match: Callable[[Column], Column] = exact,
) -> DataFrame:
    """One row per key with the maximum of every attribute on its own, NULLs ignored.

    Only the first key must be present; a NULL in a later key forms a group. Maxima are combined
    map-side, so a key that holds a third of the rows shuffles as one row per task. With ``match``
    folded, text keys group and text attributes compare by their folded form; a key is then
    represented by its smallest spelling.
    """
    present = df.where(F.col(keys[0]).isNotNull())
    if match is exact:
        return present.groupBy(*keys).agg(*[F.max(name).alias(name) for name in attributes])
    types = dict(df.dtypes)

    def largest(name: str) -> Column:
        col = F.col(name)
        found = F.max(F.struct(match(col).alias("f"), col.alias("v"))) if types[name] == "string" else F.max(col)
        return (found["v"] if types[name] == "string" else found).alias(name)

    groups = [match(F.col(k)).alias(f"_g_{k}") if types[k] == "string" else F.col(k).alias(f"_g_{k}") for k in keys]
    spelled = [F.min(k).alias(k) for k in keys]
    found = present.groupBy(*groups).agg(*spelled, *[largest(name) for name in attributes])
    return found.select(*keys, *attributes)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; NULL is a value like any other here."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    found = repeated_keys(df, keys).take(3)
    if found:
        raise DuplicateKeyError(f"{list(keys)} not unique, for example {found}")


def ambiguous_matches(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Keys with several source rows that exist in the target. A NULL key matches nothing."""
    repeated = repeated_keys(source.where(F.col(key).isNotNull()), [key])
    present = target.select(F.col(key).alias("_present")).distinct()
    return repeated.join(present, F.col(key) == F.col("_present"), "left_semi")


def assert_single_match(source: DataFrame, target: DataFrame, key: str) -> None:
    found = ambiguous_matches(source, target, key).take(3)
    if found:
        raise AmbiguousMatchError(f"several source rows match one target row, for example {found}")


def key_condition(target: DataFrame, keys: Sequence[str], null_safe: bool, match: Callable[[Column], Column]) -> list[Column]:
    """Equality of ``target``'s keys with those of a source whose columns are prefixed."""
    types = dict(target.dtypes)

    def matches(name: str) -> Column:
        left, right = F.col(name), F.col(f"_s_{name}")
        if types[name] == "string":
            left, right = match(left), match(right)
        return left.eqNullSafe(right) if null_safe else left == right

    return [matches(name) for name in keys]


def unmatched(
    target: DataFrame, source: DataFrame, keys: Sequence[str], null_safe: bool = False, match: Callable[[Column], Column] = exact
) -> DataFrame:
    """The rows of ``source`` whose keys ``target`` does not hold."""
    incoming = source.select(*[F.col(name).alias(f"_s_{name}") for name in source.columns])
    present = target.select(*keys)
    fresh = incoming.join(present if fits_broadcast(present) else spread_out(present), key_condition(target, keys, null_safe, match), "left_anti")
    return fresh.select(*[F.col(f"_s_{name}").alias(name) for name in source.columns])


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    surrogate: str,
    update: Sequence[str] = (),
    null_safe: bool = False,
    match: Callable[[Column], Column] = exact,
    top: int | None = None,
) -> DataFrame:
    """Update ``update`` columns of matched rows, insert unmatched source rows under new surrogate keys.

    ``source`` has the columns of ``target`` without ``surrogate`` and unique ``keys``. A NULL in the
    source overwrites. Target rows without a match stay as they are; with no ``update`` columns all
    of them do. Keys compare null-unsafe, so a key with a NULL part is inserted again by every load
    unless ``null_safe``. ``match`` says what counts as the same text key. ``top`` is the largest
    surrogate key where ``target`` is only a part of its table.
    """
    columns = target.columns
    kept, small = target, fits_broadcast(source)
    if update:
        wanted = [F.col(name).alias(f"_s_{name}") for name in (*keys, *update)]
        marked = source.select(*wanted).withColumn("_matched", F.lit(True))
        kept = target.join(marked if small else spread_out(marked), key_condition(target, keys, null_safe, match), "left").select(
            *[
                F.when(F.col("_matched"), F.col(f"_s_{name}")).otherwise(F.col(name)).alias(name)
                if name in update
                else F.col(name)
                for name in columns
            ]
        )
    fresh = unmatched(target, source, keys, null_safe, match)
    if not small:
        fresh = materialise(fresh, "fresh")  # read twice: to count and to number
    fresh = allocate_keys(fresh, surrogate, keys, existing=target, small=small, top=top)
    return kept.unionByName(fresh.select(*columns))


def upsert_many(
    target: DataFrame, source: DataFrame, key: str, update: Sequence[str], small: bool = False
) -> DataFrame:
    """Update every target row of a matched key (several rows may share it); nothing is inserted.

    ``source`` may repeat keys that the target does not hold; those rows collapse before the join.
    """
    one = (
        source.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.struct(*update)).alias("_new"))
    )
    joined = lookup(target, one, [(key, "_key")], "left", small=small)
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name)
            if name in update
            else F.col(name)
            for name in target.columns
        ]
    )

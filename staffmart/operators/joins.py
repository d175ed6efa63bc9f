"""Joins of a large, possibly skewed left side against a right side with unique keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from staffmart.session import materialise

# A right side of at most this many bytes is broadcast; its size is looked up, never assumed.
BROADCAST_BYTES = 10 * 1024 * 1024
# Files this many times below the bound need no look at their rows.
COMPRESSION = 32
# Left rows of one key meant for a task. Keys with more are dealt over as many tasks as their count asks for.
ROWS_PER_TASK = 1 << 19


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is small enough to be sent to every task, by the optimizer's statistics and the number of stored rows.

    For a stored table the statistics give the size of its files, which compression can make many times smaller than the rows.
    So where that size could mislead, the rows are counted, from the files' footers, and taken at the width of their types.
    Above a join or an aggregation the statistics are an overestimate, so a side of unknown size is never taken for small.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size > max_bytes or size * COMPRESSION <= max_bytes or plan.collectLeaves().size() != 1 or not df.inputFiles():
        return size <= max_bytes
    return df.count() * df._jdf.schema().defaultSize() <= max_bytes


def spread_out(df: DataFrame) -> DataFrame:
    """A join side that the planner, which goes by the size of files, must not broadcast: both sides are dealt by key and sorted."""
    return df.hint("merge")


def all_present(columns: Sequence[str]) -> Column:
    present = F.lit(True)
    for name in columns:
        present = present & F.col(name).isNotNull()
    return present


def stable_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """A hash that keys equal in a join share; what else shares it costs a little work and changes nothing.

    Spark's hash functions see the bytes of a text. Texts under another collation are reduced to the lower-case ASCII letters in
    them first, on which all spellings of one key agree.
    """

    def plain(name: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, StringType) and kind.collation != "UTF8_BINARY":
            return F.regexp_replace(F.lower(F.rtrim(F.collate(F.col(name), "UTF8_BINARY"))), r"[^\x00-\x7f]", "")
        return F.col(name)

    return F.xxhash64(*[plain(name) for name in keys])


def hot_keys(df: DataFrame, lookups: Mapping[str, Sequence[str]], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(lookup, hash, salts): the frequent keys of several lookups, counted in one scan and stored.

    A key with more than ``rows_per_task`` rows gets a salt for each such share of them, so there are at most as many hot keys as
    such shares in the table; if even those would not be broadcast, the shares are made larger until they are.
    """
    marks = F.array(*[F.struct(F.lit(name).alias("lookup"), stable_hash(df, keys).alias("hash")) for name, keys in lookups.items()])
    counted = df.select(F.explode(marks).alias("m")).groupBy("m.lookup", "m.hash").agg(F.count(F.lit(1)).alias("n"))
    hot = materialise(counted.where(F.col("n") > rows_per_task), "hot-keys")
    while not fits_broadcast(hot):
        rows_per_task *= 16
        hot = materialise(hot.where(F.col("n") > rows_per_task), "hot-keys")
    return hot.select("lookup", "hash", F.ceil(F.col("n") / rows_per_task).cast("int").alias("salts"))


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    how: str = "left",
    small: bool | None = None,
    hot_from: DataFrame | None = None,
    hot: DataFrame | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Equi-join ``left`` to ``right``, whose keys are unique; the right key columns are dropped.

    ``how`` is left, inner, left_semi or left_anti. NULL keys match nothing. A right side within the
    broadcast bound is broadcast (``small`` passes on a check already made). Beyond it both sides
    shuffle, and no key can flood a task: rows of a frequent key, those without a key included, carry one of as many salts as
    the key's count asks for, and the right row of such a key is repeated once per salt.
    ``hot`` holds the frequent keys (hash, salts); else they are counted, on ``hot_from`` if that is a cheaper table with the same
    key columns.
    """
    left_keys = [l for l, _ in on]
    renamed = {r: f"_right_{i}" for i, (_, r) in enumerate(on)}
    right_keys = list(renamed.values())
    if small is None:
        small = fits_broadcast(right)
    right = right.withColumnsRenamed(renamed)
    condition = [F.col(l) == F.col(r) for l, r in zip(left_keys, right_keys)]
    if small:
        return left.join(F.broadcast(right), condition, how).drop(*right_keys)

    if hot is None:
        hot = hot_keys(left if hot_from is None else hot_from, {"": left_keys}, rows_per_task or ROWS_PER_TASK)
    # Salts of a key on both sides; a key that is not hot has the one salt 0.
    hot = F.broadcast(hot.select(F.col("hash").alias("_hash"), F.col("salts").alias("_salts")))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), salts).cast("int")
    salted_left = left.withColumn("_hash", stable_hash(left, left_keys)).join(hot, "_hash", "left")
    salted_left = salted_left.withColumn("_salt", spread).drop("_hash", "_salts")
    salted_right = right.withColumn("_hash", stable_hash(right, right_keys)).join(hot, "_hash", "left")
    salted_right = salted_right.withColumn("_right_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hash", "_salts")
    condition.append(F.col("_salt") == F.col("_right_salt"))
    return salted_left.join(spread_out(salted_right), condition, how).drop("_salt", "_right_salt", *right_keys)

"""Date column functions. Everything that depends on "today" takes ``as_of`` explicitly."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes, once separators are unified to "-", and their readings in order of
# preference: day before month, and the swapped reading where the first one is no date.
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ("yyyy-M-d", "yyyy-d-M")),
    (r"^\d{8}$", ("yyyyMMdd",)),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("d-M-yyyy", "M-d-yyyy")),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", ("d-M-yy", "M-d-yy")),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", ("d-MMM-yy",)),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", ("d-MMM-yyyy",)),
    (r"^\d{1,2}-[A-Za-z]{4,}-\d{2}$", ("d-MMMM-yy",)),
    (r"^\d{1,2}-[A-Za-z]{4,}-\d{4}$", ("d-MMMM-yyyy",)),
    (r"^[A-Za-z]{3}-\d{1,2}-\d{4}$", ("MMM-d-yyyy",)),
    (r"^[A-Za-z]{4,}-\d{1,2}-\d{4}$", ("MMMM-d-yyyy",)),
    (r"^[A-Za-z]{3}-\d{1,2}-\d{2}$", ("MMM-d-yy",)),
    (r"^\d{4}-[A-Za-z]{3}-\d{1,2}$", ("yyyy-MMM-d",)),
    (r"^\d{4}-[A-Za-z]{4,}-\d{1,2}$", ("yyyy-MMMM-d",)),
    (r"^\d{4}-[A-Za-z]{3}$", ("yyyy-MMM",)),
    (r"^\d{4}-[A-Za-z]{4,}$", ("yyyy-MMMM",)),
    (r"^[A-Za-z]{3}-\d{4}$", ("MMM-yyyy",)),
    (r"^[A-Za-z]{4,}-\d{4}$", ("MMMM-yyyy",)),
    (r"^\d{4}-\d{1,2}$", ("yyyy-M",)),
    (r"^\d{1,2}-\d{4}$", ("M-yyyy",)),
    (r"^\d{4}$", ("yyyy",)),
)

# The days that nanoseconds in 64 bits can hold; others count as unreadable.
FIRST_DAY, LAST_DAY = dt.date(1677, 9, 22), dt.date(2262, 4, 11)


def date_text(col: Column) -> Column:
    """The text without weekday, ordinal ending and time of day, and with "-" as the only separator."""
    plain = F.regexp_replace(F.trim(col), r"(?i)^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?[., ]+", "")
    plain = F.regexp_replace(plain, r"^\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?[ ,]+", "")
    # A time without colons after a whole date.
    plain = F.regexp_replace(plain, r"(?<=^\d{8})[T ]\d{2}(\d{2}){0,2}$|(?<=^\d{4}[-/.]\d{1,2}[-/.]\d{1,2})[T ]\d{1,2}$", "")
    plain = F.regexp_replace(plain, r"(?i)([T ]\d{1,2}:\d{2}.*| \d{1,2} ?[ap]\.?m\.?)$", "")
    plain = F.regexp_replace(plain, r"(?i)(?<=\d)(st|nd|rd|th)(?![a-z])", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?i) of (?=[a-z])", " "), r"(?<=\d)(?=[A-Za-z]{3})|(?<=[A-Za-z]{3})(?=\d)", "-")
    return F.regexp_replace(F.regexp_replace(plain, r"(?i)\bsept\b", "Sep"), r"[/., -]+", "-")


def read_date_text(unified: Column, as_of: dt.date) -> Column:
    """Date of a ``date_text``. A shape test picks the one or two readings to try: a failing parse
    raises and catches an exception inside the JVM, which would dominate a chain of attempts."""
    parsed = F.lit(None).cast("date")
    for shape, readings in reversed(DATE_SHAPES):
        attempts = F.coalesce(*[F.try_to_date(unified, reading) for reading in readings])
        parsed = F.when(unified.rlike(shape), attempts).otherwise(parsed)
    quarter = F.make_date(F.substring(unified, 1, 4).try_cast("int"), F.substring(unified, -1, 1).try_cast("int") * 3 - 2, F.lit(1))
    parsed = F.when(unified.rlike(r"^[0-9]{4}-?[Qq][1-4]$"), quarter).otherwise(parsed)
    parsed = F.when(parsed.between(F.lit(FIRST_DAY), F.lit(LAST_DAY)), parsed)
    two_digit_year = unified.rlike(r"^[^-]+-[^-]+-\d{2}$")
    century = F.lit(dt.date(as_of.year + 50, 1, 1))
    return F.when(two_digit_year & (parsed >= century), F.add_months(parsed, -1200)).otherwise(parsed)


def parse_date_dayfirst(col: Column, as_of: dt.date) -> Column:
    """Parse texts of mixed shapes, day first where both readings are possible; unreadable -> NULL.

    Two-digit years land in the window [as_of - 50, as_of + 50) years.
    """
    return read_date_text(date_text(col), as_of)


def age_years(born: Column, as_of: dt.date) -> Column:
    """Number of year boundaries between birth and ``as_of`` (not completed years)."""
    return F.lit(as_of.year) - F.year(born)


def tenure_days(start: Column, exit_: Column, as_of: dt.date) -> Column:
    """Days from start to exit, or to ``as_of`` while there is no exit."""
    return F.datediff(F.coalesce(exit_, F.lit(as_of)), start)

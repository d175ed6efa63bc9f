import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from staffmart.functions.dates import age_years, parse_date_dayfirst
from staffmart.functions.text import WHITESPACE, full_name, strip_fences
from staffmart.operators.cleaning import (
    StagingError,
    cast_to_staging,
    clean,
    drop_exact_duplicates,
    drop_if_present,
    nan_to_null,
    null_tokens,
    trim_text,
)
from staffmart.operators.profile import future_births, is_loadable, preview, profile
from staffmart.sources.csv import read_batch
from staffmart.sources.warehouse import read_staging, write_staging


def csv(tmp_path, text):
    path = os.path.join(tmp_path, "batch.csv")
    with open(path, "w", encoding="utf8") as f:
        f.write(text)
    return path


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


DATES = [
    ("2023-02-01", "2023-02-01"), ("2023/02/01", "2023-02-01"), ("20230201", "2023-02-01"),
    ("01/02/2023", "2023-02-01"), ("1.2.2023", "2023-02-01"), ("13/02/2023", "2023-02-13"),
    ("02/13/2023", "2023-02-13"), ("2023-02-01 10:11:12", "2023-02-01"),
    ("2023-02-01T10:11", "2023-02-01"), ("garbage", None), ("", None), (None, None),
    ("32/01/2023", None), ("45000", None), ("20-Sep-19", "2019-09-20"), ("07-10-2022", "2022-10-07"),
    ("7/1/22", "2022-01-07"), ("March 5, 2021", "2021-03-05"), ("2023-13-01", "2023-01-13"),
    ("2023", "2023-01-01"), ("12/2023", "2023-12-01"), ("07-10-75", "2075-10-07"),
    ("20-Sep-75", "2075-09-20"), ("07-10-76", "1976-10-07"), ("20-Sep-76", "1976-09-20"),
    ("07-10-80", "1980-10-07"), ("07-10-69", "2069-10-07"),
]


def test_dates(spark, as_of):
    df = spark.createDataFrame([t for t in enumerate(d for d, _ in DATES)], "i int, written string")
    found = df.select("i", parse_date_dayfirst(F.col("written"), as_of).alias("day")).orderBy("i").collect()
    expected = [d and dt.date.fromisoformat(d) for _, d in DATES]
    assert [r["day"] for r in found] == expected


def test_index_column_goes_before_duplicates(spark, tmp_path):
    for header in ("Unnamed: 0", ""):
        raw = read_batch(spark, csv(tmp_path, f"{header},Employee ID,Title\n0,1,A\n1,1,A\n"))
        assert drop_exact_duplicates(drop_if_present(raw)).count() == 1


def test_rows_that_differ_by_blanks_both_survive(spark, tmp_path, as_of):
    raw = read_batch(spark, csv(tmp_path, "Employee ID,FirstName\n1,Ann\n1, Ann\n1.0,Ann\n"))
    assert [tuple(r) for r in clean(raw, as_of).collect()] == [("1", "Ann")] * 2


def test_trim_and_tokens(spark, tmp_path):
    raw = read_batch(spark, csv(tmp_path, 'a,b\n"\tAnn ",NaT\n"  ",N/A\nNone,NAT\n'))
    found = null_tokens(trim_text(raw)).collect()
    assert [tuple(r) for r in found] == [("Ann", None), (None, None), (None, "NAT")]


def test_quotes_line_breaks_and_verbatim_headers(spark, tmp_path):
    text = 'Training Duration(Days),a.b\n3,"x, ""y""\nz"\n'
    raw = read_batch(spark, csv(tmp_path, text), multiline=True)
    assert raw.columns == ["Training Duration(Days)", "a.b"]
    assert [tuple(r) for r in raw.collect()] == [("3", 'x, "y"\nz')]
    assert trim_text(raw).columns == raw.columns


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, y int")
    assert [r["x"] for r in nan_to_null(df).orderBy("y").collect()] == [None, 2.0]


def test_profile_before_and_after_cleaning(spark, tmp_path, as_of):
    raw = read_batch(spark, csv(tmp_path, "Employee ID,ExitDate\n1,garbage\n2,\n3,2020-01-01\n"))
    assert tuple(profile(raw).first()) == (3, 2, 1, 2)
    assert tuple(profile(clean(raw, as_of)).first()) == (3, 2, 2, 1)


def test_births_in_the_future_are_counted(spark, tmp_path, as_of):
    raw = read_batch(spark, csv(tmp_path, "DOB\n07-10-69\n07-10-80\ngarbage\n"))
    assert future_births(clean(raw, as_of), as_of).first()[0] == 1


def test_preview_and_gate(spark, tmp_path):
    raw = read_batch(spark, csv(tmp_path, "a\n3\n1\n2\n"))
    assert [r[0] for r in preview(raw, 2).collect()] == ["1", "2"]
    assert is_loadable(raw)
    assert not is_loadable(read_batch(spark, csv(tmp_path, "a\n")))


def test_staging_binds_by_name(spark, root):
    df = spark.createDataFrame([("7.0", "12.345", "x")], "Employee_ID string, Training_Cost string, Title string")
    row = write_staging(df, root).first()
    assert (row["Employee_ID"], str(row["Training_Cost"]), row["Title"], row["State"]) == (7, "12.35", "x", None)
    assert read_staging(spark, root).count() == 1
    with pytest.raises(StagingError):
        cast_to_staging(df.withColumn("Salary", F.lit(1)))


@pytest.mark.parametrize(
    "column, value", [("LocationCode", "abc"), ("LocationCode", "99999999999"), ("PayZone", "x" * 51)]
)
def test_bad_values_fail_or_are_quarantined(spark, root, column, value):
    df = spark.createDataFrame([(value,), ("1",)], f"{column} string")
    write_staging(df.where(f"{column} = '1'"), root)
    with pytest.raises(Exception, match=f"does not fit {column}"):
        write_staging(df, root)
    assert read_staging(spark, root).count() == 1  # the previous batch is still there
    good, rejected = cast_to_staging(df, "quarantine")
    assert good.count() == 1
    assert [tuple(r) for r in rejected.collect()] == [(value, column)]


def test_names_ages_and_fences(spark):
    row = spark.range(1).select(
        full_name(F.lit(None).cast("string"), F.lit("Lee")).alias("name"),
        age_years(F.lit(dt.date(2000, 12, 31)), dt.date(2026, 1, 1)).alias("age"),
        strip_fences(F.lit("```sql\nSELECT 1\n```")).alias("sql"),
    ).first()
    assert tuple(row) == (" Lee", 26, "SELECT 1")


@pytest.mark.parametrize(
    "text, day",
    [
        ("2023-02", dt.date(2023, 2, 1)),
        ("Mar 2021", dt.date(2021, 3, 1)),
        ("March 2021", dt.date(2021, 3, 1)),
        ("Sept 5 2021", dt.date(2021, 9, 5)),
        ("Fri, 5 Mar 2021", dt.date(2021, 3, 5)),
        ("5th March 2021", dt.date(2021, 3, 5)),
        ("Mar 5, 21", dt.date(2021, 3, 5)),
        ("2021 Mar 5", dt.date(2021, 3, 5)),
        ("2021-Mar-05", dt.date(2021, 3, 5)),
        ("1/2/2023 3 pm", dt.date(2023, 2, 1)),
        ("1 August 2021", dt.date(2021, 8, 1)),
        ("Friday", None),
        ("20210305 101500", dt.date(2021, 3, 5)),
        ("20210305T101500", dt.date(2021, 3, 5)),
        ("20210305T10", dt.date(2021, 3, 5)),
        ("5Mar2021", dt.date(2021, 3, 5)),
        ("05MAR2021", dt.date(2021, 3, 5)),
        ("5Mar21", dt.date(2021, 3, 5)),
        ("Mar2021", dt.date(2021, 3, 1)),
        ("5 of March 2021", dt.date(2021, 3, 5)),
        ("5th of March, 2021", dt.date(2021, 3, 5)),
        ("2021 March", dt.date(2021, 3, 1)),
        ("2021 Mar", dt.date(2021, 3, 1)),
        ("10:20 05/03/2021", dt.date(2021, 3, 5)),
        ("10:20:11 5 March 2021", dt.date(2021, 3, 5)),
        ("2021-03-05 10", dt.date(2021, 3, 5)),
        ("2021-03-05T10", dt.date(2021, 3, 5)),
        ("2021Q1", dt.date(2021, 1, 1)),
        ("2021-q3", dt.date(2021, 7, 1)),
        ("1/1/0001", None),
        ("1/1/1500", None),
        ("5/3/2300", None),
        ("21/9/1677", None),
        ("22/9/1677", dt.date(1677, 9, 22)),
        ("11/4/2262", dt.date(2262, 4, 11)),
        ("12/4/2262", None),
    ],
)
def test_more_date_shapes(spark, as_of, text, day):
    plain = pd.to_datetime(pd.Series([text]), dayfirst=True, errors="coerce", format="mixed")[0]
    assert text == "Friday" or (None if pd.isna(plain) else plain.date()) == day
    assert spark.range(1).select(parse_date_dayfirst(F.lit(text), as_of)).first()[0] == day


def test_numbers_keep_all_their_digits(spark):
    texts = ["1.00000000001", "1.00000000002", "1", "1.0", "+01.", "-0", "0.0", "1e3", "x", None, "10", "1" * 60]
    rows = spark.createDataFrame([(t,) for t in texts], "`Training Cost` string")
    found = {r[0] for r in drop_exact_duplicates(rows).collect()}
    assert found == {"1.00000000001", "1.00000000002", "1", "0", "1e3", "x", None, "10", "1" * 60}


def test_files_with_other_column_orders_meet_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("FirstName,LastName\nBob,Kim\n")
    (tmp_path / "b.csv").write_text("LastName,FirstName,Title\nLee,Ann,T\n")
    found = read_batch(spark, str(tmp_path)).select("FirstName", "LastName", "Title").collect()
    assert {tuple(r) for r in found} == {("Bob", "Kim", None), ("Ann", "Lee", "T")}


def test_quoted_line_breaks_are_never_torn(spark, tmp_path):
    (tmp_path / "a.csv").write_text('FirstName,Title\nBob,"left\nfor good"\n')
    with pytest.raises(Exception, match="quoted line break"):
        read_batch(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in read_batch(spark, str(tmp_path), multiline=True).collect()] == [("Bob", "left\nfor good")]

import datetime as dt

import pytest
from pyspark.sql import functions as F

from staffmart.operators.fact import attrition_flag, with_tenure
from staffmart.operators.keys import allocate_keys
from staffmart.operators.upsert import (
    AmbiguousMatchError,
    DuplicateKeyError,
    assert_unique,
    collapse_by_key,
)
from staffmart.plans.adhoc import RefusedStatement, run_sql
from staffmart.plans.star import load_csv, load_star
from staffmart.sources.warehouse import (
    PublishConflict,
    Snapshot,
    current_commit,
    drop_old_versions,
    publish,
    read_staging,
    read_star,
    read_table,
    write_staging,
)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def person(id_, **more):
    return {"Employee_ID": id_, "EmployeeStatus": "Active", **more}


def test_maximum_is_taken_per_column(spark, staging, root, as_of):
    batch = staging(person(1, FirstName="B", LastName="A"), person(1, FirstName="A", LastName="B"))
    star = load_star(spark, batch, root, as_of)
    found = star["Dim_Employee"].where("EmployeeKey > 0")
    assert rows(found, "EmployeeKey", "EmployeeID", "FullName") == [(1, 1, "B B")]
    assert star["Fact_HR"].count() == 2  # a new id may repeat


def test_employee_update_list(spark, staging, root, as_of):
    load_star(spark, staging(person(1, GenderCode="F", MaritalDesc="Single"), person(2)), root, as_of)
    star = load_star(spark, staging(person(1, GenderCode="M"), person(3)), root, as_of)
    found = star["Dim_Employee"].where("EmployeeID = 1")
    assert rows(found, "EmployeeKey", "Gender", "MaritalStatus")[0][1:] == ("F", None)
    first = {r["EmployeeID"]: r["EmployeeKey"] for r in star["Dim_Employee"].collect()}
    assert sorted(first) == [-1, 1, 2, 3] and first[3] == 3 and {first[1], first[2]} == {1, 2}
    assert star["Fact_HR"].count() == 3  # an employee missing from a batch stays


def test_location_and_training_never_change(spark, staging, root, as_of):
    load_star(
        spark,
        staging(person(1, LocationCode=5, State="A", Training_Program_Name="P", Trainer="T", Training_Type="x")),
        root,
        as_of,
    )
    star = load_star(
        spark,
        staging(person(1, LocationCode=5, State="B", Training_Program_Name="P", Trainer="T", Training_Type="y")),
        root,
        as_of,
    )
    assert rows(star["Dim_Location"], "LocationKey", "State") == [(-1, "Unknown State"), (1, "A")]
    assert rows(star["Dim_Training"], "TrainingKey", "TrainingType") == [(-1, "N/A"), (1, "x")]


@pytest.mark.parametrize("null_safe, copies", [(False, 2), (True, 1)])
def test_null_part_of_a_key(spark, staging, root, as_of, null_safe, copies):
    for _ in range(2):
        star = load_star(spark, staging(person(1, Title="T")), root, as_of, null_safe=null_safe)
    assert star["Dim_Job"].where("Title = 'T' and Department is null").count() == copies
    assert rows(star["Fact_HR"], "JobKey") == [(1,) if null_safe else (-1,)]


def test_folded_keys_match_whatever_their_case(spark, staging, root, as_of):
    rows_of = [("Analyst", "Sales", "Active"), ("ANALYST ", "sales", "active"), ("clerk", "Sales", "Left")]
    batch = staging(
        *[
            person(i, Title=t, DepartmentType=d, EmployeeStatus=s, BusinessUnit=t[0])
            for i, (t, d, s) in enumerate(rows_of)
        ]
    )
    star = load_star(spark, batch, root, as_of, fold_case=True)
    star = load_star(spark, batch, root, as_of, fold_case=True)
    jobs = star["Dim_Job"].where("JobKey > 0")
    assert {r[1:] for r in rows(jobs, "JobKey", "Title", "Department")} == {("ANALYST ", "Sales"), ("clerk", "Sales")}
    found = {r["EmployeeID"]: (r["JobKey"], r["AttritionFlag"]) for r in star["Fact_HR"].collect()}
    assert found[0] == found[1] and found[0][1] == 0 and found[2][0] != found[0][0] and found[2][1] == 1


def test_fact_update_list(spark, staging, root, as_of):
    load_star(spark, staging(person(1, Title="A", DepartmentType="D", Engagement_Score=1, PayZone="X")), root, as_of)
    later = dt.date(2026, 2, 1)
    star = load_star(
        spark,
        staging(
            person(1, Title="B", DepartmentType="D", Engagement_Score=5, PayZone="Y", EmployeeStatus=None)
        ),
        root,
        later,
    )
    found = star["Fact_HR"].first()
    assert (found["FactKey"], found["JobKey"], found["EngagementScore"]) == (1, 1, 1)
    assert (found["PayZone"], found["AttritionFlag"], found["EmployeeStatus"]) == ("Y", 1, None)
    assert found["LastUpdateDate"].date() == later
    assert star["Dim_Job"].count() == 3


def test_rows_without_id_are_inserted_again(spark, staging, root, as_of):
    for _ in range(2):
        star = load_star(spark, staging({"Title": "T"}, person(1)), root, as_of)
    found = star["Fact_HR"].where("EmployeeID is null")
    assert rows(found, "EmployeeKey", "AttritionFlag") == [(-1, 1), (-1, 1)]
    assert rows(star["Fact_HR"], "FactKey") == [(1,), (2,), (3,)]


def test_repeated_known_id_fails_and_changes_nothing(spark, staging, root, as_of):
    batch = staging(person(1, PayZone="A"), person(1, PayZone="B"))
    load_star(spark, batch, root, as_of)
    before = current_commit(spark, root)
    with pytest.raises(AmbiguousMatchError):
        load_star(spark, batch, root, as_of)
    assert current_commit(spark, root) == before
    # one source row may update several target rows
    star = load_star(spark, staging(person(1, PayZone="C")), root, as_of)
    assert rows(star["Fact_HR"], "PayZone") == [("C",), ("C",)]


def test_reload_changes_nothing_but_the_audit_time(spark, staging, root, as_of):
    batch = staging(*[person(i, Title=f"T{i % 3}", DepartmentType="D", LocationCode=i % 4) for i in range(40)])
    first = load_star(spark, batch, root, as_of)
    second = load_star(spark, batch, root, as_of)
    for name in first:
        assert rows(first[name], *first[name].columns) == rows(second[name], *second[name].columns)


def test_every_fact_key_resolves(spark, staging, root, as_of):
    batch = staging(*[person(i, Title="T", LocationCode=i % 4 or None) for i in range(20)], {"Title": "x"})
    star = load_star(spark, batch, root, as_of)
    for dim, key in (("Dim_Employee", "EmployeeKey"), ("Dim_Job", "JobKey"), ("Dim_Location", "LocationKey")):
        assert star["Fact_HR"].join(star[dim], key, "left_anti").count() == 0


def test_identity_key_of_the_unknown_employee(spark, staging, root, as_of):
    star = load_star(spark, staging(person(7)), root, as_of, reference_employee_key=True)
    assert rows(star["Dim_Employee"], "EmployeeKey", "EmployeeID") == [(1, -1), (2, 7)]


def test_attrition_flag(spark):
    df = spark.createDataFrame([("Active",), ("Leave of Absence",), (None,)], "s string")
    assert [r[0] for r in df.select(attrition_flag(F.col("s"))).collect()] == [0, 1, 1]


def test_tenure_grows_until_exit(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), None)], "StartDate date, ExitDate date")
    days = [with_tenure(df, dt.date(2026, 1, d)).first()["TenureDays"] for d in (15, 16)]
    assert days == [14, 15]


def test_keys_have_no_gaps_and_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).selectExpr("id % 4001 as a", "cast(id as string) as b")
    once = allocate_keys(df.repartition(1), "k", ["a", "b"])
    again = allocate_keys(df.repartition(7), "k", ["a", "b"])
    found = rows(once, "k", "a", "b")
    assert found == rows(again, "k", "a", "b")
    assert sorted(r[0] for r in found) == list(range(1, 5001))
    more = allocate_keys(df.limit(10), "k", ["a", "b"], existing=once)
    assert sorted(r["k"] for r in more.collect()) == list(range(5001, 5011))


def test_uniqueness_check(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    with pytest.raises(DuplicateKeyError):
        assert_unique(df, ["a"])
    assert_unique(df.distinct(), ["a"])


def test_collapse_ignores_nulls(spark):
    df = spark.createDataFrame([("k", None, "x"), ("k", "d", None), (None, "d", "z")], "a string, b string, c string")
    assert rows(collapse_by_key(df, ["a"], ["b", "c"]), "a", "b", "c") == [("k", "d", "x")]


def test_publish_is_all_or_nothing(spark, staging, root, as_of):
    star = load_star(spark, staging(person(1)), root, as_of)
    broken = dict(star)
    broken["Fact_HR"] = star["Fact_HR"].withColumn("PayZone", F.raise_error(F.lit("disk gone")).cast("string"))
    with pytest.raises(Exception, match="disk gone"):
        publish(spark, broken, root)
    assert current_commit(spark, root)["number"] == 1
    publish(spark, star, root)
    assert current_commit(spark, root)["number"] == 2
    assert read_table(spark, root, "Fact_HR").count() == 1


def test_concurrent_publish_is_refused(spark, staging, root, as_of):
    load_star(spark, staging(person(1)), root, as_of)
    one, other = Snapshot(spark, root), Snapshot(spark, root)
    one.commit()
    with pytest.raises(PublishConflict):
        other.commit()


def test_report(spark, root, as_of, tmp_path):
    path = tmp_path / "batch.csv"
    path.write_text("Unnamed: 0,Employee ID,FirstName,ExitDate\n0,1,Ann,garbage\n1,1,Ann,garbage\n2,2,Bo,01/02/2023\n")
    found = load_csv(spark, str(path), root, as_of).first()
    assert tuple(found) == (True, "loaded 2 records (1 active, 1 terminated)", 2, 1, 1)
    empty = tmp_path / "empty.csv"
    empty.write_text("Employee ID,ExitDate\n")
    assert not load_csv(spark, str(empty), root, as_of).first()["success"]
    wrong = tmp_path / "wrong.csv"
    wrong.write_text("Employee ID\n1\n")
    assert "ExitDate" in load_csv(spark, str(wrong), root, as_of).first()["message"]
    bad = tmp_path / "bad.csv"
    bad.write_text("Employee ID,ExitDate,LocationCode\n1,,abc\n")
    assert "LocationCode" in load_csv(spark, str(bad), root, as_of).first()["message"]
    assert current_commit(spark, root)["number"] == 1


def test_adhoc_sql_sees_the_star_only(spark, staging, root, as_of):
    load_star(spark, staging(person(1, StartDate=dt.date(2026, 1, 1))), root, as_of)
    found = run_sql(spark, "select f.TenureDays from Fact_HR f join Dim_Employee e using (EmployeeKey);", root, as_of)
    assert [tuple(r) for r in found.collect()] == [(14,)]
    assert run_sql(spark, "select * from Dim_Job where JobKey > 99", root, as_of).count() == 0
    literal = "with j as (select * from Dim_Job where Title = 'reflect(x)') select * from j"
    assert run_sql(spark, literal, root, as_of).count() == 0
    spark.range(1).createOrReplaceTempView("other")
    spark.range(1).createOrReplaceGlobalTempView("shared")
    commit = current_commit(spark, root)
    for statement in (
        "select * from other",
        "select Salary from Fact_HR",
        "drop view Fact_HR",
        f"select * from parquet.`{commit['path']}/Fact_HR/_part=0`",
        "select reflect('java.lang.System', 'exit', 1)",
        "select * from global_temp.shared",
        "with f as (select 1) select * from f, shared_table",
        "select * from Fact_HR where exists (select 1 from shared_table)",
    ):
        with pytest.raises(Exception) as error:
            run_sql(spark, statement, root, as_of).collect()
        assert isinstance(error.value, RefusedStatement) or "Exception" in type(error.value).__name__
    assert read_star(spark, root)["Fact_HR"].count() == 1


def test_adhoc_sql_follows_names_to_what_they_mean(spark, staging, root, as_of):
    load_star(spark, staging(person(1)), root, as_of)
    spark.sql("create table if not exists secret_t using parquet as select 1 as v")
    spark.sql("create or replace view Dim_Job_view as select * from secret_t")
    try:
        for statement in (
            "with secret_t as (select * from secret_t) select * from secret_t",
            "with a as (with secret_t as (select 1) select * from secret_t) select * from a, secret_t",
            "select (select max(v) from secret_t) from Fact_HR",
            "select * from Fact_HR where EmployeeID in (with q as (select v from secret_t) select v from q)",
            "select * from Dim_Job_view",
            "select * from default.secret_t",
            "select * from Fact_HR f join lateral (select v from secret_t where v = f.EmployeeID) on true",
        ):
            with pytest.raises(RefusedStatement):
                run_sql(spark, statement, root, as_of)
        for statement, value in (
            ("with secret_t as (select 5 as v) select v from secret_t", 5),
            ("select count(*) from (with f as (select * from Fact_HR) select * from f where EmployeeID in (select EmployeeID from f))", 1),
            ("select sum(id) from range(4) where id <= (select max(FactKey) from Fact_HR)", 1),
            ("select v from values (3) as t(v) where exists (select 1 from Dim_Employee)", 3),
        ):
            assert run_sql(spark, statement, root, as_of).first()[0] == value
    finally:
        spark.sql("drop view Dim_Job_view")
        spark.sql("drop table secret_t")


def test_old_versions_go_and_the_last_ones_stay(spark, staging, root, as_of):
    for employee in (1, 2, 3):
        batch = write_staging(staging(person(employee)), root)
        load_star(spark, batch, root, as_of)
    dropped = drop_old_versions(spark, root, keep=1)
    assert len(dropped) == 3  # two batches and the second version; the first still holds unchanged dimensions
    assert read_star(spark, root)["Fact_HR"].count() == 3 and read_staging(spark, root).count() == 1
    assert drop_old_versions(spark, root, keep=1) == []


def stored_files(spark, root):
    from staffmart.session import filesystem

    fs, path = filesystem(spark, f"{root}/versions")
    found, listing = set(), fs.listFiles(path, True)
    while listing.hasNext():
        name = listing.next().getPath().toString()
        if name.endswith(".parquet"):
            found.add(name)
    return found


def test_a_small_batch_writes_the_parts_it_touches(spark, staging, root, as_of):
    people = [person(i, FirstName=f"n{i}", PayZone="A", LocationCode=i % 3) for i in range(200)]
    load_star(spark, staging(*people), root, as_of, rows_per_part=20)
    before, files = current_commit(spark, root), stored_files(spark, root)
    assert before["tables"]["Fact_HR"]["parts"] == 10
    star = load_star(spark, staging(person(7, PayZone="B", LocationCode=1)), root, as_of, rows_per_part=20)
    after, added = current_commit(spark, root), stored_files(spark, root) - files
    for name in ("Fact_HR", "Dim_Employee"):
        one, other = before["tables"][name]["paths"], after["tables"][name]["paths"]
        assert [n for n in one if one[n] != other[n]] == [str(next(iter(n for n in other if one[n] != other[n])))]
        assert len({f.rsplit("/", 1)[0] for f in added if f"/{name}/" in f}) == 1
    assert after["tables"]["Dim_Location"] == before["tables"]["Dim_Location"]  # nothing new there
    assert not [f for f in added if "/Dim_Location/" in f]
    assert rows(star["Fact_HR"].where("PayZone = 'B'"), "EmployeeID") == [(7,)] and star["Fact_HR"].count() == 200
    assert rows(star["Fact_HR"], "FactKey") == sorted([(i + 1,) for i in range(200)], key=str)


def test_parts_give_the_rows_of_one_part(spark, staging, as_of, root):
    batches = [
        [person(i % 90, PayZone="A") for i in range(120)] + [{"Title": f"t{k}"} for k in range(5)],
        [person(i, PayZone="B") for i in range(80, 130) if i >= 90 or i % 90 >= 30] + [{"Title": "u"}],
        [{"Title": "only without ids"}],
    ]
    found = []
    for rows_per_part in (10, 1 << 20):
        folder = f"{root}-{rows_per_part}"
        for batch in batches:
            star = load_star(spark, staging(*batch), folder, as_of, rows_per_part=rows_per_part)
        found.append({name: rows(star[name], *star[name].columns) for name in star})
    assert found[0] == found[1]


def test_parts_are_dealt_again_when_they_have_grown(spark, staging, root, as_of):
    load_star(spark, staging(*[person(i) for i in range(10)]), root, as_of, rows_per_part=5)
    star = load_star(spark, staging(*[person(i) for i in range(5, 100)]), root, as_of, rows_per_part=5)
    assert current_commit(spark, root)["tables"]["Fact_HR"]["parts"] > 10
    assert star["Fact_HR"].count() == 100 and star["Dim_Employee"].count() == 101
    star = load_star(spark, staging(person(3, PayZone="Z")), root, as_of, rows_per_part=5)
    assert rows(star["Fact_HR"].where("PayZone = 'Z'"), "EmployeeID") == [(3,)]


def test_fact_is_scanned_twice_at_most(spark, staging, root, as_of):
    from staffmart.operators import fact as fact_module

    load_star(spark, staging(*[person(i) for i in range(10)]), root, as_of)
    batch = staging(person(1, PayZone="Q"), person(11))
    star = read_star(spark, root)
    known = fact_module.known_ids(batch.groupBy(F.col("Employee_ID").alias("_id")).agg(F.count("*").alias("_rows")), star["Fact_HR"], True)
    assert sorted((r["_id"], r["_known"]) for r in known.collect()) == [(1, True), (11, False)]
    merged = fact_module.upsert_fact(star["Fact_HR"], batch, star, as_of, top=10)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    # The ids were read while planning; the rows once.
    assert sum("FactKey#" in line and "Relation" in line for line in plan.splitlines()) == 1

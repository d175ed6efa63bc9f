"""Fixed column lists of the staging table and the star schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw header -> staging column. Headers not listed keep their name.
RENAMES = {
    "Employee ID": "Employee_ID",
    "Performance Score": "Performance_Score",
    "Current Employee Rating": "Current_Employee_Rating",
    "Survey Date": "Survey_Date",
    "Engagement Score": "Engagement_Score",
    "Satisfaction Score": "Satisfaction_Score",
    "Work-Life Balance Score": "Work_Life_Balance_Score",
    "Training Date": "Training_Date",
    "Training Program Name": "Training_Program_Name",
    "Training Type": "Training_Type",
    "Training Outcome": "Training_Outcome",
    "Training Duration(Days)": "Training_Duration_Days",
    "Training Cost": "Training_Cost",
}

# Texts a CSV reader of the pandas family takes for a missing value.
CSV_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Texts that mean "missing" after trimming.
TEXT_NULL_TOKENS = ("nan", "None", "", "NaT")

# Raw date columns.
DATE_HEADERS = ("StartDate", "ExitDate", "DOB", "Survey Date", "Training Date")

# Index columns a CSV export may carry: an empty header cell, as pandas and as Spark name it.
INDEX_HEADERS = ("Unnamed: 0", "_c0")

# The staging layout, (column, type). A number means text of at most that many characters.
STAGING_COLUMNS = (
    ("Employee_ID", "int"),
    ("FirstName", 100),
    ("LastName", 100),
    ("StartDate", "date"),
    ("ExitDate", "date"),
    ("Title", 100),
    ("Supervisor", 100),
    ("ADEmail", 150),
    ("BusinessUnit", 50),
    ("EmployeeStatus", 50),
    ("EmployeeType", 50),
    ("PayZone", 50),
    ("EmployeeClassificationType", 100),
    ("TerminationType", 100),
    ("TerminationDescription", "string"),
    ("DepartmentType", 100),
    ("Division", 100),
    ("DOB", "date"),
    ("State", 50),
    ("JobFunctionDescription", "string"),
    ("GenderCode", 20),
    ("LocationCode", "int"),
    ("RaceDesc", 50),
    ("MaritalDesc", 50),
    ("Performance_Score", 50),
    ("Current_Employee_Rating", "int"),
    ("Survey_Date", "date"),
    ("Engagement_Score", "int"),
    ("Satisfaction_Score", "int"),
    ("Work_Life_Balance_Score", "int"),
    ("Training_Date", "date"),
    ("Training_Program_Name", 200),
    ("Training_Type", 50),
    ("Training_Outcome", 50),
    ("Location", 100),
    ("Trainer", 100),
    ("Training_Duration_Days", "int"),
    ("Training_Cost", "decimal(12,2)"),
)

TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "date": T.DateType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "decimal(12,2)": T.DecimalType(12, 2),
}


def struct(columns) -> T.StructType:
    """Schema from (name, type) pairs; a number stands for text of at most that many characters."""
    return T.StructType(
        [T.StructField(name, TYPES["string" if isinstance(kind, int) else kind]) for name, kind in columns]
    )


STAGING_SCHEMA = struct(STAGING_COLUMNS)
STAGING_NAMES = tuple(STAGING_SCHEMA.names)
STAGING_MAX_LENGTH = {name: kind for name, kind in STAGING_COLUMNS if isinstance(kind, int)}

# The star schema. TenureDays is not stored; readers add it.
STAR_COLUMNS = {
    "Dim_Employee": (
        ("EmployeeKey", "long"),
        ("EmployeeID", "int"),
        ("FullName", 200),
        ("Age", "int"),
        ("Gender", 20),
        ("Race", 50),
        ("MaritalStatus", 50),
        ("Supervisor", 100),
        ("Email", 150),
    ),
    "Dim_Job": (
        ("JobKey", "long"),
        ("Title", 100),
        ("Department", 100),
        ("BusinessUnit", 50),
        ("Division", 100),
        ("JobFunctionDescription", "string"),
    ),
    "Dim_Location": (
        ("LocationKey", "long"),
        ("LocationCode", "int"),
        ("State", 50),
        ("City", 100),
    ),
    "Dim_Training": (
        ("TrainingKey", "long"),
        ("ProgramName", 200),
        ("TrainingType", 50),
        ("TrainerName", 100),
    ),
    "Fact_HR": (
        ("FactKey", "long"),
        ("EmployeeID", "int"),
        ("EmployeeKey", "long"),
        ("JobKey", "long"),
        ("LocationKey", "long"),
        ("TrainingKey", "long"),
        ("StartDate", "date"),
        ("ExitDate", "date"),
        ("SurveyDate", "date"),
        ("TrainingDate", "date"),
        ("EmployeeStatus", 50),
        ("EmployeeType", 50),
        ("EmployeeClassificationType", 100),
        ("PayZone", 50),
        ("AttritionFlag", "int"),
        ("TerminationType", 100),
        ("TerminationDescription", "string"),
        ("PerformanceScore", 50),
        ("CurrentRating", "int"),
        ("EngagementScore", "int"),
        ("SatisfactionScore", "int"),
        ("WorkLifeBalanceScore", "int"),
        ("TrainingOutcome", 50),
        ("TrainingDurationDays", "int"),
        ("TrainingCost", "decimal(12,2)"),
        ("LastUpdateDate", "timestamp"),
    ),
}
STAR_SCHEMAS = {name: struct(columns) for name, columns in STAR_COLUMNS.items()}
STAR_TABLES = tuple(STAR_SCHEMAS)

# Surrogate key and natural key per dimension.
SURROGATE = {
    "Dim_Employee": "EmployeeKey",
    "Dim_Job": "JobKey",
    "Dim_Location": "LocationKey",
    "Dim_Training": "TrainingKey",
}
NATURAL = {
    "Dim_Employee": ("EmployeeID",),
    "Dim_Job": ("Title", "Department"),
    "Dim_Location": ("LocationCode",),
    "Dim_Training": ("ProgramName", "TrainerName"),
}

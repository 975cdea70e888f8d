"""Event rows: one row per person, date and code."""

from pyspark.sql import DataFrame, functions as F

from visitseq.functions.ages import age_in_months, age_in_years


def select_events(df: DataFrame, code_col: str, patid_col: str = "patid",
                  date_col: str = "eventdate") -> DataFrame:
    """The three event columns under fixed names; rows with a null are dropped.

    Plain null tests on the columns as stored, which the Parquet scan applies.
    """
    return _not_null(df, patid_col, date_col, code_col).select(
        F.col(patid_col).alias("patid"), F.col(date_col).cast("date").alias("eventdate"),
        F.col(code_col).alias("code"))


def _not_null(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def distinct_events(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def cast_str(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def unique_demographic(demographic: DataFrame) -> DataFrame:
    """One row per person: the earliest known year of birth.

    Several rows per person would multiply every event in the join, and
    without a year of birth there is no age.
    """
    return (_not_null(demographic.select("patid", "yob"), "patid", "yob")
            .groupBy("patid").agg(F.min("yob").alias("yob")))


def demographic_conflicts(demographic: DataFrame) -> DataFrame:
    """Report row for `unique_demographic`: persons, and persons with several years."""
    per_person = (_not_null(demographic.select("patid", "yob"), "patid", "yob")
                  .groupBy("patid").agg(F.min("yob").alias("lo"), F.max("yob").alias("hi")))
    return per_person.agg(F.count("*").alias("persons"),
                          F.count_if(F.col("lo") < F.col("hi")).alias("conflicting"))


def join_demographic(events: DataFrame, demographic: DataFrame) -> DataFrame:
    """Inner join on the person. Catalyst broadcasts a side only if it measures small.

    Pass distinct events and a stored table with one row per person: then both
    sides come straight out of a shuffle, and AQE splits the partition of a
    person with very many events.
    """
    return events.join(demographic, "patid", "inner")


def add_age(df: DataFrame, date_col: str = "eventdate", yob_col: str = "yob",
            unit: str = "month") -> DataFrame:
    age = {"month": age_in_months, "year": age_in_years}[unit]
    return df.withColumn("age", age(F.col(date_col), F.col(yob_col)))

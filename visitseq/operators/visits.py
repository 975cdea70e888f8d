"""Visits (all codes of a person on one date) and sequences of visits.

A visit row holds the distinct codes of a day. Windows see sizes and dates only, never codes,
and a person has at most one row per calendar day in them. Sequences come in parts of bounded
length for every person, so that no row or group grows with a history: (patid, part) is the
key of a sequence table.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from visitseq.constants import MIN_VISITS, SEP
from visitseq.functions.ages import age_in_months
from visitseq.functions.arrays import count_token, tail

TOKENS_PER_ROW = 100_000


def build_visits(events: DataFrame, code_col: str = "code") -> DataFrame:
    """One row per person and date with the distinct codes in order; null codes are dropped.

    Events are made distinct by all three columns first: repeats are merged in the task, and a
    very full day is spread over tasks by its codes. What meets in a visit is distinct already,
    so a partial list before the second shuffle would save nothing; repartition leaves it out.
    """
    code = F.col(code_col).cast("string").alias("code")
    distinct = (events.where(F.col(code_col).isNotNull())
                .select("patid", "eventdate", code).dropDuplicates())
    return (distinct.repartition("patid", "eventdate").groupBy("patid", "eventdate")
            .agg(F.sort_array(F.collect_list("code")).alias("code")))


def append_sep(visits: DataFrame, col: str = "code") -> DataFrame:
    return visits.withColumn(col, F.concat(F.col(col), F.array(F.lit(SEP))))


def append_sep_age(visits: DataFrame, col: str = "age") -> DataFrame:
    """One more age per visit, for its separator."""
    return visits.withColumn(col, F.concat(F.col(col), F.slice(col, 1, 1)))


def add_visit_ages(visits: DataFrame, demographic: DataFrame) -> DataFrame:
    """An age per code. It only depends on the date, so it joins at visit grain."""
    age = age_in_months(F.col("eventdate"), F.col("yob")).cast("string")
    return (visits.join(demographic, "patid")
            .select("patid", "eventdate", "code",
                    F.array_repeat(age, F.size("code")).alias("age")))


def visit_tokens(visits: Column) -> Column:
    """Codes of an ordered array of (eventdate, code) visits, SEP after each visit."""
    return F.flatten(F.transform(visits, lambda v: F.concat(v["code"], F.array(F.lit(SEP)))))


def visit_ages(visits: Column, yob: Column) -> Column:
    """Ages in step with `visit_tokens`."""
    return F.flatten(F.transform(visits, lambda v: F.array_repeat(
        age_in_months(v["eventdate"], yob).cast("string"), F.size(v["code"]) + 1)))


def collect_visits() -> Column:
    """Aggregate of visit rows to an array ordered by date."""
    return F.sort_array(F.collect_list(F.struct("eventdate", "code")))


def with_parts(visits: DataFrame, tokens_per_row: int = TOKENS_PER_ROW) -> DataFrame:
    """Visits with the `part` of the sequence they stand in.

    Tokens are summed by month, and a month is in the part in which its first token is: a part
    has fewer than `tokens_per_row` tokens and one month more. The window runs over the months
    of a person and carries sizes only.
    """
    month = F.trunc("eventdate", "month")
    sizes = (visits.groupBy("patid", month.alias("_month"))
             .agg(F.sum(F.size("code") + 1).alias("n")))
    before = (Window.partitionBy("patid").orderBy("_month")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    parts = sizes.select("patid", "_month",
                         F.floor(start / tokens_per_row).cast("bigint").alias("part"))
    return visits.withColumn("_month", month).join(parts, ["patid", "_month"]).drop("_month")


def build_sequences(visits: DataFrame, demographic: DataFrame,
                    tokens_per_row: int = TOKENS_PER_ROW, also=()) -> DataFrame:
    """The whole token and age sequence of every person in date order: (patid, part, code, age).

    Parts are cut between visits, and a person's parts one after the other are the sequence.
    Consumers take the `part` column as a parameter. The demographic join comes last, on one
    row per part; `also` are further columns of it to keep.
    """
    parts = (with_parts(visits, tokens_per_row).groupBy("patid", "part")
             .agg(collect_visits().alias("visits")))
    return parts.join(demographic, "patid").select(
        "patid", "part",
        visit_tokens(F.col("visits")).alias("code"),
        visit_ages(F.col("visits"), F.col("yob")).alias("age"), *also)


def tail_visits(max_len: int) -> int:
    """How many last visits are sure to hold the last max_len - 1 tokens.

    Every visit has a code and a separator, so at least two tokens.
    """
    return max_len // 2


def sequence_tails(visits: DataFrame, demographic: DataFrame, max_len: int,
                   min_visits: int = MIN_VISITS) -> DataFrame:
    """The last max_len - 1 tokens of every person with enough visits.

    This is all that encoding reads. The rank limit drops older visits before
    the shuffle, so a person costs at most max_len / 2 visits of max_len codes
    per task, however long the history is.
    """
    keep = max(tail_visits(max_len), min_visits)
    newest = Window.partitionBy("patid").orderBy(F.desc("eventdate"))
    recent = (visits.withColumn("code", tail(F.col("code"), max_len))
              .withColumn("recency", F.row_number().over(newest))
              .where(F.col("recency") <= keep)
              .groupBy("patid")
              .agg(collect_visits().alias("visits"))
              .where(F.size("visits") >= min_visits))
    return recent.join(demographic, "patid").select(
        "patid",
        tail(visit_tokens(F.col("visits")), max_len - 1).alias("code"),
        tail(visit_ages(F.col("visits"), F.col("yob")), max_len - 1).alias("age"))


def min_visits(visits: DataFrame, n: int = MIN_VISITS) -> DataFrame:
    """Visits of the persons that have at least n of them: a count and a semi-join."""
    enough = visits.groupBy("patid").agg(F.count("*").alias("n")).where(F.col("n") >= n)
    return visits.join(enough.select("patid"), "patid", "left_semi")


def min_visits_of_sequences(sequences: DataFrame, n: int = MIN_VISITS,
                            code_col: str = "code", key=("patid",)) -> DataFrame:
    """Stored sequences of the keys with at least n separators in all their rows."""
    enough = (sequences.groupBy(*key).agg(F.sum(count_token(F.col(code_col))).alias("_n"))
              .where(F.col("_n") >= n).select(*key))
    return sequences.join(enough, list(key), "left_semi")


def last_tokens(sequences: DataFrame, max_len: int, key=("patid",), part: str = "part",
                same=()) -> DataFrame:
    """One row per key with the last max_len - 1 tokens of sequences stored in parts.

    Every part is cut before the shuffle, and parts that the end of the sequence does not reach
    are dropped by their sizes. `same` are columns that all rows of a key share (labels).
    """
    keep = max_len - 1
    after = (Window.partitionBy(*key).orderBy(F.desc("_part"))
             .rowsBetween(Window.unboundedPreceding, -1))
    ends = sequences.select(*key, F.col(part).alias("_part"), F.size("code").alias("_n"),
                            tail(F.col("code"), keep).alias("code"),
                            tail(F.col("age"), keep).alias("age"), *same)
    reached = (ends.withColumn("_behind", F.coalesce(F.sum("_n").over(after), F.lit(0)))
               .where((F.col("_behind") < keep) | (F.col("_n") == 0)))
    joined = reached.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("_part", "code", "age"))).alias("parts"),
        *[F.first(c).alias(c) for c in same])
    return joined.select(*key, tail(F.flatten("parts.code"), keep).alias("code"),
                         tail(F.flatten("parts.age"), keep).alias("age"), *same)


def history_index(visits: DataFrame) -> DataFrame:
    """The history up to each visit by reference: it is the first `n_tokens` tokens of the
    person's sequence. Repeating it in every row would grow with the square of the visits."""
    so_far = Window.partitionBy("patid").orderBy("eventdate")
    return (visits.select("patid", "eventdate", (F.size("code") + 1).alias("n"))
            .select("patid", "eventdate",
                    F.row_number().over(so_far).cast("bigint").alias("n_visits"),
                    F.sum("n").over(so_far).alias("n_tokens")))


def history_prefixes(index: DataFrame, sequences: DataFrame) -> DataFrame:
    """The histories of `index` taken out of a sequence table: one row per visit and part."""
    parts = Window.partitionBy("patid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sequences.select("patid", "part", F.size("code").alias("n")).select(
        "patid", "part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("start"))
    wanted = index.join(starts, "patid").where(F.col("start") < F.col("n_tokens"))
    left = (F.col("n_tokens") - F.col("start")).cast("int")
    return wanted.join(sequences, ["patid", "part"]).select(
        "patid", "eventdate", "n_visits", "n_tokens", "part",
        F.slice("code", 1, left).alias("code"), F.slice("age", 1, left).alias("age"))


def running_history(visits: DataFrame, demographic: DataFrame, max_len: int) -> DataFrame:
    """The end of the history at each visit: the last max_len - 1 tokens, as an encoder reads it.

    A visit is cut to that length before the window repeats it; ages follow from the dates and
    are made last. The whole history is `history_index`.
    """
    keep = max_len - 1
    order = Window.partitionBy("patid").orderBy("eventdate")
    recent = order.rowsBetween(1 - tail_visits(max_len), Window.currentRow)
    cut = visits.select("patid", "eventdate", (F.size("code") + 1).alias("n"),
                        F.struct("eventdate", tail(F.col("code"), keep).alias("code")).alias("v"))
    rows = cut.select(
        "patid", "eventdate",
        F.row_number().over(order).cast("bigint").alias("n_visits"),
        F.sum("n").over(order).alias("n_tokens"),
        F.collect_list("v").over(recent).alias("visits"))
    return rows.join(demographic, "patid").select(
        "patid", "eventdate", "n_visits", "n_tokens",
        tail(visit_tokens(F.col("visits")), keep).alias("code"),
        tail(visit_ages(F.col("visits"), F.col("yob")), keep).alias("age"))

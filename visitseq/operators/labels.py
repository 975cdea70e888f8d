"""Train/test split and the labels to predict."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from visitseq.constants import MIN_VISITS
from visitseq.functions.arrays import tail
from visitseq.functions.keyed import uniform
from visitseq.operators.visits import (
    TOKENS_PER_ROW, build_sequences, visit_ages, visit_tokens)


def split_patients(df: DataFrame, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """`split` is test or train, by person: nobody is in both."""
    draw = uniform(F.col("patid"), F.lit("split"), seed)
    return df.withColumn("split", F.when(draw < test_share, "test").otherwise("train"))


def pick_cuts(visits: DataFrame, min_history: int = MIN_VISITS - 1, seed: int = 0,
              last_visits: int | None = None) -> DataFrame:
    """One row per person: the history ends with visit `cut_no` on `cut_date`.

    The cut is a repeatable draw from min_history .. last visit but one; persons with too few
    visits for one are dropped. Only dates are read. With `last_visits` there is `from_date`, too:
    the date from which on the history up to the cut has that many visits.
    """
    person = Window.partitionBy("patid")
    draw = uniform(F.col("patid"), F.lit("cut"), seed)
    numbered = visits.select("patid", "eventdate").select(
        "patid", F.count("*").over(person).alias("n_visits"),
        F.max("eventdate").over(person).alias("last_date"), *_numbered(last_visits))
    drawn = numbered.where(F.col("n_visits") > min_history).withColumn(
        "cut_no", min_history + F.floor(draw * (F.col("n_visits") - min_history)))
    return drawn.where(F.col("_no") == F.col("cut_no")).drop("_no")


def _numbered(last_visits: int | None) -> list[Column]:
    order = Window.partitionBy("patid").orderBy("eventdate")
    since = [F.lag("eventdate", last_visits - 1).over(order).alias("from_date")] if last_visits else []
    return [F.row_number().over(order).cast("bigint").alias("_no"),
            F.col("eventdate").alias("cut_date"),
            F.lead("eventdate").over(order).alias("next_date"), *since]


def at_cut(cuts: DataFrame, visits: DataFrame, last_visits: int | None = None) -> DataFrame:
    """Cuts (patid, cut_no, ...) with the date of that visit and of the next one, and with
    `last_visits` of the first visit of so many up to it (null where there are fewer)."""
    numbered = visits.select("patid", *_numbered(last_visits))
    return cuts.join(numbered, "patid").where(F.col("_no") == F.col("cut_no")).drop("_no")


def _labelled(visits: DataFrame, cuts: DataFrame, demographic: DataFrame, in_label: Column,
              tokens_per_row: int) -> DataFrame:
    """(patid, cut_date, part, code, age, label): the whole history, and all label codes.

    The label is in every part of a person. Codes are made distinct by (patid, code) before
    they meet in the list, which is bounded by the vocabulary.
    """
    dated = visits.join(cuts, "patid")
    history = dated.where(F.col("eventdate") <= F.col("cut_date")).select(
        "patid", "eventdate", "code")
    codes = (dated.where(in_label).select("patid", F.explode("code").alias("code")).distinct()
             .groupBy("patid").agg(F.sort_array(F.collect_list("code")).alias("label")))
    none = F.array().cast("array<string>")
    people = (cuts.select("patid", "cut_date").join(demographic, "patid")
              .join(codes, "patid", "left").withColumn("label", F.coalesce("label", none)))
    return build_sequences(history, people, tokens_per_row, ("cut_date", "label")).select(
        "patid", "cut_date", "part", "code", "age", "label")


def label_next_visit(visits: DataFrame, cuts: DataFrame, demographic: DataFrame,
                     tokens_per_row: int = TOKENS_PER_ROW) -> DataFrame:
    """The label is the codes of the first visit after the cut."""
    return _labelled(visits, cuts, demographic, F.col("eventdate") == F.col("next_date"),
                     tokens_per_row)


def label_horizon(visits: DataFrame, cuts: DataFrame, demographic: DataFrame, months: int,
                  tokens_per_row: int = TOKENS_PER_ROW) -> DataFrame:
    """The label is all codes of the months after the cut, last day included.

    Persons whose visits end before the horizon are dropped.
    """
    horizon = F.add_months("cut_date", months)
    followed = cuts.where(F.col("last_date") >= horizon)
    in_label = (F.col("eventdate") > F.col("cut_date")) & (F.col("eventdate") <= horizon)
    return _labelled(visits, followed, demographic, in_label, tokens_per_row)


def _label_tails(visits: DataFrame, cuts: DataFrame, demographic: DataFrame, ends: list[Column],
                 after: Column, max_len: int) -> DataFrame:
    """One pass over the visits around the cuts: (patid, yob, cut_date, last_date, visits, future).

    The rank limit of the history is a bound on dates (`from_date` of `pick_cuts`), so older
    visits and those behind the last label are dropped by a comparison, in the task that reads
    them. A person keeps at most max_len / 2 visits, cut to max_len tokens, and the codes of the
    label visits, each with one flag per entry of `ends`: whether it is in that label.
    """
    code = F.col("code")
    before = F.col("eventdate") <= F.col("cut_date")
    recent = before & (F.col("from_date").isNull() | (F.col("eventdate") >= F.col("from_date")))
    rows = visits.join(cuts, "patid").where(recent | after)
    grouped = rows.groupBy("patid").agg(
        F.first("cut_date").alias("cut_date"), F.first("last_date").alias("last_date"),
        F.sort_array(F.collect_list(F.when(before, F.struct(
            "eventdate", tail(code, max_len).alias("code"))))).alias("visits"),
        F.collect_list(F.when(~before, F.struct(
            F.array(*ends).alias("within"), code.alias("code")))).alias("future"))
    return grouped.join(demographic, "patid")


def _tail_columns(max_len: int) -> list[Column]:
    keep = max_len - 1
    return [tail(visit_tokens(F.col("visits")), keep).alias("code"),
            tail(visit_ages(F.col("visits"), F.col("yob")), keep).alias("age")]


def _future_codes(i: int) -> Column:
    """The distinct codes of the label visits that end `i` covers, in order."""
    own = F.filter("future", lambda v: F.get(v["within"], F.lit(i)))
    return F.sort_array(F.array_distinct(F.flatten(F.transform(own, lambda v: v["code"]))))


def tails_next_visit(visits: DataFrame, cuts: DataFrame, demographic: DataFrame, max_len: int
                     ) -> DataFrame:
    """(patid, cut_date, code, age, label): `label_next_visit` with the last max_len - 1 tokens of
    each history. `cuts` come from `pick_cuts` with last_visits=tail_visits(max_len)."""
    after = F.col("eventdate") == F.col("next_date")
    rows = _label_tails(visits, cuts, demographic, [F.lit(True)], after, max_len)
    return rows.select("patid", "cut_date", *_tail_columns(max_len), _future_codes(0).alias("label"))


def tails_horizons(visits: DataFrame, cuts: DataFrame, demographic: DataFrame, months: list[int],
                   max_len: int) -> DataFrame:
    """(patid, cut_date, months, code, age, label): `label_horizon` for several horizons in one
    pass, with the last max_len - 1 tokens of each history; one row per person and horizon that
    the visits of the person reach. `cuts` as for `tails_next_visit`."""
    ends = [F.col("eventdate") <= F.add_months("cut_date", m) for m in months]
    after = (F.col("eventdate") > F.col("cut_date")) & (
        F.col("eventdate") <= F.add_months("cut_date", max(months)))
    followed = cuts.where(F.col("last_date") >= F.add_months("cut_date", min(months)))
    rows = _label_tails(visits, followed, demographic, ends, after, max_len)
    each = F.array(*[F.struct(F.lit(m).alias("months"), _future_codes(i).alias("label"),
                              (F.col("last_date") >= F.add_months("cut_date", m)).alias("followed"))
                     for i, m in enumerate(months)])
    rows = rows.select("patid", "cut_date", *_tail_columns(max_len), F.explode(each).alias("h"))
    return rows.where("h.followed").select("patid", "cut_date", "h.months", "code", "age", "h.label")


def distinct_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.sort_array(F.array_distinct("label")))


def positive_labels(df: DataFrame, key=("patid",), label_col: str = "label_ids") -> DataFrame:
    """One row per key and label id; ids such as -1 are no labels."""
    return (df.select(*key, F.explode(F.array_distinct(label_col)).alias("label_id"))
            .where(F.col("label_id") >= 0))


def packed_labels(df: DataFrame, label_col: str = "label_ids", name: str = "words") -> DataFrame:
    """Label ids as set bits: an array of (word, bits), label id i being bit i % 64 of word i / 64.

    Only words with a label are there, in order, so the row grows with its labels and not with
    the classes. Ids below 0 are no labels.
    """
    ids = F.array_sort(F.array_distinct(F.filter(label_col, lambda i: i >= 0)))
    one = F.lit(1).cast("bigint")

    def step(state, i):
        word = F.floor(i / 64).cast("bigint")
        bit = F.call_function("shiftleft", one, (i % 64).cast("int"))
        same = state["word"] == word
        done = F.when(same | (state["word"] < 0), state["done"]).otherwise(F.array_append(
            state["done"], F.struct(state["word"].alias("word"), state["bits"].alias("bits"))))
        return F.struct(word.alias("word"), F.when(same, state["bits"].bitwiseOR(bit)).otherwise(
            bit).alias("bits"), done.alias("done"))

    empty = F.array().cast("array<struct<word:bigint,bits:bigint>>")
    start = F.struct(F.lit(-1).cast("bigint").alias("word"), F.lit(0).cast("bigint").alias("bits"),
                     empty.alias("done"))
    return df.withColumn(name, F.aggregate(ids, start, step, lambda s: F.when(
        s["word"] < 0, empty).otherwise(F.array_append(s["done"], F.struct(
            s["word"].alias("word"), s["bits"].alias("bits"))))))


def multi_hot(df: DataFrame, n_classes: int, label_col: str = "label_ids",
              name: str = "target") -> DataFrame:
    """Label ids to a dense 0/1 array over all classes, for readers that need one; other ids
    such as -1 are ignored. `positive_labels` and `packed_labels` say the same without the zeros.

    Runs of zeros between the sorted labels are put together: the work is that of the labels and
    of the array itself, not their product.
    """
    ids = F.array_sort(F.array_distinct(F.filter(
        label_col, lambda i: (i >= 0) & (i < n_classes))))
    ends = F.concat(ids, F.array(F.lit(n_classes).cast("bigint")))
    begins = F.concat(F.array(F.lit(-1).cast("bigint")), ids)
    runs = F.zip_with(ends, begins, lambda end, begin: F.concat(
        F.array_repeat(F.lit(0), (end - begin - 1).cast("int")),
        F.when(end < n_classes, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))))
    return df.withColumn(name, F.flatten(runs))

"""Fixed-length training rows from token sequences.

A sequence is cut to its end first, so a row never has more than max_len
tokens from there on. The tokens become rows once, for the vocabulary lookup,
and are put together again by person: the partial aggregate does that inside
the task that exploded them, so whole rows and not tokens are shuffled.
"""

from pyspark.sql import Column, DataFrame, functions as F

from visitseq.constants import (
    IGNORED_LABEL, MAX_AGE, MLM_MAX_LEN, PAD, PREDICTION_MAX_LEN, SEP, UNK)
from visitseq.functions.ages import age_id
from visitseq.functions.arrays import (
    add_cls, attention_mask, index_seg, pad, run_numbers, tail)
from visitseq.operators.lookup import join_vocab
from visitseq.operators.masking import random_mask
from visitseq.operators.visits import last_tokens
from visitseq.operators.vocab import VocabFacts, vocab_facts


def tail_cls(df: DataFrame, max_len: int, key=("patid",), part: str | None = None,
             same=()) -> DataFrame:
    """The last max_len - 1 tokens and ages under a start token; empty rows go.

    One row per key, or with `part` the rows of a sequence table, whose parts the column
    numbers. `same` are further columns to keep, equal in all parts of a key.
    """
    if part is not None:
        df = last_tokens(df, max_len, key, part, same)
    cut = df.where(F.size("code") > 0).withColumns({
        "code": tail(F.col("code"), max_len - 1), "age": tail(F.col("age"), max_len - 1)})
    code, age = add_cls(F.col("code"), F.col("age"))
    return cut.withColumns({"code": code, "age": age})


def _age_ids(max_age: int, mon: int) -> Column:
    return age_id(F.col("age"), max_age, mon).alias("age_id")


def _item(*more: str) -> Column:
    """What the arrays need of a token once it is looked up: no text any more."""
    return F.struct("pos", (F.col("token") == SEP).alias("sep"), "age_id", "id", *more)


def _arrays(people: DataFrame, key, facts: VocabFacts, max_len: int, *more: Column,
            drop_null: bool = False) -> DataFrame:
    """The padded arrays of persons with their token `items`."""
    zero = F.lit(0).cast("bigint")
    ends = F.filter("items", lambda x: x["sep"])["pos"]
    ids = F.array_compact("items.id") if drop_null else F.col("items.id")
    rows = people.select(
        *key,
        pad(F.col("items.age_id"), max_len, zero).alias("age"),
        pad(ids, max_len, F.lit(facts.ids[PAD]).cast("bigint")).alias("code"),
        run_numbers(ends, F.lit(max_len)).alias("position"),
        attention_mask(F.col("items"), max_len).alias("mask"), *more)
    first = [*key, "age", "code", "position"]
    rest = [c for c in rows.columns if c not in first]
    return rows.select(*first, index_seg(F.col("position")).alias("segment"), *rest)


def _token_rows(df: DataFrame, vocab: DataFrame, facts: VocabFacts, max_len: int, max_age: int,
                mon: int, code_col: str, age_col: str, key, part: str | None) -> DataFrame:
    """(key, pos, token, age_id, id) of the tokens that a row of fixed length holds."""
    df = df.withColumnsRenamed({code_col: "code", age_col: "age"})
    rows = tail_cls(df, max_len, key, part).select(
        *key, F.posexplode(F.arrays_zip(F.col("code").alias("token"), F.col("age"))))
    rows = join_vocab(rows.select(*key, "pos", "col.token", "col.age"), vocab, ["token"], facts)
    return rows.select(
        *key, "pos", "token", _age_ids(max_age, mon),
        F.coalesce("token_id", F.lit(facts.ids[UNK])).cast("bigint").alias("id"))


def encode_sequences(df: DataFrame, vocab: DataFrame, max_len: int = MLM_MAX_LEN,
                     max_age: int = MAX_AGE, mon: int = 1, code_col: str = "code",
                     age_col: str = "age", key=("patid",), part: str | None = None) -> DataFrame:
    """Rows of fixed length with the true token ids; masking them is `mask_rows`.

    `df` has a code and an age array per key, or per key and `part`. Tables with several rows
    per person need the columns that identify a row as `key`.
    """
    facts = vocab_facts(vocab)
    rows = _token_rows(df, vocab, facts, max_len, max_age, mon, code_col, age_col, key, part)
    items = rows.groupBy(*key).agg(F.sort_array(F.collect_list(_item())).alias("items"))
    return _arrays(items, key, facts, max_len)


def encode_mlm(df: DataFrame, vocab: DataFrame, max_len: int = MLM_MAX_LEN, epoch: int = 0,
               seed: int = 0, max_age: int = MAX_AGE, mon: int = 1,
               drop_kept: bool = False, code_col: str = "code", age_col: str = "age",
               key=("patid",), part: str | None = None) -> DataFrame:
    """Pre-training rows: masked token ids, and the true id at the masked positions.

    Takes what `encode_sequences` takes. Positions and segments are those of the
    unmasked tokens. The tokens are masked as the rows that the lookup needs anyway; the result
    is that of `mask_rows` on the encoded rows.
    """
    facts = vocab_facts(vocab)
    rows = _token_rows(df, vocab, facts, max_len, max_age, mon, code_col, age_col, key, part)
    masked = random_mask(rows.withColumnRenamed("id", "token_id"), vocab, (*key, "pos"), epoch,
                         seed, drop_kept, facts).withColumnRenamed("output_id", "id")
    items = masked.groupBy(*key).agg(
        F.sort_array(F.collect_list(_item("label"))).alias("items"))
    label = pad(F.col("items.label"), max_len, F.lit(IGNORED_LABEL).cast("bigint")).alias("label")
    return _arrays(items, key, facts, max_len, label, drop_null=drop_kept)


def encode_next_visit(df: DataFrame, vocab: DataFrame, label_vocab: DataFrame,
                      max_len: int = PREDICTION_MAX_LEN, max_age: int = MAX_AGE,
                      mon: int = 1, code_col: str = "code", age_col: str = "age",
                      label_col: str = "label", key=("patid",), part: str | None = None,
                      label_len: int | None = None) -> DataFrame:
    """Prediction rows: token ids, all label ids in order, and these as an array for a model.

    `df` has a code, an age and a label array per key, or per key and `part` with the same
    label in every part. `label_ids` is the whole list. `label` is filled up with -1 to max_len
    and longer where there are more labels; `label_len` fixes its length for readers that need
    that, cutting what is beyond it in this column only.
    """
    df = df.withColumnsRenamed({code_col: "code", age_col: "age", label_col: "label"})
    facts = vocab_facts(vocab)
    label_facts = vocab_facts(label_vocab, "label_id")
    # the codes with their ages, and behind them the labels
    items = F.arrays_zip(F.concat("code", "label").alias("token"), F.col("age"))
    rows = tail_cls(df, max_len, key, part, ("label",)).select(
        *key, F.size("code").alias("n_codes"), F.posexplode(items)).select(
        *key, (F.col("pos") >= F.col("n_codes")).alias("is_label"), "pos", "col.token", "col.age")
    both = (vocab.select(F.lit(False).alias("is_label"), "token", F.col("token_id").alias("id"))
            .unionByName(label_vocab.select(
                F.lit(True).alias("is_label"), "token", F.col("label_id").alias("id"))))
    rows = join_vocab(rows, both, ["is_label", "token"], facts, label_facts)
    unknown = F.when(F.col("is_label"), label_facts.ids[UNK]).otherwise(facts.ids[UNK])
    rows = rows.select(*key, "is_label", "pos", "token", _age_ids(max_age, mon),
                       F.coalesce("id", unknown).cast("bigint").alias("id"))
    people = rows.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(~F.col("is_label"), _item()))).alias("items"),
        F.sort_array(F.collect_list(F.when(F.col("is_label"), F.col("id")))).alias("label_ids"))
    ignored = F.lit(IGNORED_LABEL).cast("bigint")
    length = F.lit(label_len) if label_len else F.greatest(F.lit(max_len), F.size("label_ids"))
    labels = F.slice(F.concat("label_ids", F.array_repeat(ignored, length)), 1, length)
    encoded = _arrays(people, key, facts, max_len, labels.alias("label"), F.col("label_ids"))
    return encoded.withColumns({k: F.col(k).cast("bigint") for k in key if k == "patid"})


def long_form(encoded: DataFrame, cols=("age", "code", "position", "segment", "mask", "label"),
              key=("patid",)) -> DataFrame:
    """One row per key and position."""
    return (encoded.select(*key, F.posexplode(F.arrays_zip(*cols)))
            .select(*key, F.col("pos").cast("bigint").alias("pos"),
                    *[F.col("col")[c].alias(c) for c in cols]))

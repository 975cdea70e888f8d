"""Row-local steps on one person's token array. None of them shuffles."""

from pyspark.sql import Column, functions as F

from visitseq.constants import CLS, PAD, SEP


def tail(arr: Column, n: int) -> Column:
    """The last n elements (all of them when there are fewer)."""
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), n)


def count_token(arr: Column, token: str = SEP) -> Column:
    return F.size(F.filter(arr, lambda t: t == token))


def add_cls(code: Column, age: Column) -> tuple[Column, Column]:
    """Start token for a cut sequence: put before a code, put over a SEP.

    Returns the code and age expressions; the inputs must not be empty.
    """
    on_sep = F.get(code, F.lit(0)) == SEP
    body = F.when(on_sep, F.slice(code, 2, F.greatest(F.size(code) - 1, F.lit(0)))).otherwise(code)
    ages = F.when(on_sep, age).otherwise(F.concat(F.slice(age, 1, 1), age))
    return F.concat(F.array(F.lit(CLS)), body), ages


def pad(arr: Column, max_len: int, symbol) -> Column:
    """Exactly max_len elements: filled up with the symbol, or cut."""
    filler = symbol if isinstance(symbol, Column) else F.lit(symbol)
    return F.slice(F.concat(arr, F.array_repeat(filler, max_len)), 1, max_len)


def attention_mask(arr: Column, max_len: int) -> Column:
    """1 for the real tokens, 0 for the padding."""
    ones = F.array_repeat(F.lit(1).cast("bigint"), F.size(arr))
    return pad(ones, max_len, F.lit(0).cast("bigint"))


def position_idx(tokens: Column, symbol=SEP) -> Column:
    """Visit number of every token: how many separators stand before it. Also takes an
    array of booleans that say what is a separator, with the symbol True.

    A separator ends a run; run j is as many times the number j as it is long.
    """
    marks = F.transform(tokens, lambda t, i: F.when(t == symbol, i))
    return run_numbers(F.filter(marks, lambda i: i.isNotNull()), F.size(tokens))


def run_numbers(ends: Column, length: Column) -> Column:
    """0, 1, ... by the runs of an array of that length, from the places where runs end."""
    def numbers(e):
        runs = F.zip_with(F.concat(e, F.array(length - 1)), F.concat(F.array(F.lit(-1)), e),
                          lambda last, before: last - before)
        return F.flatten(F.transform(runs, lambda n, j: F.array_repeat(j.cast("bigint"), n)))
    return F.get(F.transform(F.array(ends), numbers), F.lit(0))  # the ends are made once


def index_seg(positions: Column) -> Column:
    """Alternating 0/1 per visit, from the visit numbers."""
    return F.transform(positions, lambda p: p % 2)


def padded_tokens(code: Column, max_len: int) -> Column:
    return pad(code, max_len, PAD)

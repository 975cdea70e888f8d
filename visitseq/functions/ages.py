"""Age of a person at a date, and the vocabulary id of an age."""

from pyspark.sql import Column, functions as F

from visitseq.constants import AGE_SYMBOLS, MAX_AGE


def age_in_months(date: Column, yob: Column) -> Column:
    """Full months since 1 January of the year of birth."""
    return (F.year(date) - yob) * 12 + F.month(date) - 1


def age_in_years(date: Column, yob: Column) -> Column:
    return F.year(date) - yob


def age_count(max_age: int, mon: int) -> int:
    """Number of ages that have an id: monthly for mon=1, yearly for mon=12."""
    if mon not in (1, 12):
        raise ValueError(f"mon must be 1 (months) or 12 (years), not {mon}")
    return max_age * 12 // mon


def age_id(age: Column, max_age: int = MAX_AGE, mon: int = 1,
           symbols=AGE_SYMBOLS) -> Column:
    """Id of an age given as text. The ids are dense, so no lookup is needed."""
    symbols = list(symbols)
    number = age.try_cast("int")
    # Only the plain spelling of a number is in the vocabulary, "007" is not.
    known = number.between(0, age_count(max_age, mon) - 1) & (number.cast("string") == age)
    out = F.when(known, number + len(symbols))
    for i, symbol in enumerate(symbols):
        out = out.when(age == symbol, i)
    return out.otherwise(symbols.index("UNK")).cast("bigint")

"""Repeatable randomness: a draw is a function of its key, not of the task."""

import math

from pyspark.sql import Column, functions as F

RANGE = 2 ** 32


def draw_hex(*key, draw: int = 0) -> Column:
    """Eight hex digits fixed by the key parts; ``draw`` 0..3 are independent.

    Task retries, re-reads and other partitionings give the same digits, which
    a seeded ``rand()`` does not.
    """
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.substring(F.md5(text), 1 + 8 * draw, 8)


def uniform(*key, draw: int = 0) -> Column:
    """The draw as a number in [0, 1)."""
    return F.conv(draw_hex(*key, draw=draw), 16, 10).cast("double") / F.lit(float(RANGE))


def below(hexits: Column, share: float) -> Column:
    """Whether the draw as a number is below a share < 1, without the conversion:
    equally long hex digits are in the order of their numbers."""
    return hexits < F.lit(format(math.ceil(share * RANGE), "08x"))

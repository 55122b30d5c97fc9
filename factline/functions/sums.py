"""Sums in which a missing value counts for something, and integer shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def poisoned_sum(value: Column) -> Column:
    """An aggregate: 0 of no rows; null as soon as any value is null, or the sum leaves 64 bits."""
    whole = F.count(F.lit(1)) == F.count(value)
    return F.when(F.count(F.lit(1)) == 0, F.lit(0).cast("bigint")).when(whole, F.try_sum(value.cast("bigint")))


def reported_sum(value: Column) -> Column:
    """An aggregate in which a missing value adds nothing."""
    return F.coalesce(F.sum(value.cast("bigint")), F.lit(0).cast("bigint"))


def apportioned(tokens: Column, fixed: Column, everything: Column) -> Column:
    """The share of ``tokens`` that goes to the fixed part, rounded half up in whole numbers; all of it if there is no whole."""
    t, f, e = (c.cast("decimal(19,0)") for c in (tokens, fixed, everything))
    share = F.floor((t * f + F.floor(e / 2)) / e).cast("bigint")
    return F.when(everything == 0, tokens.cast("bigint")).otherwise(share)


def micros(cost: Column) -> Column:
    """Dollars as whole micro-dollars; a negative cost is none."""
    return F.round(F.greatest(cost, F.lit(0.0)) * 1_000_000).cast("bigint")


def token_count(value: Column) -> Column:
    """A count of tokens as given: a whole number that isn't negative; null for anything else."""
    text = value.cast("string")
    return F.when(text.rlike("^[0-9]{1,19}$"), text.try_cast("bigint"))


def answer_tokens(*counts: Column) -> Column:
    """The sum of an answer's counts; null if one of them is missing, negative or no number, or if the sum passes 64 bits."""
    total = reduce(Column.__add__, [token_count(c).cast("decimal(20,0)") for c in counts])
    return total.try_cast("bigint")

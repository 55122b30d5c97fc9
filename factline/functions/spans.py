"""Where patterns stand in a text, inside the JVM: spans, which of overlapping ones stay, and texts with spans replaced.

Spark's functions give what a pattern matches but not where. What stands between matches and the matches themselves make up the
text in turns, so the places are running sums of their lengths. Places count characters from 0.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,label:string,value:string>>"


class Found(NamedTuple):
    """Spans of one pattern, in order."""

    spans: Column


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def found_at(text: Column, pattern: str, group: int, label: str | Callable[[Column], Column], counts: Callable[[Column], Column]) -> Found:
    """Spans of what ``group`` matches, for values that count; the group, if any, ends where the pattern does.

    A pattern must not match nothing. A null text has none.
    """
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    name = (lambda v: F.lit(label)) if isinstance(label, str) else label

    def step(state: Column, one: Column) -> Column:
        end = state["at"] + one["gap"] + one["n"]
        span = F.struct((end - F.length(one["v"])).alias("start"), end.alias("end"), name(one["v"]).alias("label"), one["v"].alias("value"))
        return let(end, lambda e: F.struct(e.alias("at"), F.when(counts(one["v"]), F.concat(state["spans"], F.array(span).cast(SPAN))).otherwise(state["spans"]).alias("spans")))

    def places(wholes: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else wholes
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        each = F.zip_with(F.slice(gaps, F.lit(1), F.size(wholes)), F.arrays_zip(wholes.alias("w"), values.alias("v")), lambda g, m: F.struct(g.alias("gap"), F.length(m["w"]).alias("n"), m["v"].alias("v")))
        # most texts have none, and are spared the rest
        return F.when(F.size(wholes) == 0, F.array().cast(SPAN)).otherwise(F.aggregate(each, start, step, lambda s: s["spans"]))

    return Found(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places))


def _free(span: Column, taken: Column) -> Column:
    return ~F.exists(taken, lambda t: (t["start"] < span["end"]) & (span["start"] < t["end"]))


def settled(found: list[Found]) -> Column:
    """Spans of all patterns in the order of the text; of overlapping ones that of the first pattern, or the first in the text."""

    def claim(taken: Column, span: Column) -> Column:
        return F.when(_free(span, taken), F.concat(taken, F.array(span))).otherwise(taken)

    return F.array_sort(F.aggregate(F.concat(*[f.spans for f in found]), F.array().cast(SPAN), claim))


def replaced_at(text: Column, spans: Column, by: Callable[[Column], Column], keep: Callable[[Column], Column] = lambda t: t) -> Column:
    """The text with each span (in order, none overlapping) replaced, and what stands between as ``keep`` makes it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        between = keep(F.substring(text, state["at"] + 1, span["start"] - state["at"]))
        return F.struct(span["end"].alias("at"), F.concat(state["out"], between, by(span)).alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], keep(F.substring(text, s["at"] + 1, F.length(text)))))

"""Pseudonymisation: personal data as placeholders that mean the same throughout a batch, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.functions.masking import PERSONAL, capitalised, found, mask, mask_key, masked_count
from factline.functions.text import text_hash
from factline.operators.changes import first_of_each
from factline.operators.ordered import placeholders, rare_words

_NAME = r"(?:Email|PaymentCard|IpAddress|Phone|Name)-[0-9]+"


def masked_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, mask(F.col(text)))


def masking_stage(docs: DataFrame, order: str, max_chars: int | None = None) -> DataFrame:
    """Documents (key, title, description, text) as a run takes them: masked, one of each key, with ``hash``, ``masked`` and ``cut``.

    Keys that differ in a secret alone are one, the first in order. The hash is of the whole masked text, so that a change behind the
    cut is a change. ``masked`` counts the masks put in all four.
    """
    plain = [c for c in ("title", "description", "text") if c in docs.columns]
    named = docs.select("*", *[mask(F.col(c)).alias(f"_{c}") for c in plain], mask_key(F.col("key")).alias("_key"))
    count = reduce(Column.__add__, [F.coalesce(masked_count(F.col(c), F.col(f"_{c}")), F.lit(0)) for c in (*plain, "key")])
    done = named.withColumn("masked", count).select(*[F.col(f"_{c}").alias(c) if c in (*plain, "key") else F.col(c) for c in docs.columns], "masked")
    first = first_of_each(done, ["key"], [order]).withColumn("hash", text_hash(F.col("text")))
    if max_chars is None:
        return first.withColumn("cut", F.lit(False))
    long = F.length("text") > max_chars
    return first.withColumn("cut", F.coalesce(long, F.lit(False))).withColumn("text", F.when(long, F.left("text", F.lit(max_chars))).otherwise(F.col("text")))


def class_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How many values of each declared class all documents have; a class without any counts 0."""
    sums = [F.coalesce(F.sum(F.size(found(F.col(text), k))), F.lit(0)).alias(k) for k in PERSONAL]
    one = docs.agg(*sums)
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(k).alias("found")) for k in PERSONAL])).alias("c")).select("c.*")


def personal_values(docs: DataFrame, batch: str, key: str, text: str) -> DataFrame:
    """A row for each value found: ``batch, key, label, value, position``."""
    classes = F.array(*[F.struct(F.lit(k).alias("label"), found(F.col(text), k).alias("values")) for k in PERSONAL])
    one = docs.select(batch, key, F.explode(classes).alias("c"), F.col(text).alias("_text"))
    each = one.select(batch, key, "c.label", "_text", F.explode("c.values").alias("value"))
    return each.select(batch, key, "label", "value", F.struct(F.col(key), F.expr("instr(_text, value)")).alias("position"))


def rare_names(docs: DataFrame, batch: str, text: str, limit: int, stop_words: list[str]) -> DataFrame:
    """Capitalised words that a batch has at most ``limit`` times and that are no stop word."""
    words = docs.select(batch, F.explode(capitalised(F.col(text))).alias("word")).filter(~F.lower("word").isin(*stop_words))
    return rare_words(words, limit, batch, "word")


def pseudonymised(docs: DataFrame, batch: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Documents with values replaced, and the mapping ``batch, label, value, placeholder``.

    Text that looks like a placeholder already gets an equals sign, one more if it has some, so it is never taken for one.
    Longer values are replaced first, so one that is part of another doesn't cut it.
    """
    values = personal_values(docs, batch, key, text)
    mapping = placeholders(values, batch, "label", "value", "position")
    used = values.select(batch, key, "label", "value").distinct().join(mapping, [batch, "label", "value"])
    per_doc = used.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.length("value")).alias("order"), "value", "placeholder"))).alias("_swaps"))
    escaped = F.regexp_replace(F.col(text), rf"\[(=*)({_NAME})\]", "[=$1$2]")
    joined = docs.join(per_doc, key, "left")
    swapped = F.aggregate(F.coalesce("_swaps", F.array().cast("array<struct<order:int,value:string,placeholder:string>>")), escaped, lambda t, s: F.replace(t, s["value"], s["placeholder"]))
    return joined.withColumn(text, swapped).drop("_swaps"), mapping


def restored(docs: DataFrame, mapping: DataFrame, batch: str, key: str, text: str) -> DataFrame:
    """Documents with placeholders of their batch put back, and ``unrestored``: look-alikes that were never issued."""
    asked = docs.select(batch, key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rf"\[{_NAME}\]"), F.lit(0)))).alias("placeholder"))
    held = asked.join(mapping, [batch, "placeholder"], "left")
    per_doc = held.groupBy(key).agg(
        F.collect_list(F.when(F.col("value").isNotNull(), F.struct("placeholder", "value"))).alias("_swaps"), F.count_if(F.col("value").isNull()).alias("_unknown")
    )
    joined = docs.join(per_doc, key, "left")
    empty = F.array().cast("array<struct<placeholder:string,value:string>>")
    back = F.aggregate(F.coalesce("_swaps", empty), F.col(text), lambda t, s: F.replace(t, s["placeholder"], s["value"]))
    plain = F.regexp_replace(back, rf"\[=(=*)({_NAME})\]", "[$1$2]")
    return joined.withColumn(text, plain).withColumn("unrestored", F.coalesce("_unknown", F.lit(0))).drop("_swaps", "_unknown")


def left_over(docs: DataFrame, classes: list[str], text: str = "text") -> DataFrame:
    """Documents in which a class is still found: what must not be shown."""
    any_left = reduce(Column.__or__, [F.size(found(F.col(text), k)) > 0 for k in classes])
    return docs.filter(any_left)

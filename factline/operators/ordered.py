"""Operators that depend on an order: batches, chunks, context, placeholder numbers, rounds, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.operators.running import numbered

BATCH_CHARS = 60_000
LEAST_BATCH_CHARS = 4_000
RATE_WINDOW_MS = 60_000


def batch_size(given: int | None, context_tokens: int | None, reserve_tokens: int, fixed_chars: int) -> int:
    """Characters of a batch: as given, else what a model's context leaves, within bounds."""
    if given is not None:
        return given
    if context_tokens is None:
        return BATCH_CHARS
    room = (context_tokens - max(reserve_tokens, context_tokens // 4)) * 3 // 2 - fixed_chars
    return min(BATCH_CHARS, max(LEAST_BATCH_CHARS, room))


def _in_order(rows: DataFrame, group: str, order: str, columns: dict[str, str], step, out: str) -> DataFrame:  # noqa: ANN001
    """Rows of each group passed in order to ``step(state, *values)``, which gives the new state and the row's result; groups stream."""
    fields = [F.col(group).alias("_group"), F.col(order).alias("_order"), *[F.expr(e).alias(c) for c, e in columns.items()]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        first = True
        for batch in batches:
            groups, orders = batch.column("_group").to_pylist(), batch.column("_order").to_pylist()
            results = []
            for key, values in zip(groups, zip(*[batch.column(c).to_pylist() for c in columns], strict=True), strict=True):
                if first or key != now:
                    now, state, first = key, None, False
                state, result = step(state, *values)
                results.append(result)
            kind = pa.int64() if out == "long" else pa.bool_() if out == "boolean" else pa.struct([("admitted", pa.bool_()), ("wait_s", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column("_group"), batch.column("_order"), pa.array(results, kind)], names=["_group", "_order", "_result"])

    dealt = rows.select(*fields).repartition("_group").sortWithinPartitions("_group", "_order")
    schema = T.StructType([T.StructField("_group", dealt.schema["_group"].dataType), T.StructField("_order", dealt.schema["_order"].dataType), T.StructField("_result", T._parse_datatype_string(out))])
    return dealt.mapInArrow(run, schema)


def greedy_batches(rows: DataFrame, size: int, group: str, order: str, length: str) -> DataFrame:
    """``(group, order, batch)``: a batch takes rows in order until the next would pass ``size``; a longer row is alone.

    Only order and length travel; a group's rows stream through one task because each cut depends on the one before.
    """

    def step(state, n: int):  # noqa: ANN001, ANN202
        batch, used = state or (0, 0)
        if used and used + n > size:
            batch, used = batch + 1, 0
        return (batch, used + n), batch

    done = _in_order(rows, group, order, {"n": length}, step, "long")
    return done.select(F.col("_group").alias(group), F.col("_order").alias(order), F.col("_result").alias("batch"))


def admitted(rows: DataFrame, limit: int, identity: str, order: str, at_ms: str) -> DataFrame:
    """``(identity, order, admitted, wait_s)``: at most ``limit`` admitted questions of an identity within 60 seconds.

    Refused questions don't count; a refused one is told the whole seconds until the oldest admitted one leaves.
    """

    def step(state, ms: int):  # noqa: ANN001, ANN202
        held = [t for t in state or [] if ms - t < RATE_WINDOW_MS]
        if len(held) >= limit:
            return held, {"admitted": False, "wait_s": max(1, -((ms - held[0] - RATE_WINDOW_MS) // 1000))}
        return [*held, ms], {"admitted": True, "wait_s": 0}

    done = _in_order(rows, identity, order, {"ms": at_ms}, step, "admitted boolean, wait_s long")
    return done.select(F.col("_group").alias(identity), F.col("_order").alias(order), "_result.admitted", "_result.wait_s")


def chunks(rows: DataFrame, size: int, group: list[str], order: list[str]) -> DataFrame:
    """``chunk``: rows of a group numbered in order, ``size`` at a time."""
    return numbered(rows, group, order).withColumn("chunk", F.floor((F.col("_number") - 1) / size).cast("bigint")).drop("_number", "_of")


def halves(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``half`` 0 for the front half of each group, which gets the smaller part, and 1 for the rest."""
    return numbered(rows, group, order).withColumn("half", F.when(F.col("_number") <= F.floor(F.col("_of") / 2), 0).otherwise(1)).drop("_number", "_of")


def marked_last(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """``place``: rows of a group in order, those to be asked alone (alone, failed_runs) behind the rest, fewest failures first."""
    keyed = rows.withColumn("_last", F.col("alone").cast("int")).withColumn("_runs", F.when(F.col("alone"), F.col("failed_runs")).otherwise(0))
    return numbered(keyed, group, ["_last", "_runs", order]).withColumnRenamed("_number", "place").drop("_last", "_runs", "_of")


def thread_context(rows: DataFrame, budget: int, thread: str, order: str, text: str) -> DataFrame:
    """``context``: texts of earlier rows of a thread, nearest first, ``budget`` characters of them; the last is cut.

    Only rows that can still fit are looked at: each takes a character at least.
    """
    w = Window.partitionBy(thread).orderBy(order).rowsBetween(-budget, -1)
    earlier = F.reverse(F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(w))

    def take(state: Column, one: Column) -> Column:
        room = state["room"]
        piece = F.substring(one, F.lit(1), room)
        return F.struct((room - F.length(piece)).alias("room"), F.when((room > 0) & (piece != ""), F.concat(state["taken"], F.array(piece))).otherwise(state["taken"]).alias("taken"))

    start = F.struct(F.lit(budget).alias("room"), F.array().cast("array<string>").alias("taken"))
    return rows.withColumn("context", F.array_join(F.aggregate(earlier, start, take, lambda s: s["taken"]), "\n"))


def suffixed_keys(rows: DataFrame, group: list[str], key: str, order: list[str]) -> DataFrame:
    """``key`` made distinct: the second row of a key gets ``-2``, the third ``-3``, in order."""
    n = F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))
    return rows.withColumn("unique_key", F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("-"), n.cast("string"))))


def placeholders(values: DataFrame, batch: str, label: str, value: str, position: str) -> DataFrame:
    """``(batch, label, value, placeholder)``: numbered by label in order of first appearance in the batch."""
    first = values.groupBy(batch, label, value).agg(F.min(position).alias("_first"))
    n = F.row_number().over(Window.partitionBy(batch, label).orderBy("_first", value))
    return first.select(batch, label, value, F.concat(F.lit("["), F.col(label), F.lit("-"), n.cast("string"), F.lit("]")).alias("placeholder"))


def rare_words(words: DataFrame, limit: int, batch: str, word: str) -> DataFrame:
    """Words that a batch has at most ``limit`` times, with their number."""
    return words.groupBy(batch, word).agg(F.count("*").alias("uses")).filter(F.col("uses") <= limit)


def reapply_rounds(facts: DataFrame) -> DataFrame:
    """Rounds of facts refused for having nothing to replace (key, fact, time, place, refused).

    Per key, those older than the latest fact that was stored stay refused (round null); the rest are numbered by time and
    place, and round *n* applies number *n*. The first loses ``replaces`` if the key has nothing stored.
    """
    w = Window.partitionBy("key")
    stored = F.max(F.when(~F.col("refused"), F.struct("time", "place"))).over(w)
    marked = facts.withColumn("_stored", stored).filter("refused")
    stays = F.col("_stored").isNotNull() & (F.struct("time", "place") < F.col("_stored"))
    marked = marked.withColumn("_stays", stays)
    n = F.row_number().over(Window.partitionBy("key", "_stays").orderBy("time", "place")) - 1
    round_ = F.when(~F.col("_stays"), n.cast("bigint"))
    return marked.select("key", "fact", round_.alias("round"), F.coalesce((round_ == 0) & F.col("_stored").isNull(), F.lit(False)).alias("loses_replaces"))


def latest_write(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row written of every key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rotated(snapshots: DataFrame, keep: int, group: list[str]) -> DataFrame:
    """Snapshots that go: all but the newest ``keep`` of those we named ourselves, and never the restored one."""
    own = snapshots.filter("own")
    n = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("taken_at"), F.desc("name")))
    return own.withColumn("_n", n).filter((F.col("_n") > keep) & ~F.col("restored")).drop("_n")


def newer_version(left: Column, right: Column) -> Column:
    """Whether the left version is newer: numbers first, then a release before its pre-releases, then their text."""

    def key(v: Column) -> Column:
        numbers = [F.coalesce(F.regexp_extract(v, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", i).try_cast("bigint"), F.lit(0)) for i in (1, 2, 3)]
        pre = F.regexp_extract(v, r"^v?[\d.]+-(.+)$", 1)
        return F.struct(*numbers, (pre == "").alias("released"), pre.alias("pre"))

    return key(left) > key(right)

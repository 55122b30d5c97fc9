"""Answers that arrive in pieces, with their placeholders restored: what may be half a placeholder is held back until it is decided.

A piece is shown up to a tail that begins with an opening bracket and holds neither a closing one nor white space, ``HELD_BYTES``
bytes at most. The tail waits for the next piece, for the answer's end, or for a time without pieces. What has been shown never
splits a placeholder, so it is restored by itself, in the JVM, from the answer's own mapping.

What is held is a function of the text so far alone: it is the longest such tail of it. So the batch form needs only the last
pieces before each, and both forms show the same.

Defined cases: a null piece is empty; pieces of an answer may arrive in any order and are shown in that of ``seq`` (from 0), those
ahead of a missing one wait in the state; a piece that comes twice, or after the end, is ignored; a placeholder without a value is left
and counted; an answer that times out is shown with what it holds and goes on with the next piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factline.functions.spans import found_at, replaced_at

#: Bytes of a tail at most; a longer one begins no placeholder.
HELD_BYTES = 128
#: ``part`` is 1 for what was held after a piece and went out for want of another.
SHOWN = "answer string, seq long, part int, shown string, last boolean"

_LABELS = r"[A-Za-z_][A-Za-z0-9_ -]{0,63}"
_PLACEHOLDER = rf"\[{_LABELS}-[0-9]{{1,18}}\]"


def tail_of(text: Column) -> Column:
    """What a text holds back at its end."""
    tail = F.regexp_extract(text, r"\[[^\[\]\p{IsWhite_Space}]*\z", 0)
    return F.when(F.octet_length(tail) <= HELD_BYTES, tail).otherwise("")


def held_back(pieces: DataFrame) -> DataFrame:
    """``(answer, seq, shown, held, last)`` of whole answers' pieces (answer, seq, piece, last).

    No tail reaches back beyond the last piece that has a bracket or white space, and it has at most as many characters as bytes, each
    piece that isn't empty having one: so the pieces since that one, and so many at most, are all that can matter. That is one piece for most.
    """
    text = F.coalesce("piece", F.lit(""))
    rows = pieces.select("answer", F.col("seq").cast("long").alias("seq"), text.alias("piece"), F.coalesce("last", F.lit(False)).alias("last"))
    w = Window.partitionBy("answer").orderBy("seq")
    decides = F.col("piece").rlike(r"[\[\]\p{IsWhite_Space}]")
    # An empty piece is of its predecessor's number, and so holds what was held.
    numbered = rows.withColumn("_since", F.count_if(decides).over(w)).withColumn("_nth", F.count_if(F.col("piece") != "").over(w))
    since = Window.partitionBy("answer", "_since").orderBy("_nth").rangeBetween(-HELD_BYTES, 0)
    recent = F.array_join(F.collect_list(F.when(F.col("piece") != "", F.col("piece"))).over(since), "")
    kept = numbered.withColumn("tail", tail_of(recent))
    held = F.when(F.col("last"), "").otherwise(F.col("tail"))
    before = F.coalesce(F.lag("tail").over(w), F.lit(""))
    all_ = F.concat(before, "piece")
    return kept.withColumn("held", held).select("answer", "seq", F.substring(all_, F.lit(1), F.length(all_) - F.length("held")).alias("shown"), "held", "last")


class HoldBack(StatefulProcessor):
    """The tail of each answer, its next number, and pieces that are ahead of it."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "held string, next long, done boolean")
        self.ahead = handle.getMapState("ahead", "seq long", "piece string, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held, following, done = self.tail.get() if self.tail.exists() else ("", 0, False)
        arrived = {}
        for frame in rows:
            for seq, piece, last in zip(frame["seq"], frame["piece"], frame["last"], strict=True):
                arrived.setdefault(int(seq), (piece or "", bool(last)))
        for seq, value in arrived.items():
            if seq >= following and not self.ahead.containsKey((seq,)):
                self.ahead.updateValue((seq,), value)
        out = []
        while not done and self.ahead.containsKey((following,)):
            piece, done = self.ahead.getValue((following,))
            self.ahead.removeKey((following,))
            text = held + piece
            held = "" if done else held_tail(text)
            out.append((key[0], following, 0, text[: len(text) - len(held)], done))
            following += 1
        if done:
            self.ahead.clear()
        self.tail.update((held, following, bool(done)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        if out:
            yield pd.DataFrame(out, columns=["answer", "seq", "part", "shown", "last"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held, following, done = self.tail.get()
        self.tail.update(("", following, done))
        if held:
            yield pd.DataFrame([(key[0], following - 1, 1, held, False)], columns=["answer", "seq", "part", "shown", "last"])

    def close(self) -> None:
        pass


def held_tail(text: str) -> str:
    """As ``tail_of``."""
    at = text.rfind("[")
    tail = text[at:] if at >= 0 else ""
    return tail if len(tail.encode()) <= HELD_BYTES and "]" not in tail and not any(c.isspace() for c in tail) else ""


def held_back_stream(pieces: DataFrame, wait_ms: int = 30_000) -> DataFrame:
    """``(answer, seq, part, shown, last)`` as a stream; its state store has to be RocksDB's.

    Timers are of processing time, so a query runs until it is stopped: with ``availableNow`` it would wait for them for ever.
    """
    rows = pieces.select("answer", F.col("seq").cast("long").alias("seq"), "piece", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("answer").transformWithStateInPandas(HoldBack(wait_ms), SHOWN, "Append", "ProcessingTime")


def restored(shown: DataFrame, mapping: DataFrame) -> DataFrame:
    """``shown`` with each placeholder as the value that ``mapping`` (answer, placeholder, value) has for it in its answer, and ``unrestored``.

    ``mapping`` is a static table, so a stream joins it; an escaped placeholder (``[=Email-1]``) is text and loses its escape.
    """
    pairs = mapping.groupBy("answer").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("_values"))
    joined = shown.join(pairs, "answer", "left")
    values = F.coalesce("_values", F.create_map().cast("map<string,string>"))
    spans = found_at(F.col("shown"), _PLACEHOLDER, 0, "placeholder", lambda v: F.lit(True)).spans
    text = replaced_at(F.col("shown"), spans, lambda s: F.coalesce(F.try_element_at(values, s["value"]), s["value"]))
    plain = F.regexp_replace(text, rf"\[=(=*{_LABELS}-[0-9]{{1,18}}\])", "[$1")
    unknown = F.size(F.filter(spans, lambda s: F.try_element_at(values, s["value"]).isNull()))
    return joined.withColumn("unrestored", unknown).withColumn("shown", plain).drop("_values")

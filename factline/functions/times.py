"""Times as epoch milliseconds, which is how they are stored and compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factline.functions.spans import let

DAY_MS = 86_400_000
OVERLAP_MS = 300_000

_RFC3339 = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?([Zz]|[+-]\d{2}:\d{2})$"


def epoch_ms(instant: Column) -> Column:
    return F.floor(F.unix_micros(instant.cast("timestamp")) / 1000).cast("bigint")


def _date_ms(date: Column) -> Column:
    return F.datediff(date.try_cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS


def rfc3339_ms(text: Column) -> Column:
    """Epoch milliseconds of an RFC 3339 time with an offset: fractions are cut, a 60th second is let pass; null if it isn't one.

    What fits the pattern has its parts at fixed places from either end, so it is matched once.
    """

    def number(part: Column) -> Column:
        return part.try_cast("bigint")

    def of(t: Column) -> Column:
        hour, minute, second = (number(F.substring(t, i, 2)) for i in (12, 15, 18))
        fraction = number(F.rpad(F.regexp_extract(F.substring(t, 20, 4), r"^\.(\d+)", 1), 3, "0"))
        utc = F.lower(F.right(t, F.lit(1))) == "z"
        zone = F.right(t, F.lit(6))
        off_hour, off_minute = number(F.substring(zone, 2, 2)), number(F.substring(zone, 5, 2))
        offset = F.when(utc, F.lit(0).cast("bigint")).otherwise(F.when(zone.startswith("-"), -1).otherwise(1) * (off_hour * 60 + off_minute))
        fits = (hour <= 23) & (minute <= 59) & (second <= 60) & (utc | ((off_hour <= 23) & (off_minute <= 59)))
        return F.when(fits, _date_ms(F.substring(t, 1, 10)) + ((hour * 60 + minute - offset) * 60 + second) * 1000 + fraction)

    return let(text, lambda t: F.when(t.rlike(_RFC3339), of(t)))


def document_time_ms(text: Column) -> Column:
    """Time of a document: a bare date is its midnight, else RFC 3339, else 9 to 11 digits of epoch seconds; never negative."""

    def of(t: Column) -> Column:
        date = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), _date_ms(t))
        epoch = F.when(t.rlike(r"^\d{9,11}(\.\d+)?$"), F.floor(t.try_cast("decimal(38,9)") * 1000).cast("bigint"))
        return F.coalesce(date, rfc3339_ms(t), epoch)

    return let(let(F.trim(text), of), lambda found: F.when(found >= 0, found))


def rfc3339(ms: Column) -> Column:
    """UTC to the second."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int"))
    seconds = F.floor(F.pmod(ms, F.lit(DAY_MS)) / 1000)
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, F.lit("Z"))


def observed_at(document_ms: Column, start_ms: int) -> Column:
    """The document's time if it isn't after the run's start, else that start."""
    return F.when(document_ms <= start_ms, document_ms).otherwise(F.lit(start_ms).cast("bigint"))


def window_placeholders(text: Column, since_ms: int, until_ms: int) -> Column:
    """``{since}``, ``{until}``, ``{since_epoch}``, ``{until_epoch}`` and ``{since_minutes_ago}`` of a request filled in."""
    values = {
        "{since}": rfc3339(F.lit(since_ms)), "{until}": rfc3339(F.lit(until_ms)), "{since_epoch}": F.lit(str(since_ms // 1000)),
        "{until_epoch}": F.lit(str(until_ms // 1000)), "{since_minutes_ago}": F.lit(str(-((since_ms - until_ms) // 60_000))),
    }
    for key, value in values.items():
        text = F.replace(text, F.lit(key), value)
    return text

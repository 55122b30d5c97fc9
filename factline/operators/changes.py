"""What is new, changed, held back or unchanged since the last run; which of it a run takes; where the next one begins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.functions.masking import mask_key
from factline.functions.times import DAY_MS, OVERLAP_MS

NEW, CHANGED, HELD, UNCHANGED = "new", "changed", "held", "unchanged"
ALONE_BATCHES, ALONE_RUNS, SKIP_RUNS = 2, 1, 3


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in fetch order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def classify(documents: DataFrame, seen: DataFrame, now_ms: int, refresh_days: int) -> DataFrame:
    """``documents`` (key, hash, unlinked_hash, origin) beside what was seen (key, hash, unlinked_hash, applied_at): ``class``.

    A hash that differs counts at once for a file record, for a document whose own text is as before and only its links
    changed, and for one seen ``refresh_days`` ago or longer; otherwise the change is held back. A seen key without a hash
    is unchanged: its hash is only recorded.
    """
    before = seen.select("key", F.lit(True).alias("_known"), F.col("hash").alias("_hash"), F.coalesce("unlinked_hash", "hash").alias("_unlinked"), F.col("applied_at").alias("_at"))
    joined = documents.join(before, "key", "left")
    differs = F.col("_hash").isNotNull() & (F.col("_hash") != F.col("hash"))
    relinked = F.coalesce(F.col("unlinked_hash") == F.col("_unlinked"), F.lit(False))
    old = (F.lit(now_ms) - F.col("_at")) >= refresh_days * DAY_MS
    waits = F.col("origin") != "FileRecord"
    at_once = ~waits | old | relinked
    kind = F.when(F.col("_known").isNull(), NEW).when(differs & at_once, CHANGED).when(differs, HELD).otherwise(UNCHANGED)
    return joined.withColumn("class", kind).withColumnRenamed("_at", "seen_at").drop("_known", "_hash", "_unlinked")


def class_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("class").agg(F.count("*").alias("documents"))


def wanted(classified: DataFrame, limit: int, order: str = "ord") -> DataFrame:
    """The first ``limit`` new and changed documents in fetch order."""
    return classified.filter(F.col("class").isin(NEW, CHANGED)).orderBy(order).limit(limit)


def without_skipped(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """Documents without those that failed alone too often and have the same hash still."""
    skipped = failures.filter(F.col("runs") >= SKIP_RUNS).select("key", "hash")
    return documents.join(skipped, ["key", "hash"], "left_anti")


def asked_alone(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """Documents with ``alone``: whether their failures call for a batch of their own, and how often they failed alone."""
    marked = failures.select("key", ((F.col("batches") >= ALONE_BATCHES) | (F.col("runs") >= ALONE_RUNS)).alias("_alone"), F.col("runs").alias("_runs"))
    joined = documents.join(marked, "key", "left")
    return joined.withColumn("alone", F.coalesce("_alone", F.lit(False))).withColumn("failed_runs", F.coalesce("_runs", F.lit(0))).drop("_alone", "_runs")


def ladder(attempts: DataFrame) -> DataFrame:
    """State of every key after its attempts (key, ord, failed): failures since its last success, and what follows.

    The first two failures are of a batch, later ones of the document alone; a success clears them.
    """
    cleared = attempts.groupBy("key").agg(F.max(F.when(~F.col("failed"), F.col("ord"))).alias("_cleared"))
    since = attempts.filter("failed").join(cleared, "key").filter(F.col("_cleared").isNull() | (F.col("ord") > F.col("_cleared")))
    counted = since.groupBy("key").agg(F.count("*").alias("failures"))
    batches = F.least("failures", F.lit(ALONE_BATCHES))
    runs = F.col("failures") - batches
    state = F.when(runs >= SKIP_RUNS, "skipped").when((batches >= ALONE_BATCHES) | (runs >= ALONE_RUNS), "alone").otherwise("in-batch")
    return counted.select("key", batches.alias("batches"), runs.alias("runs"), state.alias("state"))


def still_listed(failures: DataFrame, documents: DataFrame) -> DataFrame:
    """Failures of keys that a complete listing still has."""
    return failures.join(documents.select("key"), "key", "left_semi")


@dataclass(frozen=True)
class Cursor:
    """Where a source's next window begins, in epoch milliseconds."""

    last_success: int | None = None
    pending_since: int | None = None
    held_since: int | None = None

    def window(self, start_ms: int, refresh_days: int) -> tuple[int, int]:
        if self.pending_since is not None:
            since = self.pending_since
        elif self.last_success is not None:
            since = self.last_success - OVERLAP_MS
        else:
            since = start_ms - refresh_days * DAY_MS
        return (since if self.held_since is None else min(since, self.held_since)), start_ms

    def after(self, since: int, until: int, complete: bool, unapplied_since: int | None, held_since: int | None, stopped: bool) -> Cursor:
        """The cursor once a run ends; ``unapplied_since`` is what ``unapplied`` found, null if nothing was left."""
        if complete and not stopped and unapplied_since is None:
            return Cursor(until, None, held_since)
        pending = since if unapplied_since is None else unapplied_since
        return Cursor(self.last_success, pending if held_since is None else min(pending, held_since), held_since)


def held_since(classified: DataFrame) -> DataFrame:
    """One row: where to read again from for what is held back; null if nothing is."""
    return classified.agg((F.min(F.when(F.col("class") == HELD, F.col("seen_at"))) - OVERLAP_MS).alias("held_since"))


def unapplied_since(rows: DataFrame, since: Column, until: Column, complete: Column) -> DataFrame:
    """One row over wanted documents (time_ms, applied): where the next window begins for those not applied.

    Five minutes before the earliest of them, within the window; the window's own beginning if the listing wasn't complete,
    a time can't be read, or none is left.
    """
    left = ~F.col("applied")
    earliest = F.min(F.when(left, F.col("time_ms")))
    unknown = F.coalesce(F.bool_or(left & F.col("time_ms").isNull()), F.lit(False))
    within = F.least(F.greatest(earliest - OVERLAP_MS, since), F.greatest(until, since))
    return rows.agg(F.when(unknown | ~complete | earliest.isNull(), since).otherwise(within).alias("pending_since"))


def remembered(seen: DataFrame, applied: DataFrame) -> DataFrame:
    """Seen state with applied documents (key, hash, unlinked_hash, applied_at) put in; the later state of a key holds."""
    every = seen.withColumn("_new", F.lit(0)).unionByName(applied.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("key").orderBy(F.desc("_new"), F.desc("applied_at"))
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def loaded(seen: DataFrame) -> DataFrame:
    """Seen state without keys that still hold a credential: such a document is listed under its masked key and read again."""
    return seen.filter(mask_key(F.col("key")) == F.col("key"))


def adopted(given: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seen entries (key, hash, unlinked_hash, applied_at) to take over, and those refused, with ``reason``.

    An entry needs a key and a time; its hash may be missing, or is 64 hexadecimal digits. What is seen already stays as it is.
    """
    bad = F.when(F.coalesce(F.trim("key"), F.lit("")) == "", "no key").when(F.col("applied_at").isNull() | (F.col("applied_at") < 0), "no time").when(F.col("hash").isNotNull() & ~F.col("hash").rlike("^[0-9a-f]{64}$"), "no hash")
    marked = given.withColumn("reason", bad)
    good = first_of_each(marked.filter("reason is null").drop("reason"), ["key"], ["applied_at", "hash"])
    return good.join(seen.select("key"), "key", "left_anti"), marked.filter("reason is not null")


def listing_fingerprint(rows: DataFrame, spec: str) -> DataFrame:
    """One row: a hash of the spec and of every (key, hash) in key order; equal for equal listings.

    The hashes of keys go through ``sum`` and ``bit_xor`` first, so no list of all keys is made.
    """
    entry = F.concat_ws("=", "key", "hash")
    return rows.agg(F.sha2(F.concat_ws("|", F.lit(spec), F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(entry)), F.lit(0)), F.coalesce(F.sum(F.crc32(entry.cast("binary"))), F.lit(0))), 256).alias("fingerprint"))

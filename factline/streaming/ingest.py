"""Ingestion as a stream: each micro-batch is classified against the seen state and applied once.

Late documents are read again and told apart by their hash rather than dropped, as the batch form does, so there is no
watermark: the state is the seen table, and a micro-batch that Spark repeats finds its documents unchanged.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factline.functions.text import text_hash
from factline.operators.changes import CHANGED, NEW, classify, first_of_each
from factline.plans.store import Store

SEEN = "key string, hash string, unlinked_hash string, applied_at long"


def seen_state(store: Store) -> DataFrame:
    """The last state of every key over all published revisions."""
    rows = store.read("seen", SEEN)
    last = rows.groupBy("key").agg(F.max_by(F.struct("hash", "unlinked_hash", "applied_at"), "revision").alias("s"))
    return last.select("key", "s.*")


def apply_batch(store: Store, batch: DataFrame, batch_id: int, now_ms: int, refresh_days: int) -> None:
    """Apply a micro-batch (key, text, origin, ord): its new and changed documents are stored, and what was seen noted."""
    docs = first_of_each(batch, ["key"], ["ord"]).withColumn("hash", text_hash(F.col("text"))).withColumn("unlinked_hash", F.lit(None).cast("string"))
    classified = classify(docs, seen_state(store), now_ms, refresh_days)
    taken = classified.filter(F.col("class").isin(NEW, CHANGED))
    revision = store.begin("stream")
    store.stage("documents", taken.select("key", "text", "hash", "class", F.lit(batch_id).cast("bigint").alias("batch_id")), revision)
    staged = store.read("documents", "key string, text string, hash string, class string, batch_id long", staged=revision).filter(F.col("revision") == revision)
    store.stage("seen", staged.select("key", "hash", F.lit(None).cast("string").alias("unlinked_hash"), F.lit(now_ms).cast("bigint").alias("applied_at")), revision)
    store.publish(revision)


def start(spark: SparkSession, source: DataFrame, store: Store, checkpoint: str, now_ms: int | None, refresh_days: int) -> StreamingQuery:
    """Run a streaming source of documents into the store until it is stopped; all that is there, then end.

    Without ``now_ms`` each micro-batch is of the time when it is read, so that a change that was held back comes due while a stream runs.
    """
    return (
        source.writeStream.foreachBatch(lambda batch, n: apply_batch(store, batch, n, int(time.time() * 1000) if now_ms is None else now_ms, refresh_days))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )



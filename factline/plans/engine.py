"""The engine: sources run into a versioned store, behind a gate, and can be undone."""

from __future__ import annotations

from dataclasses import astuple, dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from factline.functions.text import text_hash
from factline.operators import changes, lifecycle, mapping
from factline.plans.store import Conflict, Head, Store, save

ASSERTIONS = (
    "id string, subject string, predicate_kind string, predicate string, object string, valid_from long, evidence array<string>"
)
ENDED = "id string, op string, replaced_by string, effective_from long, reason string"
SEEN = "key string, hash string, unlinked_hash string, applied_at long"
CURSORS = "label string, last_success long, pending_since long, held_since long"
LISTINGS = "label string, fingerprint string, held long"
#: How often a run begins anew after another run of its source has published under it.
ATTEMPTS = 3


@dataclass
class Report:
    """What a run did."""

    outcome: str
    revision: int = 0
    classes: dict[str, int] = field(default_factory=dict)
    facts: int = 0
    superseded: int = 0
    retracted: int = 0
    unconverted: int = 0
    failed_checks: list[str] = field(default_factory=list)


class Engine:
    """``run`` imports a listing of records; ``count`` only classifies it; ``restore`` goes back to a revision."""

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.store = spark, Store(spark, home)

    def seen(self, at: Head | None = None) -> DataFrame:
        rows = self.store.read("seen", SEEN, at=at)
        last = rows.groupBy("key").agg(F.max_by(F.struct("hash", "unlinked_hash", "applied_at"), "revision").alias("s"))
        return last.select("key", "s.*")

    def _last(self, table: str, schema: str, label: str, at: Head | None = None) -> Row | None:
        """The last row that a source's runs have left of themselves."""
        rows = self.store.read(table, schema, at=at).filter(F.col("label") == label)
        return rows.orderBy(F.desc("revision")).limit(1).first()

    def cursor(self, spec: mapping.Mapping, at: Head | None = None) -> changes.Cursor:
        """Where the next run of a source has to read from."""
        row = self._last("cursors", CURSORS, spec.prefix, at)
        return changes.Cursor(row.last_success, row.pending_since, row.held_since) if row else changes.Cursor()

    def window(self, spec: mapping.Mapping, now_ms: int, refresh_days: int = 0) -> tuple[int, int]:
        """What a source is to be asked for, in epoch milliseconds, and what ``run`` is to be given the listing of."""
        return self.cursor(spec).window(now_ms, refresh_days)

    def assertions(self, at: Head | None = None) -> DataFrame:
        """All assertions, each active unless an operation ended it."""
        rows = self.store.read("assertions", ASSERTIONS, at=at)
        over = self.store.read("ended", ENDED, at=at).select("id", F.col("op").alias("_op"), F.col("effective_from").alias("valid_to"))
        joined = rows.drop("revision").join(over, "id", "left")
        return joined.withColumn("lifecycle", F.when(F.col("_op").isNull(), "Active").when(F.col("_op") == lifecycle.SUPERSEDE, "Superseded").otherwise("Retracted")).drop("_op")

    def _classified(self, mapped: DataFrame, now_ms: int, refresh_days: int, at: Head | None = None) -> DataFrame:
        docs = mapped.select(F.col("identity").alias("key"), "hash", "unlinked_hash", F.lit("Record").alias("origin"), "ord")
        return changes.classify(docs, self.seen(at), now_ms, refresh_days)

    def _mapped(self, records: DataFrame, spec: mapping.Mapping, links: DataFrame | None) -> DataFrame:
        """Mapped records; with links (key, relation, tag, ord) their hash is of the text with them, and ``unlinked_hash`` of that without."""
        mapped = mapping.mapped_records(records, spec)
        if links is None:
            return mapped.withColumn("unlinked_hash", F.lit(None).cast("string"))
        texts = mapping.linked(mapped.select(F.col("identity").alias("key"), F.col("record").alias("text")), links)
        hashes = texts.select(F.col("key").alias("identity"), text_hash(F.col("text")).alias("hash"), text_hash(F.coalesce("unlinked", "text")).alias("unlinked_hash"))
        return mapped.drop("hash").join(hashes, "identity")

    def count(self, records: DataFrame, spec: mapping.Mapping, now_ms: int, refresh_days: int = 0, links: DataFrame | None = None) -> dict[str, int]:
        """Documents by class; nothing is written."""
        classified = self._classified(self._mapped(records, spec, links), now_ms, refresh_days)
        return {r["class"]: r.documents for r in changes.class_counts(classified).collect()}

    def run(
        self, records: DataFrame, spec: mapping.Mapping, now_ms: int, refresh_days: int = 0, complete: bool = True, checks: list[tuple[str, str | None, str | None]] | None = None,
        links: DataFrame | None = None, stopped: bool = False,
    ) -> Report:
        """Import a listing: apply what is new or changed, end what it no longer lists, and publish if the checks pass.

        A record with a property that doesn't convert gives no facts and is reported; it is seen, and what else it lists
        stays. A listing that isn't complete, or has no record, ends nothing. A run whose checks fail is never published, so
        no reader sees it. What an earlier run of the source left when it died is settled first. A whole listing like the
        last one, of which nothing was held back, isn't read further (``unchanged``). If another run of the source publishes
        meanwhile, this one begins anew from there.
        """
        self.store.recover(spec.prefix)
        for left in reversed(range(ATTEMPTS)):
            try:
                return self._run(records, spec, now_ms, refresh_days, complete, checks, links, stopped)
            except Conflict:
                if not left:
                    raise
        raise AssertionError("unreachable")

    def _run(
        self, records: DataFrame, spec: mapping.Mapping, now_ms: int, refresh_days: int, complete: bool, checks: list[tuple[str, str | None, str | None]] | None, links: DataFrame | None, stopped: bool
    ) -> Report:
        revision = self.store.begin(spec.prefix)
        at = self.store.began_from(revision)
        cursor = self.cursor(spec, at)
        since, until = cursor.window(now_ms, refresh_days)
        print_ = self.fingerprint(records, spec) if links is None else None
        last = self._last("listings", LISTINGS, spec.prefix, at)
        if complete and last and print_ and last.fingerprint == print_ and not last.held:
            self._stage_row("cursors", CURSORS, (spec.prefix, *astuple(cursor.after(since, until, True, None, None, stopped))), revision)
            self.store.publish(revision)
            return Report("unchanged", revision)
        mapped = save(self._mapped(records, spec, links), "mapped")
        classified = save(self._classified(mapped, now_ms, refresh_days, at), "classified")
        classes = {r["class"]: r.documents for r in changes.class_counts(classified).collect()}
        taken = classified.filter(F.col("class").isin(changes.NEW, changes.CHANGED)).select(F.col("key").alias("identity"))
        read = mapped.join(taken, "identity", "left_semi")
        fresh = mapping.kept(read)
        facts = mapping.property_facts(fresh).select("subject", F.lit("Property").alias("predicate_kind"), "predicate", F.col("value").alias("object"), "evidence")
        if spec.relations:
            facts = facts.unionByName(mapping.relation_facts(fresh, spec).select("subject", F.lit("Relation").alias("predicate_kind"), "predicate", F.col("target").alias("object"), "evidence"))
        before = self.assertions(at).filter("lifecycle = 'Active'")
        known = before.select("subject", "predicate", "object")
        added = facts.join(known, ["subject", "predicate", "object"], "left_anti").distinct()
        added = added.select(F.sha2(F.concat_ws("\x1f", "subject", "predicate", "object", F.lit(str(now_ms))), 256).alias("id"), "subject", "predicate_kind", "predicate", "object", F.lit(now_ms).cast("bigint").alias("valid_from"), F.array("evidence").alias("evidence"))
        self.store.stage("assertions", added, revision)
        self.store.stage("seen", read.select(F.col("identity").alias("key"), "hash", "unlinked_hash", F.lit(now_ms).cast("bigint").alias("applied_at")), revision)
        staged = self.store.read("assertions", ASSERTIONS, staged=revision, at=at).filter(F.col("revision") == revision)
        report = Report("ran", revision, classes, staged.count(), unconverted=read.filter(F.size("unconverted") > 0).count())
        if complete and sum(classes.values()):
            operations = save(self._ended(before, staged, mapped, classified, spec), "ended")
            counts = {r.op: r.n for r in operations.groupBy("op").agg(F.count("*").alias("n")).collect()}
            report.superseded, report.retracted = counts.get(lifecycle.SUPERSEDE, 0), counts.get(lifecycle.RETRACT, 0)
            self.store.stage("ended", operations, revision)
        measures = self.spark.createDataFrame([(report.facts, report.superseded, report.retracted)], "facts long, superseded long, retracted long")
        report.failed_checks = [r.measure for r in lifecycle.gate(measures, checks or []).filter("not passed").collect()]
        if report.failed_checks:
            report.outcome = "apply-refused"
            self.store.abandon(revision)
        else:
            held = changes.held_since(classified).first().held_since
            self._stage_row("cursors", CURSORS, (spec.prefix, *astuple(cursor.after(since, until, complete, None, held, stopped))), revision)
            if complete and print_:
                self._stage_row("listings", LISTINGS, (spec.prefix, print_, classes.get(changes.HELD, 0)), revision)
            self.store.publish(revision)
        return report

    def _stage_row(self, table: str, schema: str, row: tuple, revision: int) -> None:
        self.store.stage(table, self.spark.createDataFrame([row], schema).coalesce(1), revision)

    def _ended(self, before: DataFrame, staged: DataFrame, mapped: DataFrame, classified: DataFrame, spec: mapping.Mapping) -> DataFrame:
        columns = ["id", "subject", "predicate_kind", "predicate", "object", "valid_from", "evidence"]
        every = before.select(*columns).unionByName(staged.select(*columns)).withColumn("lifecycle", F.lit("Active")).withColumn("valid_to", F.lit(None).cast("bigint"))
        evidence = every.select(F.explode("evidence").alias("evidence_id")).distinct().filter(F.col("evidence_id").startswith(spec.prefix + ":")).withColumn("record", F.col("evidence_id"))
        claims = mapping.property_facts(mapped).select(F.col("subject").alias("record"), "predicate", "value")
        names = every.filter("predicate_kind = 'Relation'").select("object", F.col("object").alias("name")).distinct()
        if spec.relations:
            claims = claims.unionByName(mapping.relation_facts(mapped, spec).select(F.col("subject").alias("record"), "predicate", F.col("target").alias("value")))
        unsettled = classified.filter(F.col("class") == changes.HELD).select(F.col("key").alias("record"))
        return lifecycle.ended(lifecycle.with_kept(lifecycle.owned(every, evidence), claims, unsettled, relation_names=names))

    def restore(self, revision: int) -> None:
        self.store.restore(revision)

    def fingerprint(self, records: DataFrame, spec: mapping.Mapping) -> str:
        """Equal for equal listings under an equal mapping, so that an unchanged one need not be read further."""
        listed = records.select(F.col("record").alias("key"), text_hash(F.col("record")).alias("hash"))
        return changes.listing_fingerprint(listed, repr(spec)).first()[0]

"""Ending what a source no longer lists; gates over a run's report."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.operators.tables import saved

SUPERSEDE, RETRACT = "Supersede", "Retract"
OPERATIONS_PER_TRANSACTION = 1_000
STORE_MEASURES = ("facts", "nodes", "edges")


def owned(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Active assertions that cite evidence of this source's records only, with ``records``, those records in order.

    Assertions have ``id, lifecycle, subject, predicate_kind, predicate, object, valid_from, valid_to, evidence``;
    ``evidence`` has ``evidence_id, record``.
    """
    active = assertions.filter((F.col("lifecycle") == "Active") & (F.size("evidence") > 0))
    cited = active.select("id", F.explode("evidence").alias("evidence_id")).join(evidence, "evidence_id", "left")
    records = cited.groupBy("id").agg(F.every(F.col("record").isNotNull()).alias("all_own"), F.array_sort(F.collect_set("record")).alias("records"))
    return active.join(records.filter("all_own").drop("all_own"), "id")


def prefixes(record: Column) -> Column:
    """Every part of an identity that ends before a colon, the longest first; parts escape their own colons, so these are its ancestors."""
    parts = F.split(record, ":")
    return F.reverse(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":")))


def with_kept(mine: DataFrame, claims: DataFrame, unsettled: DataFrame, held: DataFrame | None = None, relation_names: DataFrame | None = None) -> DataFrame:
    """``mine`` with ``kept``: whether any of its records still claims it, isn't settled yet, or is held back.

    Claims are ``record, predicate, value``; for relations the value is an alias of the target, and ``relation_names``
    gives the target node's names (object, name). Unsettled is ``record``. Held is ``prefix, relation`` (null: any): calls that failed;
    a record is held if any of its ancestors is. What has no names, or is neither property nor relation, is kept.

    Reasons are columns of one pass over (assertion, record): each join adds one, and one aggregate settles them. ``mine`` is saved, since
    it is read for that pass and for the result.
    """
    mine = saved(mine, "owned")
    one = mine.select("id", "predicate_kind", "predicate", "object", F.explode("records").alias("record"))
    if relation_names is None:
        relation_names = one.sparkSession.createDataFrame([], "object string, name string")
    relation = F.col("predicate_kind") == "Relation"
    names = relation_names.select(F.lit("Relation").alias("predicate_kind"), "object", "name").distinct()
    # Values of properties have no names, and a common one would bring all its rows to one task.
    related = one.filter(relation).join(names, ["predicate_kind", "object"], "left").select(*one.columns, "name")
    stated = one.filter(~F.coalesce(relation, F.lit(False))).withColumn("name", F.lit(None).cast("string"))
    named = related.unionByName(stated).withColumn("value", F.when(relation, F.col("name")).otherwise(F.col("object")))
    claimed = claims.select("record", "predicate", "value").distinct().withColumn("_claimed", F.lit(True))
    reasons = named.join(claimed, ["record", "predicate", "value"], "left").join(unsettled.select("record").distinct().withColumn("_unsettled", F.lit(True)), "record", "left")
    other = (relation & F.col("name").isNull()) | ~F.col("predicate_kind").isin("Property", "Relation")
    kept = F.col("_claimed").isNotNull() | F.col("_unsettled").isNotNull() | other
    flags = reasons.select("id", kept.alias("kept"))
    if held is not None:
        scope = held.select(F.regexp_replace("prefix", ":$", "").alias("prefix"), "relation").distinct()
        # A prefix of few parts is that of very many records, so only as many parts are looked at as some held one has.
        depths = F.lit([r.n for r in scope.select(F.size(F.split("prefix", ":")).alias("n")).distinct().collect()]).cast("array<int>")
        some = F.filter(prefixes(F.col("record")), lambda p: F.array_contains(depths, F.size(F.split(p, ":"))))
        under = one.select("id", relation.alias("_relation"), "predicate", F.explode(some).alias("prefix"))
        reached = under.join(scope, "prefix").filter(F.col("relation").isNull() | (F.col("_relation") & (F.col("relation") == F.col("predicate"))))
        flags = flags.unionByName(reached.select("id", F.lit(True).alias("kept")))
    settled = flags.groupBy("id").agg(F.bool_or("kept").alias("kept"))
    return mine.join(settled, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def ended(marked: DataFrame) -> DataFrame:
    """An operation for every assertion that isn't kept: ``id, op, replaced_by, effective_from, reason``.

    A property is superseded by the latest kept assertion of its records, subject and predicate that begins within its own
    validity (open ends are null), the larger id on a tie; whatever has none is retracted. Both are sorted together by time, what isn't
    kept at the end of its validity: the last kept one up to there is the only that can be, so nothing is paired.
    """
    property_, forever = F.col("predicate_kind") == "Property", F.lit((1 << 63) - 1)
    at = F.when(F.col("kept"), F.col("valid_from")).otherwise(F.coalesce("valid_to", forever))
    by = F.when(F.col("kept") & property_ & F.col("valid_from").isNotNull(), F.struct(F.col("valid_from").alias("from"), F.col("id").alias("by")))
    w = Window.partitionBy("records", "subject", "predicate", property_).orderBy("_at", "_gone", "id").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = marked.withColumn("_at", at).withColumn("_gone", ~F.col("kept")).withColumn("_by", by).withColumn("_last", F.last("_by", ignorenulls=True).over(w))
    begins = F.col("valid_from").isNull() | (F.col("_last.from") >= F.col("valid_from"))
    gone = sorted_.filter("_gone").withColumn("r", F.when(property_ & begins, F.col("_last")))
    reason = F.when(F.col("r").isNull(), F.concat(F.array_join("records", ", "), F.lit(" no longer lists this value")))
    return gone.select("id", F.when(F.col("r").isNotNull(), SUPERSEDE).otherwise(RETRACT).alias("op"), F.col("r.by").alias("replaced_by"), F.col("r.from").alias("effective_from"), reason.alias("reason"))


def renamed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(old, new)``: which record of today an identity under an earlier prefix names, one for each that names any.

    Both have ``key, child, parent, id`` (child and parent null for a source's own records): the same child of a parent named alike,
    and an id named alike, which is the same text, or in ``old`` the digest that an identity holds where masking would alter it. So each
    record of today has four names, and the two meet by equality; the same text wins over a digest, then the least key.
    """

    def alike(part: str) -> Column:
        return F.array(F.struct(F.lit(0).alias("digest"), F.col(part).alias("text")), F.struct(F.lit(1).alias("digest"), F.substring(F.sha2(part, 256), 1, 16).alias("text")))

    names = new.select(F.col("key").alias("new"), "child", F.explode(alike("parent")).alias("p"), alike("id").alias("i")).select("new", "child", "p", F.explode("i").alias("i"))
    names = names.filter(F.col("child").isNotNull() | (F.col("p.digest") == 0))
    today = names.select("new", F.coalesce("child", F.lit("")).alias("child"), F.coalesce("p.text", F.lit("")).alias("parent"), F.col("i.text").alias("id"), (F.col("p.digest") + F.col("i.digest")).alias("rank"))
    earlier = old.select(F.col("key").alias("old"), F.coalesce("child", F.lit("")).alias("child"), F.coalesce("parent", F.lit("")).alias("parent"), "id")
    met = earlier.join(today, ["child", "parent", "id"])
    return met.groupBy("old").agg(F.min_by("new", F.struct("rank", "new")).alias("new"))


def deleted_edges(edges: DataFrame, relations: DataFrame, operations: DataFrame) -> DataFrame:
    """Edges (id, source, type, target) whose relation was retracted and that no relation that stays still states."""
    gone = operations.filter(F.col("op") == RETRACT).select("id")
    stated = relations.select("id", F.col("subject").alias("source"), F.col("predicate").alias("type"), F.col("object").alias("target"))
    triple = ["source", "type", "target"]
    lost = stated.join(gone, "id", "left_semi").select(*triple)
    stays = stated.join(gone, "id", "left_anti").select(*triple)
    return edges.join(lost, triple, "left_semi").join(stays, triple, "left_anti")


def scaled(value: Column) -> Column:
    """A measure at four decimals, half away from zero."""
    return F.round(value.cast("decimal(38,10)"), 4)


def gate(report: DataFrame, checks: list[tuple[str, str | None, str | None]], costs_counted: bool = True, store_only: bool = False) -> DataFrame:
    """A row for each check (measure, least, most) over a one-row report: ``measure, value, passed``.

    An absent or null measure fails. The cost check doesn't count where costs aren't counted; ``store_only`` drops the
    measures of a run's report.
    """
    rows = []
    for measure, least, most in checks:
        if measure == "cost_usd" and not costs_counted or store_only and measure not in STORE_MEASURES:
            continue
        value = scaled(F.col(measure)) if measure in report.columns else F.lit(None).cast("decimal(38,4)")

        def bound(text: str) -> Column:
            return F.lit(Decimal(text).quantize(Decimal("0.0001"), ROUND_HALF_UP))

        good = value.isNotNull()
        if least is not None:
            good = good & (value >= bound(least))
        if most is not None:
            good = good & (value <= bound(most))
        rows.append(F.struct(F.lit(measure).alias("measure"), value.cast("decimal(38,4)").alias("value"), F.coalesce(good, F.lit(False)).alias("passed")))
    if not rows:
        return report.sparkSession.createDataFrame([], "measure string, value decimal(38,4), passed boolean")
    return report.select(F.explode(F.array(*rows)).alias("c")).select("c.*")

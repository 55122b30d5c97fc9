"""Checks of what a model or a reviewer gave back: labels it cites, parts that were refused, answers replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cited(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Proposals (proposal, batch, labels, facts) whose labels ``E1``, ``E2``, ... all name evidence (batch, n, evidence_id) of
    their batch, and that rest on a fact at least: ``proposal, evidence`` in the labels' order, each once."""
    one = proposals.filter(F.size("facts") > 0).select("proposal", "batch", F.posexplode("labels").alias("at", "label"))
    n = F.regexp_extract("label", r"^E([1-9][0-9]{0,8})$", 1).try_cast("bigint")
    found = one.withColumn("n", n).join(evidence, ["batch", "n"], "left")
    grouped = found.groupBy("proposal").agg(F.every(F.col("evidence_id").isNotNull()).alias("good"), F.array_sort(F.collect_list(F.struct("at", "evidence_id"))).alias("e"))
    return grouped.filter("good").select("proposal", F.array_distinct(F.transform("e", lambda x: x["evidence_id"])).alias("evidence"))


def refused_records(items: DataFrame, owners: DataFrame) -> DataFrame:
    """Records that refused parts (batch, item) belong to: ``batch, record``.

    ``facts[3]`` and ``entities[0]`` name the part of that kind and number in owners (batch, kind, n, record); any other item
    concerns every record of its batch.
    """
    shape = r"^(facts|entities)\[([0-9]{1,9})\]"
    named = items.withColumn("kind", F.regexp_extract("item", shape, 1)).withColumn("n", F.regexp_extract("item", shape, 2).try_cast("bigint"))
    parts = named.filter("kind <> ''").join(owners, ["batch", "kind", "n"]).select("batch", "record")
    whole = owners.select("batch", "record").join(named.filter("kind = ''").select("batch"), "batch", "left_semi")
    return parts.unionAll(whole).distinct()


def with_evidence(keys: DataFrame, evidence: DataFrame) -> DataFrame:
    """Keys that evidence (identity) is about: as a link, a file or a record."""
    spelled = keys.select("key", F.explode(F.array(F.col("key"), F.concat(F.lit("file:"), F.col("key")), F.concat(F.lit("record:"), F.col("key")))).alias("identity"))
    return keys.join(spelled.join(evidence.select("identity"), "identity", "left_semi").select("key"), "key", "left_semi")


def missing_types(asked: DataFrame, declared: DataFrame) -> DataFrame:
    """Types asked for (ord, name) that aren't declared (name), in any case; each at its first place."""
    have = declared.select(F.lower("name").alias("_low")).distinct()
    left = asked.withColumn("_low", F.lower("name")).join(have, "_low", "left_anti")
    return left.groupBy("_low").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord")).select("ord", "name")


def replayed(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """What an earlier run's answers (case, question) are to the cases now: ``used``, ``missing``, or asked ``otherwise``."""
    joined = cases.join(answers.select("case", F.col("question").alias("_asked")), "case", "left")
    state = F.when(F.col("_asked").isNull(), "missing").when(F.col("_asked") == F.col("question"), "used").otherwise("otherwise")
    return joined.select("case", state.alias("state"))


def cut_bytes(text: Column, size: int) -> Column:
    """The longest beginning of a text with at most ``size`` bytes that ends between characters."""
    data = F.encode(text, "utf-8")
    tries = [F.try_validate_utf8(F.substring(data, 1, max(0, size - k)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= size, text).otherwise(F.coalesce(*tries))


def known_lines(names: DataFrame) -> DataFrame:
    """A line per type of its known names (type, name, origin), the store's first: ``type: a; b``."""
    rank = F.when(F.col("origin") == "store", 0).otherwise(1)
    listed = names.groupBy("type").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "name"))).alias("n"))
    return listed.select("type", F.concat(F.col("type"), F.lit(": "), F.array_join(F.transform("n", lambda x: x["name"]), "; ")).alias("line"))


def first_owners(parts: DataFrame) -> DataFrame:
    """Each distinct entity (entity, record, ord) with the records that own it, once each, by their first place."""
    first = parts.groupBy("entity", "record").agg(F.min("ord").alias("ord"))
    held = first.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("ord", "record"))).alias("o"))
    return held.select("entity", F.transform("o", lambda x: x["record"]).alias("records"))


def joined_refusals(refusals: DataFrame) -> DataFrame:
    """Distinct refusals of each batch (batch, ord, text) in order of appearance, joined by semicolons."""
    first = refusals.groupBy("batch", "text").agg(F.min("ord").alias("ord"))
    listed = first.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return listed.select("batch", F.array_join(F.transform("t", lambda x: x["text"]), "; ").alias("refusals"))


def respelled(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether inputs (input) were both taken away and added, which calls their keys in question."""
    gone, new = before.select("input").exceptAll(after.select("input")), after.select("input").exceptAll(before.select("input"))
    marked = gone.select(F.lit(1).alias("g"), F.lit(0).alias("n")).unionAll(new.select(F.lit(0), F.lit(1)))
    return marked.agg(F.coalesce((F.sum("g") > 0) & (F.sum("n") > 0), F.lit(False)).alias("respelled"))


def timeline(entries: DataFrame, limit: int) -> DataFrame:
    """Entries (at_ms, ord, label) by instant, those of one instant as they came, at most ``limit``: with their place."""
    n = F.row_number().over(Window.partitionBy("figure").orderBy("at_ms", "ord"))
    return entries.withColumn("place", n).filter(F.col("place") <= limit).select("figure", "place", "label")

"""Joins between records: first-interval links, follow rules, lookups in the store, relation targets, alias closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.operators.tables import dropped, saved

KNOWN_NAMES = 50


def compare_links(changes: DataFrame, tags: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Each change (parent, change, time) to the first tag (parent, tag, time) at or after it: ``parent, change, tag``.

    Tags are ordered by (time, identity); a tag's comparison holds the changes after the tag before it. A parent's failed
    tags (parent, tag) end its links there. Changes and tags meet by one sort of both, not by pairs: the next tag at or
    after a change is the first that follows it in the order of (time, change before tag).
    """
    ordered = tags
    if failed is not None:
        bad = tags.join(failed, ["parent", "tag"]).groupBy("parent").agg(F.min(F.struct("time", "tag")).alias("_stop"))
        ordered = tags.join(bad, "parent", "left").filter(F.col("_stop").isNull() | (F.struct("time", "tag") < F.col("_stop"))).drop("_stop")
    both = changes.select("parent", "time", F.lit(0).alias("_is_tag"), "change", F.lit(None).cast(tags.schema["tag"].dataType).alias("tag")).unionByName(
        ordered.select("parent", "time", F.lit(1).alias("_is_tag"), F.lit(None).cast(changes.schema["change"].dataType).alias("change"), "tag")
    )
    w = Window.partitionBy("parent").orderBy(F.desc("time"), F.desc("_is_tag"), F.desc("tag")).rowsBetween(Window.unboundedPreceding, 0)
    following = F.last("tag", ignorenulls=True).over(w)
    return both.withColumn("_found", following).filter("_is_tag = 0 and _found is not null").select("parent", "change", F.col("_found").alias("tag"))


def follow(parents: DataFrame, children: DataFrame, on: str, rule: Column, failed: DataFrame | None = None) -> DataFrame:
    """Children of the parents that a rule follows; parents whose call failed give none."""
    asked = parents.filter(F.coalesce(rule, F.lit(False))).select(on)
    if failed is not None:
        asked = asked.join(failed.select(on), on, "left_anti")
    return children.join(asked, on, "left_semi")


def alias_index(nodes: DataFrame) -> DataFrame:
    """``(term, id, type, name, ord)``: every node under its folded name and aliases, once each."""
    named = nodes.filter(F.col("name").isNotNull() & F.col("type").isNotNull())
    terms = F.array_distinct(F.transform(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))), F.lower))
    return named.select("id", "type", "name", "ord", F.explode(terms).alias("term"))


def entity_names(entities: DataFrame, limit: int = KNOWN_NAMES) -> DataFrame:
    """``(type, name, place)``: the first alias of each entity (type, aliases, ord), distinct by type, the first ``limit`` to come.

    Only a name and its first place are sorted, ``limit`` of a type at most leave a task.
    """
    named = entities.select("type", F.try_element_at("aliases", F.lit(1)).alias("name"), "ord").filter("name is not null")
    first = named.groupBy("type", "name").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("type").orderBy("ord", "name"))
    return first.withColumn("place", place).filter(F.col("place") <= limit).select("type", "name", "place")


def alias_hits(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that any of ``terms`` names, by name or alias without regard to case; each once."""
    asked = terms.select(F.lower("term").alias("term")).distinct()
    hits = alias_index(nodes).join(asked, "term", "left_semi").select("id").distinct()
    return nodes.join(hits, "id", "left_semi")


def any_type_lookup(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """What each record (record, type, terms) is written as: ``outcome``, ``as_type``, ``as_name``.

    No node, or nodes of its own type only: its own. One other type: that one, named as the first hit. More: refused.
    """
    asked = records.select("record", F.col("type").alias("own_type"), F.explode("terms").alias("t")).select("record", "own_type", F.lower("t").alias("term")).distinct()
    hits = asked.join(alias_index(nodes), "term").groupBy("record", "own_type").agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.min(F.struct("ord", "name")).alias("first")
    )
    joined = records.join(hits.select("record", "types", "first"), "record", "left")
    other = F.array_except("types", F.array("type"))
    outcome = F.when(F.col("types").isNull() | (F.size(other) == 0), "own").when(F.size("types") > 1, "refused").otherwise("other")
    return joined.select("record", outcome.alias("outcome"), F.when(outcome == "refused", None).when(outcome == "other", F.col("types")[0]).otherwise(F.col("type")).alias("as_type"), F.when(outcome == "other", F.col("first.name")).alias("as_name"))


def relation_targets(relations: DataFrame, records: DataFrame, prefix: str) -> DataFrame:
    """Aliases by which each relation (source, own_type, target_type, target) names its target.

    Another type is named by the text alone. Of the own type, the record whose identity it is, else the one record of that
    name or alias, else the text and the identity it would have. Records have ``identity, name, aliases``.
    """
    identity = F.concat(F.lit(prefix + ":"), F.col("target"))
    same = relations.withColumn("_identity", identity)
    by_identity = records.select(F.col("identity").alias("_identity"), F.col("aliases").alias("_own"))
    named = records.select("identity", "aliases", F.explode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("target"))
    by_name = named.groupBy("target").agg(F.count_distinct("identity").alias("_n"), F.first("aliases").alias("_named")).filter("_n = 1").drop("_n")
    joined = same.join(by_identity, "_identity", "left").join(by_name, "target", "left")
    found = F.when(F.col("target_type") != F.col("own_type"), F.array("target")).otherwise(F.coalesce("_own", "_named", F.array("target", "_identity")))
    return joined.select("source", "own_type", "target_type", "target", found.alias("target_aliases"))


def known_names(store: DataFrame, run: DataFrame, cap: int = KNOWN_NAMES) -> DataFrame:
    """Names per type: the store's, then the run's that the store lacks, at most ``cap`` of the run's by arrival."""
    new = run.join(store.select("type", "name"), ["type", "name"], "left_anti").groupBy("type", "name").agg(F.min("ord").alias("ord"))
    n = F.row_number().over(Window.partitionBy("type").orderBy("ord", "name"))
    kept = new.withColumn("_n", n).filter(F.col("_n") <= cap)
    return store.select("type", "name", F.lit("store").alias("origin")).unionByName(kept.select("type", "name", F.lit("run").alias("origin")))


def alias_closure(things: DataFrame) -> DataFrame:
    """``(type, thing, component)``: things of one type that share an alias, over any number of steps, are one.

    Things (type, thing, alias) take the least thing of any of their aliases, and then the label that this one has, so
    that labels move twice as far in each round; it ends when no label changes, after about as many rounds as the
    logarithm of the longest chain. Each round writes its labels to the checkpoint folder.
    """
    labels = things.select("type", "thing").distinct().withColumn("component", F.col("thing"))
    while True:
        by_alias = things.join(labels, ["type", "thing"]).groupBy("type", "alias").agg(F.min("component").alias("component"))
        least = things.join(by_alias, ["type", "alias"]).groupBy("type", "thing").agg(F.min("component").alias("least"))
        moved = _saved(labels.join(least, ["type", "thing"]).select("type", "thing", "component", F.least("component", "least").alias("next")))
        if moved.filter("next <> component").isEmpty():
            dropped(moved)
            return labels
        # What joined a component brings its old label's things along, and every label moves on to its own label.
        hooked = moved.groupBy("type", "component").agg(F.min("next").alias("_hooked"))
        pulled = _saved(moved.join(hooked, ["type", "component"]).select("type", "thing", F.least("next", "_hooked").alias("component")))
        onward = pulled.select("type", F.col("thing").alias("component"), F.col("component").alias("_onward"))
        before, labels = labels, _saved(pulled.join(onward, ["type", "component"]).select("type", "thing", F.least("component", "_onward").alias("component")))
        dropped(before, moved, pulled)


def _saved(df: DataFrame) -> DataFrame:
    return saved(df, "labels")


def ancestors(edges: DataFrame) -> DataFrame:
    """``(child, ancestor, depth)`` over (child, parent): every ancestor once, at its least depth, however deep; cycles end."""
    step = edges.select("child", F.col("parent").alias("ancestor")).distinct()
    found = step.withColumn("depth", F.lit(1))
    now = found
    depth = 1
    while True:
        depth += 1
        reached = now.select("child", F.col("ancestor").alias("_via")).join(step.select(F.col("child").alias("_via"), "ancestor"), "_via")
        now = _saved(reached.select("child", "ancestor").distinct().join(found, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if now.isEmpty():
            return found
        found = found.unionByName(now)


def admitted_facts(facts: DataFrame, issued: DataFrame) -> DataFrame:
    """Facts (fact, evidence) that cite evidence, all of it issued."""
    cited = facts.select("fact", F.explode("evidence").alias("evidence_id"))
    unknown = cited.join(issued.select("evidence_id"), "evidence_id", "left_anti").select("fact").distinct()
    return facts.filter(F.size("evidence") > 0).join(unknown, "fact", "left_anti")

"""Records to entities and facts: a mapping is compiled to column expressions, so a listing maps in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.functions.masking import clean_json, mask, masked_count
from factline.functions.spans import let
from factline.functions.text import aliases, identity, text_hash
from factline.functions.values import KINDS, STRING, convert, render_strict, scalar_at, scalars_at, shape_name, with_scalars, worked_out


@dataclass(frozen=True)
class Property:
    """A property from a path of the record, in a kind of value."""

    name: str
    path: str
    kind: str = STRING

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"property {self.name}: there is no kind {self.kind!r}")


@dataclass(frozen=True)
class Relation:
    """A relation to things of a type, named by the scalars at a path."""

    name: str
    path: str
    target_type: str


@dataclass(frozen=True)
class Mapping:
    """How the records of one operation become entities and facts."""

    adapter: str
    operation: str
    node_type: str
    id: str
    name: str
    aliases: tuple[str, ...] = ()
    alias_templates: tuple[str, ...] = ()
    properties: tuple[Property, ...] = ()
    relations: tuple[Relation, ...] = ()
    parent_relation: str | None = None
    fields: tuple[str, ...] = field(default=())

    @property
    def prefix(self) -> str:
        return f"{self.adapter}:{self.operation}"


def mapped_records(records: DataFrame, mapping: Mapping, record: str = "record", order: str = "ord") -> DataFrame:
    """Records with a scalar id and name, first of a key first: identity, name, aliases, hash, converted properties.

    The record travels on, so facts are read from the same row; ``unconverted`` names the properties that don't convert.
    """
    json = F.col(record)
    paths = dict.fromkeys([mapping.id, mapping.name, *mapping.aliases, *(mapping.fields if mapping.alias_templates else ()), *(p.path for p in mapping.properties)])
    held = {path: f"_at{k}" for k, path in enumerate(paths)}
    mapped = [F.col(held[p]) for p in mapping.aliases]
    rendered = [render_strict(t, {f: F.col(held[f]) for f in mapping.fields}) for t in mapping.alias_templates]
    converted = {p: f"_converted{k}" for k, p in enumerate(mapping.properties)}
    key, name = held[mapping.id], held[mapping.name]
    values = F.array(*[F.struct(F.lit(p.name).alias("name"), F.lit(p.kind).alias("kind"), F.col(c)["value"].alias("value"), F.col(c)["ok"].alias("ok")) for p, c in converted.items()]) if converted else F.array().cast("array<struct<name:string,kind:string,value:string,ok:boolean>>")
    rows = with_scalars(records.select(record, order), record, {column: path for path, column in held.items()}).filter(F.col(key).isNotNull() & F.col(name).isNotNull())
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")
    first = worked_out(first, {c: convert(p.kind, F.col(held[p.path])) for p, c in converted.items()})
    own = identity(F.lit(mapping.prefix), F.col(key))
    out = first.select(
        own.alias("identity"), F.col(name).alias("name"), aliases(F.col(name), own, F.array(*mapped, *rendered) if mapped or rendered else F.array().cast("array<string>")).alias("aliases"),
        text_hash(json).alias("hash"), values.alias("properties"), json.alias("record"), F.col(order).alias("ord"),
    )
    return out.withColumn("unconverted", F.transform(F.filter("properties", lambda p: ~p["ok"]), lambda p: p["name"]))


#: The member of a record's text that holds its links.
LINKS = "factline.links"


def prepared(records: DataFrame, mapping: Mapping, time: str | None = None, record: str = "record") -> DataFrame:
    """``records`` with ``identity``, made of the raw id, the text cleaned, ``masked``, how many masks that took, and ``published``.

    A time is read from the cleaned text, so that none is stored that masking hides; without a path it is null.
    """
    raw = scalar_at(F.col(record), mapping.id)
    text = clean_json(F.col(record))
    read = records.withColumn("identity", identity(F.lit(mapping.prefix), F.coalesce(raw, F.lit("")), mask(F.coalesce(raw, F.lit(""))))).withColumn("_text", text)
    read = read.withColumn("masked", masked_count(F.col(record), F.col("_text"))).withColumn(record, F.col("_text")).drop("_text")
    return read.withColumn("published", scalar_at(F.col(record), time) if time else F.lit(None).cast("string"))


def linked(changes: DataFrame, links: DataFrame) -> DataFrame:
    """Changes (key, text) with their links (key, relation, tag, ord) written into the text, and ``unlinked``, the text without any.

    Both are written canonically, members in the order of their names and links each once in that of ``ord``, so that equal contents have
    equal hashes. What the text held as links before is replaced. A text that is no JSON object stays, and ``unlinked`` is null.
    """
    first = links.groupBy("key", "relation", "tag").agg(F.min("ord").alias("ord"))
    own = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "relation", "tag"))), lambda x: F.struct(x["relation"].alias("relation"), x["tag"].alias("tag"))).alias("_links"))
    joined = changes.join(own, "key", "left")
    members = F.from_json("text", "map<string,variant>")
    bare = F.map_from_entries(F.array_sort(F.transform(F.map_entries(F.map_filter(members, lambda k, v: k != LINKS)), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value")))))

    def written(entries: Column) -> Column:
        quoted = F.transform(entries, lambda e: F.concat(let(F.to_json(F.struct(e["key"].alias("k"))), lambda j: F.substring(j, F.lit(6), F.length(j) - 6)), F.lit(":"), e["value"]))
        return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))

    entries = F.map_entries(bare)
    link = F.when(F.col("_links").isNotNull(), F.array(F.struct(F.lit(LINKS).alias("key"), F.to_json("_links").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    is_object = F.coalesce(shape_name(F.try_parse_json(F.col("text"))) == "OBJECT", F.lit(False))
    out = joined.withColumn("unlinked", F.when(is_object, written(entries))).withColumn("_with", F.when(is_object, written(F.concat(entries, link))))
    return out.withColumn("text", F.coalesce("_with", "text")).drop("_with", "_links")


def links_of(text: Column) -> Column:
    """The links that a text holds, as an array of ``relation`` and ``tag``; members of another shape are left out."""
    held = F.from_json(F.get_json_object(text, f"$['{LINKS}']"), "array<struct<relation:string,tag:string>>")
    return F.filter(F.coalesce(held, F.array().cast("array<struct<relation:string,tag:string>>")), lambda e: e["relation"].isNotNull() & e["tag"].isNotNull())


def record_index(mapped: list[tuple[DataFrame, Mapping]], parents: DataFrame | None = None) -> DataFrame:
    """``(identity, type, name, aliases, parent, tags)`` of every record of several mappings, and what a lookup may name each by.

    ``parents`` has a record's parent (identity, parent); tags are those its text is linked to. ``names`` is the name first, then aliases
    without it: what a thing is looked up by.
    """
    rows = [m.select("identity", F.lit(spec.node_type).alias("type"), "name", "aliases", F.transform(links_of(F.col("record")), lambda e: e["tag"]).alias("tags")) for m, spec in mapped]
    every = reduce(DataFrame.unionByName, rows)
    if parents is None:
        every = every.withColumn("parent", F.lit(None).cast("string"))
    else:
        every = every.join(parents.groupBy("identity").agg(F.min("parent").alias("parent")), "identity", "left")
    return every.withColumn("names", F.array_distinct(F.concat(F.array("name"), "aliases")))


def kept(mapped: DataFrame) -> DataFrame:
    """Records all of whose properties convert; the others are left out and marked seen."""
    return mapped.filter(F.size("unconverted") == 0)


def entities(mapped: DataFrame, mapping: Mapping) -> DataFrame:
    """Each distinct (type, aliases) once."""
    return mapped.select(F.lit(mapping.node_type).alias("type"), "aliases").distinct()


def property_facts(mapped: DataFrame) -> DataFrame:
    """A row for each property with a value: ``subject, predicate, kind, value, evidence``."""
    one = mapped.select("identity", F.explode("properties").alias("p")).filter("p.value is not null and p.ok")
    return one.select(F.col("identity").alias("subject"), F.col("p.name").alias("predicate"), F.col("p.kind").alias("kind"), F.col("p.value").alias("value"), F.col("identity").alias("evidence"))


def relation_facts(mapped: DataFrame, mapping: Mapping) -> DataFrame:
    """A row for each scalar that a relation's path holds: ``subject, predicate, target_type, target, evidence``."""
    parts = [
        mapped.select(F.col("identity").alias("subject"), F.lit(r.name).alias("predicate"), F.lit(r.target_type).alias("target_type"), F.explode(scalars_at(F.col("record"), r.path)).alias("target"), F.col("identity").alias("evidence"))
        for r in mapping.relations
    ]
    if not parts:
        raise ValueError("the mapping has no relation")
    return reduce(DataFrame.unionAll, parts)


def parent_facts(children: DataFrame, parents: DataFrame, relation: str) -> DataFrame:
    """Each child (identity, parent) to all aliases of its parent, or to the parent's identity if it isn't listed."""
    named = parents.select(F.col("identity").alias("parent"), F.col("aliases").alias("_aliases"))
    joined = children.join(named, "parent", "left")
    return joined.select(F.col("identity").alias("subject"), F.lit(relation).alias("predicate"), F.coalesce("_aliases", F.array("parent")).alias("target_aliases"))


def ontology(mappings: list[Mapping]) -> tuple[dict[str, dict[str, str]], dict[str, tuple[set[str], set[str]]]]:
    """Node types with their properties in first-declared order, and edge types with the ends of all mappings joined."""
    nodes: dict[str, dict[str, str]] = {}
    edges: dict[str, tuple[set[str], set[str]]] = {}
    for m in mappings:
        own = nodes.setdefault(m.node_type, {})
        for p in m.properties:
            if own.setdefault(p.name, p.kind) != p.kind:
                raise ValueError(f"{m.node_type}.{p.name} is declared as {own[p.name]} and as {p.kind}")
        for r in m.relations:
            sources, targets = edges.setdefault(r.name, (set(), set()))
            sources.add(m.node_type)
            targets.add(r.target_type)
            nodes.setdefault(r.target_type, {})
    return nodes, edges


def fact_words(facts: DataFrame, names: DataFrame) -> DataFrame:
    """Facts in words: subject and object by name where they have one. Names are ``id, name``."""
    subject = names.select(F.col("id").alias("subject"), F.col("name").alias("_subject"))
    target = names.select(F.col("id").alias("value"), F.col("name").alias("_object"))
    joined = facts.join(subject, "subject", "left").join(target, "value", "left")
    return joined.select("subject", "predicate", "value", F.concat_ws(" ", F.coalesce("_subject", "subject"), "predicate", F.coalesce("_object", "value")).alias("words"))


def page_facts(pages: DataFrame) -> DataFrame:
    """Web pages (url, title, description, published) as facts of a WebPage each; absent values give none."""
    return pages.select(
        F.col("url").alias("subject"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("predicate"), F.col(c).cast("string").alias("value")) for c in ("url", "title", "description", "published")])).alias("f"),
    ).filter("f.value is not null").select("subject", "f.predicate", "f.value")


def column_of(kind: str, column: Column) -> Column:
    """A stored value as a typed column, for views."""
    types = {"Integer": "bigint", "Decimal": "decimal(38,10)", "Boolean": "boolean"}
    if kind == "Timestamp":
        return F.timestamp_millis(column.try_cast("bigint"))
    return column.try_cast(types[kind]) if kind in types else column

"""A graph snapshot read leniently, and its edges checked against its nodes.

Each item of a snapshot is a variant. A field is taken if it has the shape that it is to have; one of another shape reads as absent and
is counted, and so are the items of a list that aren't texts. Nothing fails on what another writer put there.

Defined cases: a snapshot that is no JSON, or whose parts are no objects, has no items; an item that is no object has no fields; null is
absent and isn't counted; ids may repeat in item tables (JSON lines), which the check reports; an edge without a source, type or
target is reported once for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.functions.values import shape_name

#: Fields of each kind of item: name, path, whether it is a list of texts.
FIELDS: dict[str, tuple[tuple[str, str, bool], ...]] = {
    "nodes": (("name", "$.canonical_name", False), ("type", "$.type_id", False), ("aliases", "$.aliases", True)),
    "edges": (("source", "$.source", False), ("type", "$.type_id", False), ("target", "$.target", False)),
    "assertions": (
        ("lifecycle", "$.lifecycle", False), ("evidence", "$.evidence", True), ("subject", "$.subject.Node", False), ("property", "$.predicate.Property", False),
        ("relation", "$.predicate.Relation", False), ("object", "$.object.Node", False),
    ),
    "evidence": (("identity", "$.source.HumanStatement.identity", False),),
}


def items(snapshots: DataFrame, text: str = "text") -> DataFrame:
    """``(kind, id, item)`` of whole snapshots, ``item`` a variant; a map of items gives a row each."""
    shape = "graph struct<graph struct<" + ", ".join(f"{k}: map<string,variant>" for k in FIELDS) + ">>"
    graph = F.from_json(F.col(text), shape, {"mode": "PERMISSIVE"})
    maps = F.array(*[F.struct(F.lit(k).alias("kind"), graph["graph"]["graph"][k].alias("some")) for k in FIELDS])
    return snapshots.select(F.explode(maps).alias("m")).select("m.kind", F.explode("m.some").alias("id", "item"))


def item_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """``(kind, id, item)`` of JSON lines ``{"kind": …, "id": …, "item": {…}}``, the form in which a large snapshot is kept."""
    parsed = F.from_json(F.col(text), "kind string, id string, item variant", {"mode": "PERMISSIVE"})
    return lines.select(parsed.alias("p")).select("p.kind", "p.id", "p.item").filter("kind is not null and id is not null")


def shape_of(value: Column) -> Column:
    """``STRING``, ``ARRAY``, ``OBJECT``, … of a variant; null where it is absent or null."""
    return F.nullif(shape_name(value), F.lit("VOID"))


def _at(path: str) -> Column:
    return F.try_variant_get("item", path, "variant")


def _text(value: Column) -> Column:
    return F.when(shape_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _texts(value: Column) -> Column:
    """The texts of a list, in order; none where it is no list."""
    every = F.try_variant_get(value, "$", "array<variant>")
    return F.when(shape_of(value) == "ARRAY", F.transform(F.filter(every, lambda v: shape_of(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))).otherwise(F.array().cast("array<string>"))


def read(items_: DataFrame, kind: str) -> DataFrame:
    """The items of a kind with their fields: ``id`` and a column for each, as ``FIELDS`` names them."""
    own = items_.filter(F.col("kind") == kind)
    # Each field is taken out of its item once.
    held = own.select("id", *[_at(path).alias(name) for name, path, _ in FIELDS[kind]])
    return held.select("id", *[(_texts if is_list else _text)(F.col(name)).alias(name) for name, _, is_list in FIELDS[kind]])


def malformed(items_: DataFrame) -> DataFrame:
    """``(kind, field, found)``: how many fields, and how many members of lists, are of another shape than they are to be."""

    def of(kind: str) -> DataFrame:
        own = items_.filter(F.col("kind") == kind)
        counts = []
        for name, path, is_list in FIELDS[kind]:
            shape = shape_of(_at(path))
            wrong = shape.isNotNull() & (shape != ("ARRAY" if is_list else "STRING"))
            n = wrong.cast("long")
            if is_list:
                members = F.try_variant_get("item", path, "array<variant>")
                n = F.when(shape == "ARRAY", F.size(F.filter(members, lambda v: F.coalesce(shape_of(v), F.lit("VOID")) != "STRING")).cast("long")).otherwise(n)
            counts.append(F.struct(F.lit(name).alias("field"), F.coalesce(F.sum(n), F.lit(0)).alias("found")))
        return own.agg(F.array(*counts).alias("c")).select(F.lit(kind).alias("kind"), F.explode("c").alias("c")).select("kind", "c.field", "c.found")

    return reduce(DataFrame.unionAll, map(of, FIELDS))


def edge_problems(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """``(id, at, problem)`` of nodes (id, type) and edges (id, source, type, target).

    ``at`` is ``node``, ``source``, ``target``, ``type`` or ``edge``. An id that stands twice is ``repeated id``; an end is ``absent``, a ``missing node``, or,
    where ``ends`` (type, source_type, target_type) allows no node of its type there, of the ``wrong type``; so is an edge whose type ``ends`` doesn't
    have (``unknown type``). Both ends of all edges meet the nodes in one join.
    """
    unlike = nodes.groupBy("id").agg(F.count("*").alias("n"), F.collect_set("type").alias("types"))
    twice = unlike.filter("n > 1").select("id", F.lit("node").alias("at"), F.lit("repeated id").alias("problem"))
    again = edges.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("edge").alias("at"), F.lit("repeated id").alias("problem"))
    both = edges.select("id", "type", F.explode(F.array(*[F.struct(F.lit(e).alias("at"), F.col(e).alias("node")) for e in ("source", "target")])).alias("e")).select("id", "type", "e.*")
    met = both.join(unlike.select(F.col("id").alias("node"), "types"), "node", "left")
    problem = F.when(F.col("node").isNull(), "absent").when(F.col("types").isNull(), "missing node")
    untyped = edges.filter("type is null").select("id", F.lit("type").alias("at"), F.lit("absent").alias("problem"))
    if ends is not None:
        allowed = ends.groupBy("type").agg(F.collect_set("source_type").alias("source"), F.collect_set("target_type").alias("target"))
        met = met.join(allowed, "type", "left")
        fits = F.when(F.col("at") == "source", F.col("source")).otherwise(F.col("target"))
        problem = problem.when(fits.isNotNull() & ~F.arrays_overlap(fits, "types"), "wrong type")
        unknown = edges.filter("type is not null").join(ends.select("type").distinct(), "type", "left_anti").select("id", F.lit("type").alias("at"), F.lit("unknown type").alias("problem"))
        untyped = untyped.unionByName(unknown)
    bad = met.withColumn("problem", problem).filter("problem is not null").select("id", "at", "problem")
    return twice.unionByName(again).unionByName(untyped).unionByName(bad)

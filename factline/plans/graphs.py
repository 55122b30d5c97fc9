"""Queries about a stored graph and the records in it: lenient reading, edges against nodes, records cleaned and linked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.operators import mapping
from factline.plans.registry import Registry, table
from factline.sources import snapshot

registry = Registry()
query = registry.query

# Customers and orders are nodes, an order's customer an edge; fields of another shape are planted in each column, nodes are left out,
# twice there, or of another type.
_ITEMS = """
with n as (
  select 'c' || c_custkey as id, case when c_custkey % 11 = 0 then '7' when c_custkey % 11 = 1 then 'null' else '"' || c_name || '"' end as name,
    case when c_custkey % 13 = 0 then '["Customer"]' when c_custkey % 13 = 1 then '"Vendor"' else '"Customer"' end as type,
    case c_custkey % 7 when 0 then '"one"' when 1 then '["a", 3, null, {"x": ["b"]}, "b"]' when 2 then '{}' else '["a"]' end as aliases, c_custkey as k
  from customer where c_custkey % 17 <> 0
  union all select 'o' || o_orderkey, '"order"', '"Order"', '[]', o_orderkey from orders),
nodes as (select 'nodes' as kind, id, '{"canonical_name": ' || name || ', "type_id": ' || type || ', "aliases": ' || aliases || ', "properties": {"deep": [1, {"a": 2}]}}' as item from n
  union all select 'nodes', 'c' || c_custkey, '{"type_id": "Customer"}' from customer where c_custkey % 23 = 3),
edges as (select 'edges' as kind, 'e' || o_orderkey as id, '{"source": ' || case when o_orderkey % 19 = 0 then '1.5' else '"o' || o_orderkey || '"' end || ', "type_id": '
    || case o_orderkey % 29 when 0 then 'true' when 1 then '"OTHER"' else '"PLACED_BY"' end || case when o_orderkey % 31 = 0 then '' else ', "target": "c' || o_custkey || '"' end || '}' as item from orders),
rest as (select 'evidence' as kind, 'v' || s_suppkey as id, case s_suppkey % 3 when 0 then '{"source": {"HumanStatement": {"identity": "record:' || s_suppkey || '"}}}' when 1 then '{"source": {"HumanStatement": "x"}}' else '[4]' end as item from supplier
  union all select 'assertions', 'a' || s_suppkey, '{"lifecycle": "Active", "evidence": ["v' || s_suppkey || '", 1], "subject": {"Node": "c1"}, "predicate": {"' || case when s_suppkey % 2 = 0 then 'Property' else 'Relation' end || '": "p"}, "object": {"Node": 5}}' from supplier)
"""
_ALL_ITEMS = "select * from nodes union all select * from edges union all select * from rest"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted items as JSON lines, read back: the same text as in SQL, built by the same expressions."""
    for name in ("customer", "orders", "supplier"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"graphs_{name}")
    sql = (_ITEMS + _ALL_ITEMS).replace("from customer", "from graphs_customer").replace("from orders", "from graphs_orders").replace("from supplier", "from graphs_supplier")
    line = F.concat(F.lit('{"kind": "'), "kind", F.lit('", "id": "'), "id", F.lit('", "item": '), "item", F.lit("}"))
    return snapshot.item_lines(spark.sql(sql).select(line.alias("text")))


@query(f"""
{_ITEMS}
select id, case when name like '"%' then replace(name, '"', '') end as name, case when type like '"%' then replace(type, '"', '') end as type,
  case when aliases like '["a", 3%' then 'a,b' when aliases = '["a"]' then 'a' else '' end as aliases from n
union all select 'c' || c_custkey, null, 'Customer', '' from customer where c_custkey % 23 = 3
""")
def snapshot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.read(_items(spark, sf_dir), "nodes").select("id", "name", "type", F.array_join("aliases", ",").alias("aliases"))


@query(f"""
{_ITEMS},
s as (select count(*) as n, count(*) filter (s_suppkey % 3 = 1) as x from supplier)
select 'nodes' as kind, 'name' as field, count(*) filter (name = '7') as found from n union all select 'nodes', 'type', count(*) filter (type like '[%') from n
union all select 'nodes', 'aliases', coalesce(sum(case when aliases like '["a", 3%' then 3 when aliases in ('"one"', '{{}}') then 1 else 0 end), 0) from n
union all select 'edges', 'source', count(*) filter (o_orderkey % 19 = 0) from orders union all select 'edges', 'type', count(*) filter (o_orderkey % 29 = 0) from orders union all select 'edges', 'target', 0
union all select 'assertions', f, case when f in ('evidence', 'object') then n else 0 end from s, (values ('lifecycle'), ('evidence'), ('subject'), ('property'), ('relation'), ('object')) t(f)
union all select 'evidence', 'identity', 0
""")
def snapshot_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.malformed(_items(spark, sf_dir))


@query(f"""
{_ITEMS},
t as (select id, case when type like '"%' then replace(type, '"', '') end as type from n union all select 'c' || c_custkey, 'Customer' from customer where c_custkey % 23 = 3),
u as (select id, count(*) as n, list(type) filter (type is not null) as types from t group by id),
e as (select 'e' || o_orderkey as id, case when o_orderkey % 19 <> 0 then 'o' || o_orderkey end as source, case o_orderkey % 29 when 0 then null when 1 then 'OTHER' else 'PLACED_BY' end as type,
  case when o_orderkey % 31 <> 0 then 'c' || o_custkey end as target from orders)
select id, 'node' as at, 'repeated id' as problem from u where n > 1
union all select id, 'type', case when type is null then 'absent' else 'unknown type' end from e where type is null or type = 'OTHER'
union all select id, 'source', 'absent' from e where source is null union all select id, 'target', 'absent' from e where target is null
union all select e.id, 'target', 'missing node' from e where target is not null and target not in (select id from u)
union all select e.id, 'target', 'wrong type' from e join u on u.id = e.target where e.type = 'PLACED_BY' and not list_contains(coalesce(u.types, []), 'Customer')
""")
def edge_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    ends = spark.createDataFrame([("PLACED_BY", "Order", "Customer")], "type string, source_type string, target_type string")
    return snapshot.edge_problems(snapshot.read(items, "nodes"), snapshot.read(items, "edges"), ends)


# Every document is a record with its text at three depths, a key that a secret's name is in, and secrets at two.
_RECORD = """'{"id": ' || doc_id || ', "password=Zr4p0p0p0": {"note": ' || {json} || ', "more": [1.50, null, "glpat-' || {digest} || '", {"a": ["token=Zr4p0p0p0", true]}]}, "a\\\\u0022b": "{x}"}'"""


@query(
    "select doc_id, sha256("
    + _RECORD.replace("{json}", "cast(to_json('note ' || doc_id || chr(10) || '\"q\" é') as varchar)").replace("glpat-' || {digest} || '", "[masked:gitlab-token]").replace("token=Zr4p0p0p0\", true", "token=[masked:secret-assignment]\", true").replace("\\\\u", "\\u")
    + ") as hash, cast(2 as bigint) as masked from documents"
)
def cleaned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.to_json(F.struct(F.concat(F.lit("note "), "doc_id", F.lit('\n"q" é')).alias("v")))
    record = F.concat(
        F.lit('{"id": '), "doc_id", F.lit(', "password=Zr4p0p0p0": {"note": '), F.substring(note, F.lit(6), F.length(note) - 6), F.lit(', "more": [1.50, null, "glpat-'),
        F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 24), F.lit('", {"a": ["token=Zr4p0p0p0", true]}]}, "a\\u0022b": "{x}"}'),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", record.alias("record"))
    people = mapping.Mapping(adapter="d", operation="docs", node_type="Document", id="id", name="id")
    return mapping.prepared(docs, people).select("doc_id", F.sha2("record", 256).alias("hash"), F.col("masked").cast("long").alias("masked"))


@query("""
with o as (select o_orderkey as k, '{"id":' || o_orderkey || ',"state":"' || o_orderstatus || '"}' as bare from orders),
l as (select l_orderkey as k, string_agg('{"relation":"' || case l_linenumber % 2 when 0 then 'IN' else 'OF' end || '","tag":"s' || l_suppkey || '"}', ',' order by first, l_linenumber % 2, 's' || l_suppkey) as links, count(*) as n
  from (select l_orderkey, l_linenumber % 2 as l_linenumber, l_suppkey, min(l_linenumber) as first from lineitem group by 1, 2, 3) group by 1)
select 'o' || o.k as key, sha256(case when l.links is null then bare else '{' || substr(bare, 2, length(bare) - 2) || ',"factline.links":[' || links || ']}' end) as hash, sha256(bare) as unlinked_hash, coalesce(n, 0) as links
from o left join l on l.k = o.k
""")
def linked_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    text = F.concat(F.lit('{"state": "'), "o_orderstatus", F.lit('", "factline.links": [{"relation": "old", "tag": "x"}], "id": '), "o_orderkey", F.lit("}"))
    changes = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("key"), text.alias("text"))
    lines = table(spark, sf_dir, "lineitem")
    relation = F.when(F.col("l_linenumber") % 2 == 0, "IN").otherwise("OF")
    links = lines.select(F.concat(F.lit("o"), "l_orderkey").alias("key"), relation.alias("relation"), F.concat(F.lit("s"), "l_suppkey").alias("tag"), F.col("l_linenumber").alias("ord"))
    done = mapping.linked(changes, links)
    return done.select("key", F.sha2("text", 256).alias("hash"), F.sha2("unlinked", 256).alias("unlinked_hash"), F.size(mapping.links_of(F.col("text"))).cast("long").alias("links"))


@query("""
select 'shop:suppliers:' || s_suppkey as identity, 'Supplier' as type, s_name || '|' || s_name || ' (shop:suppliers:' || s_suppkey || ')|shop:suppliers:' || s_suppkey || case when s_suppkey % 2 = 0 then '|h' || s_suppkey else '' end as names,
  'n' || s_nationkey as parent, case when s_suppkey % 3 = 0 then 'v' || s_nationkey else '' end as tags from supplier
union all select 'shop:nations:' || n_nationkey, 'Nation', n_name || '|' || n_name || ' (shop:nations:' || n_nationkey || ')|shop:nations:' || n_nationkey, null, '' from nation
""")
def record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = mapping.Mapping(adapter="shop", operation="suppliers", node_type="Supplier", id="id", name="name", aliases=("handle",))
    nations = mapping.Mapping(adapter="shop", operation="nations", node_type="Nation", id="id", name="name")
    s = table(spark, sf_dir, "supplier")
    links = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.struct(F.lit("IN").alias("relation"), F.concat(F.lit("v"), "s_nationkey").alias("tag"))))
    handle = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("h"), "s_suppkey"))
    of_suppliers = s.select(F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), handle.alias("handle"), links.alias(mapping.LINKS))).alias("record"), F.col("s_suppkey").alias("ord"))
    of_nations = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("record"), F.col("n_nationkey").alias("ord"))
    parents = s.select(F.concat(F.lit("shop:suppliers:"), "s_suppkey").alias("identity"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    every = mapping.record_index([(mapping.mapped_records(of_suppliers, suppliers), suppliers), (mapping.mapped_records(of_nations, nations), nations)], parents)
    return every.select("identity", "type", F.array_join("names", "|").alias("names"), "parent", F.array_join("tags", ",").alias("tags"))

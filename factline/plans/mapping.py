"""Queries that map records to facts and link them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions import values
from factline.functions.text import aliases, content_hash, identity, text_hash
from factline.functions.times import document_time_ms, epoch_ms, observed_at, rfc3339
from factline.operators import linking, mapping
from factline.plans.registry import Registry, table

registry = Registry()
query = registry.query

ORDERS = mapping.Mapping(
    adapter="shop", operation="orders", node_type="Order", id="id", name="name",
    properties=(
        mapping.Property("status", "status"), mapping.Property("total", "total", values.DECIMAL),
        mapping.Property("ordered_at", "ordered_at", values.TIMESTAMP), mapping.Property("priority", "priority"),
    ),
    relations=(mapping.Relation("PLACED_BY", "customer.name", "Customer"),),
)


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON records, as an adapter would list them."""
    o = table(spark, sf_dir, "orders")
    record = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("status"),
            F.format_string("%.2f", "o_totalprice").alias("total"), rfc3339(epoch_ms(F.col("o_orderdate"))).alias("ordered_at"), F.col("o_orderpriority").alias("priority"),
            F.struct(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("name")).alias("customer"),
        )
    )
    return o.select(record.alias("record"), F.col("o_orderkey").alias("ord"))


@query("""
select 'shop:orders:' || o_orderkey as subject, p.predicate, p.kind, p.value from orders, lateral (
  select 'status' as predicate, 'String' as kind, o_orderstatus as value
  union all select 'total', 'Decimal', printf('%.2f', o_totalprice)
  union all select 'ordered_at', 'Timestamp', cast(epoch_ms(o_orderdate) as varchar)
  union all select 'priority', 'String', o_orderpriority) p
where trim(p.value) <> ''
""")
def map_order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = mapping.kept(mapping.mapped_records(order_records(spark, sf_dir), ORDERS))
    return mapping.property_facts(mapped).select("subject", "predicate", "kind", "value")


@query("""
select 'shop:orders:' || o_orderkey as subject, 'PLACED_BY' as predicate, 'Customer' as target_type, 'customer ' || o_custkey as target from orders
""")
def map_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = mapping.mapped_records(order_records(spark, sf_dir), ORDERS)
    return mapping.relation_facts(mapped, ORDERS).select("subject", "predicate", "target_type", "target")


@query("""
select 'Order' as type, 'order ' || o_orderkey || ' (shop:orders:' || o_orderkey || ')|shop:orders:' || o_orderkey as aliases from orders
""")
def map_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = mapping.mapped_records(order_records(spark, sf_dir), ORDERS)
    return mapping.entities(mapped, ORDERS).select("type", F.array_join("aliases", "|").alias("aliases"))


@query("""
select 'shop:orders/items:' || l_orderkey || ':' || l_linenumber as subject, 'PART_OF' as predicate,
  case when l_orderkey % 10 <> 0 then 'order ' || l_orderkey || ' (shop:orders:' || l_orderkey || ')|shop:orders:' || l_orderkey
    else 'shop:orders:' || l_orderkey end as target_aliases
from lineitem
""")
def map_parent_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    own = identity(F.lit("shop:orders"), key)
    parents = table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0").select(own.alias("identity"), aliases(F.concat(F.lit("order "), key), own, F.array().cast("array<string>")).alias("aliases"))
    items = table(spark, sf_dir, "lineitem")
    child = F.concat_ws(":", F.lit("shop:orders/items"), "l_orderkey", "l_linenumber")
    children = items.select(child.alias("identity"), identity(F.lit("shop:orders"), F.col("l_orderkey").cast("string")).alias("parent"))
    return mapping.parent_facts(children, parents, "PART_OF").select("subject", "predicate", F.array_join("target_aliases", "|").alias("target_aliases"))


@query("""
select 'crm:customers:' || c_custkey as identity,
  c_name || ' (crm:customers:' || c_custkey || ')|crm:customers:' || c_custkey || case when c_custkey % 3 = 0 then '|' || n_name else '' end as aliases
from customer join nation on c_nationkey = n_nationkey
""")
def entity_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = identity(F.lit("crm:customers"), F.col("c_custkey").cast("string"))
    mapped = F.array(F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")), own)
    return joined.select(own.alias("identity"), F.array_join(aliases(F.col("c_name"), own, mapped), "|").alias("aliases"))


@query("""
with r as (select event_id, case event_id % 6 when 0 then json_extract_string(props, '$.k') when 1 then '  ' when 2 then 'x1' when 3 then 'TRUE' when 4 then '1.50' else '-7' end as raw from events)
select event_id,
  case when regexp_full_match(raw, '[+-]?[0-9]+') then cast(try_cast(raw as bigint) as varchar) end as int_value,
  trim(raw) = '' or (regexp_full_match(raw, '[+-]?[0-9]+') and try_cast(raw as bigint) is not null) as int_ok,
  case when regexp_full_match(raw, '[+-]?[0-9]+([.][0-9]+)?') then raw end as dec_value,
  trim(raw) = '' or regexp_full_match(raw, '[+-]?[0-9]+([.][0-9]+)?') as dec_ok,
  case when lower(raw) in ('true', 'false') then lower(raw) end as bool_value,
  trim(raw) = '' or lower(raw) in ('true', 'false') as bool_ok
from r
""")
def convert_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 6
    raw = F.when(n == 0, values.at(F.col("props"), "k")).when(n == 1, "  ").when(n == 2, "x1").when(n == 3, "TRUE").when(n == 4, "1.50").otherwise("-7")
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    out = [values.convert(k, F.col("raw")) for k in (values.INTEGER, values.DECIMAL, values.BOOLEAN)]
    names = ("int", "dec", "bool")
    return rows.select("event_id", *[c[f].alias(f"{name}_{f}") for name, c in zip(names, out, strict=True) for f in ("value", "ok")])


@query("select doc_id, sha256(text) as hash, sha256('factline.payload.v1' || text) as payload_hash from documents")
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text_hash(F.col("text")).alias("hash"), content_hash(F.encode("text", "utf-8")).alias("payload_hash"))


@query("select event_id, json_extract_string(props, '$.k') as k, null::varchar as missing from events")
def json_path_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", values.scalar_at(F.col("props"), "$.k").alias("k"), values.scalar_at(F.col("props"), "a.b").alias("missing"))


@query("""
select p_partkey, coalesce(name, '') || ' [' || p_brand || ']  {open' as lenient, name || '/' || p_type as strict
from (select *, case when p_partkey % 5 <> 0 then p_name end as name from part)
""")
def render_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    fields = {"name": F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")), "brand": F.col("p_brand"), "type": F.col("p_type")}
    lenient = values.render("{name} [{brand}] {missing} {open", fields)
    return parts.select("p_partkey", lenient.alias("lenient"), values.render_strict("{name}/{type}", fields).alias("strict"))


_TIMES = (
    "2024-03-01", "2024-03-01T10:20:30Z", "2024-03-01t10:20:30.98765+02:00", "1709288430", "2024-02-30T00:00:00Z", "2024-03-01 10:20:30-05:30", "soon", "1709288430.25",
)


@query("""
with t(n, raw) as (values (0, '2024-03-01'), (1, '2024-03-01T10:20:30Z'), (2, '2024-03-01t10:20:30.98765+02:00'), (3, '1709288430'), (4, '2024-02-30T00:00:00Z'),
  (5, '2024-03-01 10:20:30-05:30'), (6, 'soon'), (7, '1709288430.25')),
e(n, ms) as (values (0, 1709251200000), (1, 1709288430000), (2, 1709281230987), (3, 1709288430000), (4, null), (5, 1709308230000), (6, null), (7, 1709288430250))
select doc_id, cast(e.ms as bigint) as time_ms, cast(case when e.ms <= 1709290000000 then e.ms else 1709290000000 end as bigint) as observed_ms
from documents join t on doc_id % 8 = t.n join e on e.n = t.n
""")
def document_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(t) for t in _TIMES]), (F.col("doc_id") % len(_TIMES) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", document_time_ms(raw).alias("time_ms"))
    return docs.select("doc_id", "time_ms", observed_at(F.col("time_ms"), 1_709_290_000_000).alias("observed_ms"))


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderdate >= timestamp '2001-01-01' and o_orderkey % 11 <> 0)")
def follow_within_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    failed = orders.filter("l_orderkey % 11 = 0")
    rule = F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    return linking.follow(orders, table(spark, sf_dir, "lineitem"), "l_orderkey", rule, failed).select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_totalprice >= 400000)")
def follow_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return linking.follow(orders, table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("o_totalprice") >= 400_000).select("l_orderkey", "l_linenumber")


@query("""
with tags as (select user_id, event_id, (epoch_us(ts) // 1000) as t from events where event_type = 'purchase'),
stop as (select user_id, min({'t': t, 'e': event_id}) as s from tags where event_id % 40 = 0 group by user_id),
good as (select g.* from tags g left join stop s on g.user_id = s.user_id where s.s is null or {'t': g.t, 'e': g.event_id} < s.s)
select c.user_id as parent, c.event_id as change, (select arg_min(g.event_id, {'t': g.t, 'e': g.event_id}) from good g where g.user_id = c.user_id and g.t >= epoch_ms(c.ts)) as tag
from events c where c.event_type = 'click'
  and exists (select 1 from good g where g.user_id = c.user_id and g.t >= epoch_ms(c.ts))
""")
def compare_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("time", epoch_ms(F.col("ts"))).withColumnRenamed("user_id", "parent")
    tags = events.filter("event_type = 'purchase'").select("parent", F.col("event_id").alias("tag"), "time")
    changes = events.filter("event_type = 'click'").select("parent", F.col("event_id").alias("change"), "time")
    return linking.compare_links(changes, tags, tags.filter("tag % 40 = 0").select("parent", "tag"))


def _geo_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.lit("Nation").alias("type"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("N"), F.col("n_nationkey"))).alias("aliases"), F.col("n_nationkey").cast("bigint").alias("ord"))
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit("Region").alias("type"), F.col("r_name").alias("name"), F.array(F.concat(F.lit("NATION_"), F.col("r_regionkey") * 3)).alias("aliases"), (F.col("r_regionkey") + 100).cast("bigint").alias("ord"))
    return nation.unionByName(region)


_GEO_SQL = """
geo as (select 'n' || n_nationkey as id, 'Nation' as type, n_name as name, 'N' || n_nationkey as alias, n_nationkey as ord from nation
  union all select 'r' || r_regionkey, 'Region', r_name, 'NATION_' || (r_regionkey * 3), r_regionkey + 100 from region),
geo_terms as (select distinct id, type, name, ord, lower(unnest([name, alias])) as term from geo)
"""


@query(f"""
with {_GEO_SQL}
select distinct id, type from geo_terms where term in (select 'nation_' || s_nationkey from supplier)
""")
def alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Nation_"), F.col("s_nationkey")).alias("term"))
    return linking.alias_hits(terms, _geo_nodes(spark, sf_dir)).select("id", "type")


@query(f"""
with {_GEO_SQL},
rec as (select s_suppkey as record, case when s_suppkey % 2 = 0 then 'Supplier' else 'Nation' end as type, lower('NATION_' || s_nationkey) as t1, lower(s_name) as t2 from supplier),
hits as (select record, list_sort(list(distinct g.type)) as types, arg_min(g.name, {{'o': g.ord, 'n': g.name}}) as first
  from rec join geo_terms g on g.term in (rec.t1, rec.t2) group by record)
select rec.record, case when types is null or types = [type] then 'own' when len(types) > 1 then 'refused' else 'other' end as outcome,
  case when types is null or types = [type] then type when len(types) > 1 then null else types[1] end as as_type,
  case when types is null or types = [type] or len(types) > 1 then null else first end as as_name
from rec left join hits on rec.record = hits.record
""")
def any_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("record"), F.when(F.col("s_suppkey") % 2 == 0, "Supplier").otherwise("Nation").alias("type"),
        F.array(F.concat(F.lit("NATION_"), F.col("s_nationkey")), F.col("s_name")).alias("terms"),
    )
    return linking.any_type_lookup(records, _geo_nodes(spark, sf_dir))


@query("""
with rec as (select 'geo:nation:' || n_nationkey as identity, 'NATION_' || (n_nationkey % 20) as name from nation),
unique_names as (select name, min(identity) as identity from rec group by name having count(*) = 1),
rel as (select c_custkey as source, case when c_custkey % 2 = 0 then 'Nation' else 'Customer' end as own_type,
  case c_custkey % 3 when 0 then cast(c_nationkey as varchar) when 1 then 'NATION_' || c_nationkey else 'X' || c_nationkey end as target from customer)
select source, own_type, 'Nation' as target_type, target,
  case when own_type <> 'Nation' then target when r.identity is not null then r.identity when u.identity is not null then u.identity
    else target || '|geo:nation:' || target end as target_aliases
from rel left join rec r on r.identity = 'geo:nation:' || rel.target left join unique_names u on u.name = rel.target
""")
def target_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("geo:nation:"), F.col("n_nationkey"))
    records = table(spark, sf_dir, "nation").select(own.alias("identity"), F.concat(F.lit("NATION_"), F.col("n_nationkey") % 20).alias("name"), F.array(own).alias("aliases"))
    n = F.col("c_custkey") % 3
    target = F.when(n == 0, F.col("c_nationkey").cast("string")).when(n == 1, F.concat(F.lit("NATION_"), F.col("c_nationkey"))).otherwise(F.concat(F.lit("X"), F.col("c_nationkey")))
    relations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.when(F.col("c_custkey") % 2 == 0, "Nation").otherwise("Customer").alias("own_type"), F.lit("Nation").alias("target_type"), target.alias("target"))
    found = linking.relation_targets(relations, records, "geo:nation")
    return found.withColumn("target_aliases", F.array_join("target_aliases", "|"))


@query("""
with s as (select distinct p_brand as type, p_name as name from part where p_partkey % 4 = 0),
r as (select p_brand as type, p_name as name, min(p_partkey) as ord from part p where not exists (select 1 from s where s.type = p.p_brand and s.name = p.p_name) group by 1, 2),
n as (select *, row_number() over (partition by type order by ord, name) as k from r)
select type, name, 'store' as origin from s union all select type, name, 'run' from n where k <= 5
""")
def known_merge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return linking.known_names(parts.filter("ord % 4 = 0").select("type", "name").distinct(), parts, 5)


@query("""
with recursive things as (select p_brand as type, p_partkey as thing, p_name as alias from part union all select p_brand, p_partkey, 'size ' || p_size || p_type from part),
edges as (select distinct a.type, a.thing as x, b.thing as y from things a join things b on a.type = b.type and a.alias = b.alias),
reach as (select type, x, y from edges union select r.type, r.x, e.y from reach r join edges e on r.type = e.type and r.y = e.x)
select type, x as thing, min(y) as component from reach group by type, x
""")
def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_brand").alias("type"), F.col("p_partkey").alias("thing"), F.col("p_name").alias("alias"))
    sizes = p.select(F.col("p_brand").alias("type"), F.col("p_partkey").alias("thing"), F.concat(F.lit("size "), F.col("p_size"), F.col("p_type")).alias("alias"))
    return linking.alias_closure(names.unionByName(sizes)).select("type", "thing", "component")


@query("""
with recursive edges as (select 'n' || n_nationkey as child, 'n' || (n_nationkey // 2) as parent from nation union all select 'n' || n_nationkey, 'r' || n_regionkey from nation),
up as (select child, parent as ancestor, 1 as depth from edges union select u.child, e.parent, u.depth + 1 from up u join edges e on u.ancestor = e.child where u.depth < 12)
select child, ancestor, cast(min(depth) as integer) as depth from up group by child, ancestor
""")
def ontology_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    child = F.concat(F.lit("n"), F.col("n_nationkey")).alias("child")
    up = n.select(child, F.concat(F.lit("n"), F.floor(F.col("n_nationkey") / 2)).alias("parent"))
    return linking.ancestors(up.unionByName(n.select(child, F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"))))


@query("""
select l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey as fact from lineitem where l_orderkey % 17 <> 0 and l_partkey % 5 <> 0 and l_suppkey % 6 <> 0
""")
def admitted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    p, s = F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey"))
    evidence = F.when(F.col("l_orderkey") % 17 == 0, F.array().cast("array<string>")).otherwise(F.array(p, s))
    facts = items.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact"), evidence.alias("evidence"))
    issued = items.filter("l_partkey % 5 <> 0").select(p.alias("evidence_id")).unionAll(items.filter("l_suppkey % 6 <> 0").select(s)).distinct()
    return linking.admitted_facts(facts, issued).select("fact")


@query("""
select 'shop:orders:' || o_orderkey as subject, 'PLACED_BY' as predicate, coalesce(c_name, 'customer ' || o_custkey) as value,
  'order ' || o_orderkey || ' PLACED_BY ' || coalesce(c_name, 'customer ' || o_custkey) as words
from orders left join customer on o_custkey = c_custkey
""")
def fact_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    facts = o.select(F.concat(F.lit("shop:orders:"), F.col("o_orderkey")).alias("subject"), F.lit("PLACED_BY").alias("predicate"), F.concat(F.lit("customer "), F.col("o_custkey")).alias("value"))
    names = o.select(F.concat(F.lit("shop:orders:"), F.col("o_orderkey")).alias("id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("name"))
    names = names.unionByName(c.select(F.concat(F.lit("customer "), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name")))
    found = mapping.fact_words(facts, names)
    return found.select("subject", "predicate", F.regexp_replace("words", "^.* PLACED_BY ", "").alias("value"), "words")

"""Queries about what a model or a reviewer gave back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.operators import analytics, ordered, reviewing
from factline.operators.linking import known_names
from factline.plans.registry import Registry, table
from factline.sources.pages import percent_decoded

registry = Registry()
query = registry.query


@query("select doc_id from documents order by sha256('7:' || doc_id), doc_id limit 25")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25, 7)


@query("""
select o_orderkey as proposal, 'e' || (o_orderkey % 4 + 1) || ',' || 'e' || (o_orderkey % 3 + 1) as evidence from orders
where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 4 <> o_orderkey % 3
union all select o_orderkey, 'e' || (o_orderkey % 4 + 1) from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 4 = o_orderkey % 3
""")
def cited_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    second = F.when(key % 7 == 0, F.lit("E9")).otherwise(F.concat(F.lit("E"), key % 3 + 1))
    facts = F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("f")))
    proposals = table(spark, sf_dir, "orders").select(key.alias("proposal"), F.lit(1).alias("batch"), F.array(F.concat(F.lit("E"), key % 4 + 1), second).alias("labels"), facts.alias("facts"))
    evidence = spark.createDataFrame([(1, n, f"e{n}") for n in range(1, 5)], "batch int, n long, evidence_id string")
    return reviewing.cited(proposals, evidence).select("proposal", F.array_join("evidence", ",").alias("evidence"))


@query("""
with owners as (select l_orderkey as batch, case when l_linenumber % 2 = 0 then 'facts' else 'entities' end as kind, l_linenumber as n, l_partkey as record from lineitem),
items as (select o_orderkey as batch, case o_orderkey % 4 when 0 then 'facts' when 1 then 'entities' when 2 then 'ontology' end as kind, o_orderkey % 6 as n from orders where o_orderkey % 4 < 3)
select distinct o.batch, o.record from owners o join items i on o.batch = i.batch and (i.kind = 'ontology' or (i.kind = o.kind and i.n = o.n))
""")
def refused_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderkey % 4 < 3")
    owners = lines.select(F.col("l_orderkey").alias("batch"), F.when(F.col("l_linenumber") % 2 == 0, "facts").otherwise("entities").alias("kind"), F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_partkey").alias("record"))
    kind = F.element_at(F.array(F.lit("facts["), F.lit("entities["), F.lit("ontology")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    item = F.when(F.col("o_orderkey") % 4 == 2, kind).otherwise(F.concat(kind, F.col("o_orderkey") % 6, F.lit("].object")))
    return reviewing.refused_records(orders.select(F.col("o_orderkey").alias("batch"), item.alias("item")), owners)


@query("select doc_id from documents where doc_id % 4 in (0, 1, 2)")
def keys_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id")).alias("key"))
    front = F.element_at(F.array(F.lit(""), F.lit("file:"), F.lit("record:"), F.lit("other:")), (F.col("doc_id") % 4 + 1).cast("int"))
    return reviewing.with_evidence(docs, docs.select(F.concat(front, F.col("key")).alias("identity"))).select("doc_id")


@query("""
select min(p_partkey) as ord, arg_min(upper(p_type), p_partkey) as name from part where lower(p_type) not in (select lower(p_type) from part where p_partkey % 10 = 3 and p_size < 10) group by lower(p_type)
""")
def missing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    asked = parts.select(F.col("p_partkey").alias("ord"), F.upper("p_type").alias("name"))
    return reviewing.missing_types(asked, parts.filter("p_partkey % 10 = 3 and p_size < 10").select(F.lower("p_type").alias("name")))


@query("""
select item_id as "case", case when item_id % 3 = 0 then 'missing' when item_id % 3 = 1 then 'used' else 'otherwise' end as state from benchmark
""")
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case"), F.col("text").alias("question"))
    answers = cases.filter("`case` % 3 <> 0").withColumn("question", F.when(F.col("case") % 3 == 1, F.col("question")).otherwise(F.concat("question", F.lit("?"))))
    return reviewing.replayed(cases, answers)


@query("""
select doc_id, left(text, list_max(list_filter(range(0, 22), lambda k: strlen(left(text, k)) <= 21))) as cut from documents
""")
def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", reviewing.cut_bytes(F.col("text"), 21).alias("cut"))


@query("""
with s as (select distinct p_brand as type, p_name as name from part where p_partkey % 4 = 0),
r as (select distinct p_brand as type, p_name as name from part p where not exists (select 1 from s where s.type = p.p_brand and s.name = p.p_name)),
k as (select *, 0 as rank from s union all select *, 1 from r)
select type, type || ': ' || string_agg(name, '; ' order by rank, name) as line from k group by type
""")
def known_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return reviewing.known_lines(known_names(parts.filter("ord % 4 = 0").select("type", "name").distinct(), parts, 10_000))


@query("""
with f as (select p_name as entity, p_brand as record, min(p_partkey) as ord from part group by 1, 2)
select entity, string_agg(record, ',' order by ord) as records from f group by entity
""")
def entity_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("entity"), F.col("p_brand").alias("record"), F.col("p_partkey").alias("ord"))
    return reviewing.first_owners(parts).select("entity", F.array_join("records", ",").alias("records"))


@query("""
with f as (select user_id as batch, event_type as text, min(event_id) as ord from events group by 1, 2)
select batch, string_agg(text, '; ' order by ord) as refusals from f group by batch
""")
def joined_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewing.joined_refusals(table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("ord"), F.col("event_type").alias("text")))


@query("select exists (select 1 from nation where n_nationkey % 2 = 0) and exists (select 1 from nation where n_nationkey % 3 = 0 and n_nationkey % 2 = 1) as respelled")
def respelled_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("input"), "n_nationkey")
    return reviewing.respelled(n.filter("n_nationkey % 3 <> 0"), n.filter("n_nationkey % 2 = 1"))


@query("""
select user_id as figure, cast(row_number() over (partition by user_id order by event_id // 10, event_id) as integer) as place, event_type as label from events
qualify place <= 20
""")
def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("figure"), F.floor(F.col("event_id") / 10).alias("at_ms"), F.col("event_id").alias("ord"), F.col("event_type").alias("label"))
    return reviewing.timeline(entries, 20)


@query("""
select o_orderkey, case when a_major <> 1 then a_major > 1 when a_minor <> 2 then a_minor > 2 else false end as newer
from (select o_orderkey, o_orderkey % 3 as a_major, o_orderkey % 5 as a_minor from orders where not (o_orderkey % 3 = 1 and o_orderkey % 5 = 2))
""")
def newer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("not (o_orderkey % 3 = 1 and o_orderkey % 5 = 2)")
    left = F.concat_ws(".", (F.col("o_orderkey") % 3).cast("string"), (F.col("o_orderkey") % 5).cast("string"), F.lit("7-rc1"))
    return o.select("o_orderkey", ordered.newer_version(left, F.lit("v1.2.0")).alias("newer"))


@query("select page_id, 'a b/%zz+' || page_id as decoded from pages")
def decoded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", percent_decoded(F.concat(F.lit("a%20b%2F%zz+"), F.col("page_id"))).alias("decoded"))

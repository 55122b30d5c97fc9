"""Queries about failures between runs, what may be shown, and small rules of texts and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions.text import one_line, split_context
from factline.functions.times import window_placeholders
from factline.functions.sums import answer_tokens
from factline.operators import analytics, changes, lifecycle, linking, ordered, redaction
from factline.plans.lifecycle import _ASSIGNED
from factline.plans.registry import Registry, table

registry = Registry()
query = registry.query

# Every part is a document, and every third has failed before: some too often, some with another text.
_FAILURES = "f as (select p_partkey as key, case when p_partkey % 5 = 0 then 'old' else p_brand end as hash, p_partkey % 6 as runs, p_partkey % 4 as batches from part where p_partkey % 3 = 0)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("hash"))


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(key % 3 == 0).select(key.alias("key"), F.when(key % 5 == 0, "old").otherwise(F.col("p_brand")).alias("hash"), (key % 6).alias("runs"), (key % 4).alias("batches"))


@query(f"""
with {_FAILURES}
select p.p_partkey as key, coalesce(f.batches >= 2 or f.runs >= 1, false) as alone, coalesce(f.runs, 0) as failed_runs
from part p left join f on f.key = p.p_partkey where not exists (select 1 from f s where s.key = p.p_partkey and s.hash = p.p_brand and s.runs >= 3)
""")
def asked_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = _failures(spark, sf_dir)
    left = changes.without_skipped(_documents(spark, sf_dir), failures)
    return changes.asked_alone(left, failures).select("key", "alone", "failed_runs")


@query(f"with {_FAILURES} select key, runs from f where key % 2 = 0")
def failures_still_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.still_listed(_failures(spark, sf_dir), _documents(spark, sf_dir).filter("key % 2 = 0")).select("key", "runs")


@query("""
select 'facts' as measure, cast(count(*) as decimal(38,4)) as value, count(*) >= 10 as passed from lineitem
union all select 'edges', cast(count(distinct l_orderkey) as decimal(38,4)), count(distinct l_orderkey) <= 5 from lineitem
""")
def store_only_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    report = lines.agg(F.count("*").alias("facts"), F.count_distinct("l_orderkey").alias("edges"), F.sum("l_quantity").alias("cost_usd"))
    return lifecycle.gate(report, [("facts", "10", None), ("edges", None, "5"), ("cost_usd", None, "0"), ("superseded", None, "1")], store_only=True)


@query(r"""
select doc_id from documents where regexp_matches(text, '[A-Za-z0-9][A-Za-z0-9._%+''-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}')
""")
def refused_if_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.left_over(table(spark, sf_dir, "documents"), ["Email"]).select("doc_id")


@query("select doc_id, sha256(translate(text, chr(9) || chr(10) || chr(13) || chr(133) || chr(8232), '     ')) as hash from documents")
def one_line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(one_line(F.col("text")), 256).alias("hash"))


@query("""
with t as (select conv_id, turn, coalesce(text, '') || case when turn % 2 = 0 then chr(10) || chr(10) || '[context a]' || text else '' end as text from conversations)
select conv_id, turn, sha256(case when turn % 2 = 0 then left(text, strpos(text, chr(10) || chr(10) || '[context') - 1) else text end) as body,
  sha256(case when turn % 2 = 0 then substr(text, strpos(text, chr(10) || chr(10) || '[context')) end) as context from t
""")
def split_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n\n[context a]"), "text")).otherwise("")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", split_context(F.concat(F.coalesce("text", F.lit("")), more)).alias("s"))
    return rows.select("conv_id", "turn", F.sha2("s.body", 256).alias("body"), F.sha2("s.context", 256).alias("context"))


@query("""
select o_orderkey, '{"since": "2024-03-01T10:20:30Z", "of": ' || o_orderkey || ', "epoch": 1709288550, "ago": 2, "till": "2024-03-01T10:22:30Z", "kept": "{other}"}' as request from orders
""")
def filled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.concat(F.lit('{"since": "{since}", "of": '), "o_orderkey", F.lit(', "epoch": {until_epoch}, "ago": {since_minutes_ago}, "till": "{until}", "kept": "{other}"}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", window_placeholders(template, 1709288430000, 1709288550000).alias("request"))


# Documents whose keys differ in a secret and a page; of each masked key the first one stays.
@query(rf"""
with m as (select doc_id, 'https://h/d?token=[masked:secret-assignment]&page=' || (doc_id % 40) as key, regexp_replace(text, '{_ASSIGNED}', '\1[masked:secret-assignment]', 'g') as text, text as plain from documents),
f as (select *, row_number() over (partition by key order by doc_id) as n from m)
select key, doc_id, sha256(text) as hash, coalesce(length(text) > 500, false) as cut, sha256(left(text, 500)) as shown,
  cast(1 + coalesce(len(regexp_extract_all(text, '\[masked:[a-z-]+\]')), 0) as integer) as masked from f where n = 1
""")
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("https://h/d?token=Zr4p0p0p0"), F.col("doc_id") % 7, F.lit("&page="), F.col("doc_id") % 40)
    docs = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), "text")
    done = redaction.masking_stage(docs, "doc_id", 500)
    return done.select("key", "doc_id", "hash", "cut", F.sha2("text", 256).alias("shown"), F.col("masked").cast("int").alias("masked"))


@query("select 'https://h/' || p_partkey || case when p_partkey % 3 = 0 then '?page=' || p_size else '' end as key from part where p_partkey % 3 <> 1")
def seen_keys_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("?page="), "p_size")).when(F.col("p_partkey") % 3 == 1, F.lit("?access_key=Zr4p0p0p0&x=1")).otherwise("")
    return changes.loaded(table(spark, sf_dir, "part").select(F.concat(F.lit("https://h/"), "p_partkey", more).alias("key")))


@query("""
with g as (select case when p_partkey % 11 <> 0 then 'k' || (p_partkey // 2) end as key, case p_partkey % 4 when 0 then null when 1 then 'bad' else sha256(p_brand) end as hash, case when p_partkey % 7 <> 0 then p_partkey end as t from part),
ok as (select *, row_number() over (partition by key order by t, hash nulls first) as n from g where key is not null and t is not null and (hash is null or hash <> 'bad')),
no as (select key, case when key is null then 'no key' when t is null then 'no time' else 'no hash' end as reason from g where key is null or t is null or hash = 'bad')
select key, hash, 'taken' as outcome from ok where n = 1 and not exists (select 1 from part where p_partkey % 13 = 0 and 'k' || p_partkey = ok.key) union all select key, null, reason from no
""")
def adopted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    given = part.select(
        F.when(k % 11 != 0, F.concat(F.lit("k"), F.floor(k / 2))).alias("key"), F.when(k % 4 == 0, None).when(k % 4 == 1, "bad").otherwise(F.sha2("p_brand", 256)).alias("hash"),
        F.lit(None).cast("string").alias("unlinked_hash"), F.when(k % 7 != 0, k).cast("long").alias("applied_at"),
    )
    good, bad = changes.adopted(given, part.filter("p_partkey % 13 = 0").select(F.concat(F.lit("k"), "p_partkey").alias("key")))
    return good.select("key", "hash", F.lit("taken").alias("outcome")).unionByName(bad.select("key", F.lit(None).cast("string").alias("hash"), F.col("reason").alias("outcome")))


@query("""
with n as (select p_type as type, p_brand || ' ' || p_size as name, min(p_partkey) as first from part where p_partkey % 9 <> 0 group by 1, 2),
r as (select *, row_number() over (partition by type order by first, name) as place from n)
select type, name, cast(place as integer) as place from r where place <= 5
""")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = F.when(F.col("p_partkey") % 9 != 0, F.array(F.concat_ws(" ", "p_brand", "p_size"), F.lit("other"))).otherwise(F.array().cast("array<string>"))
    return linking.entity_names(table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), aliases.alias("aliases"), F.col("p_partkey").alias("ord")), 5)


@query("""
select p_partkey as key, row_number() over (partition by p_brand order by p_partkey % 3 = 0, case when p_partkey % 3 = 0 then p_partkey % 5 else 0 end, p_partkey) as place from part
""")
def marked_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_brand", k.alias("key"), (k % 3 == 0).alias("alone"), (k % 5).alias("failed_runs"))
    return ordered.marked_last(rows, ["p_brand"], "key").select("key", "place")


@query("""
select event_id, case when event_id % 5 = 0 or event_id % 7 = 1 or event_id % 11 = 2 or event_id % 13 = 3 then null else event_id + user_id + 17 end as tokens from events
""")
def tokens_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    counts = (
        F.when(e % 5 != 0, e.cast("string")), F.when(e % 7 == 1, "-1").otherwise(F.col("user_id").cast("string")), F.when(e % 11 == 2, "1.5").otherwise("17"), F.when(e % 13 == 3, "9223372036854775807").otherwise("0"),
    )
    return table(spark, sf_dir, "events").select("event_id", answer_tokens(*counts).alias("tokens"))


@query("""
with r as (select 'list ' || event_type as operation, case when user_id % 2 = 0 then 'without a key' else 'not followed' end as reason from events union all select 'one', 'without a key' from region where r_regionkey = 0),
c as (select operation, reason, count(*) as found from r group by operation, reason)
select *, operation || ': ' || found || case when found = 1 then ' record ' else ' records ' end || reason as words from c
""")
def left_out_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("list "), "event_type").alias("operation"), F.when(F.col("user_id") % 2 == 0, "without a key").otherwise("not followed").alias("reason"))
    one = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit("one").alias("operation"), F.lit("without a key").alias("reason"))
    return analytics.left_out(rows.unionByName(one))

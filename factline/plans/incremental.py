"""Queries about change: what is new, what a run takes, in which order and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions.sums import apportioned, poisoned_sum, reported_sum
from factline.functions.text import normal, one_line, text_hash
from factline.functions.times import DAY_MS, epoch_ms
from factline.operators import changes, ordered
from factline.plans.registry import Registry, table
from factline.sources import pages as page_source

registry = Registry()
query = registry.query

NOW_MS = 1_706_745_600_000
REFRESH_DAYS = 14

_SEEN_SQL = f"""
d as (select doc_id as key, sha256(text) as hash, case when doc_id % 3 = 0 then 'FileRecord' else 'Url' end as origin from documents),
s as (select doc_id as key, case when doc_id % 11 = 0 then null when doc_id % 7 = 0 then sha256(text || 'x') else sha256(text) end as hash,
  {NOW_MS} - (doc_id % 40) * {DAY_MS} as applied_at from documents where doc_id % 5 <> 0),
classified as (select d.key, d.origin, s.applied_at, case when s.key is null then 'new'
    when s.hash is not null and s.hash <> d.hash and (d.origin = 'FileRecord' or {NOW_MS} - s.applied_at >= {REFRESH_DAYS * DAY_MS}) then 'changed'
    when s.hash is not null and s.hash <> d.hash then 'held' else 'unchanged' end as class
  from d left join s on d.key = s.key)
"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    listed = docs.select(F.col("doc_id").alias("key"), text_hash(F.col("text")).alias("hash"), F.lit(None).cast("string").alias("unlinked_hash"), F.when(F.col("doc_id") % 3 == 0, "FileRecord").otherwise("Url").alias("origin"), F.col("doc_id").alias("ord"))
    before = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, text_hash(F.concat("text", F.lit("x")))).otherwise(text_hash(F.col("text")))
    seen = docs.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("key"), before.alias("hash"), F.lit(None).cast("string").alias("unlinked_hash"), (F.lit(NOW_MS) - F.col("doc_id") % 40 * DAY_MS).alias("applied_at"))
    return changes.classify(listed, seen, NOW_MS, REFRESH_DAYS)


@query(f"with {_SEEN_SQL} select key, class from classified")
def change_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("key", "class")


@query(f"with {_SEEN_SQL} select class, count(*) as documents from classified group by class")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.class_counts(_classified(spark, sf_dir))


@query(f"with {_SEEN_SQL} select key, class from classified where class in ('new', 'changed') order by key limit 100")
def select_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.wanted(_classified(spark, sf_dir), 100).select("key", "class")


@query(f"with {_SEEN_SQL} select min(applied_at) - 300000 as held_since from classified where class = 'held'")
def held_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.held_since(_classified(spark, sf_dir))


@query("""
select least(greatest(min((epoch_us(ts) // 1000)) - 300000, 1704067200000), 1706745600000) as pending_since from events where event_id >= 5000
""")
def window_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(epoch_ms(F.col("ts")).alias("time_ms"), (F.col("event_id") < 5000).alias("applied"))
    return changes.unapplied_since(rows, F.lit(1_704_067_200_000), F.lit(NOW_MS), F.lit(True))


@query("""
with a as (select user_id as key, event_id as ord, event_type in ('error', 'view') as failed from events),
c as (select key, max(ord) filter (not failed) as cleared from a group by key),
n as (select a.key, count(*) as failures from a join c on a.key = c.key where failed and (cleared is null or ord > cleared) group by a.key)
select key, least(failures, 2) as batches, failures - least(failures, 2) as runs,
  case when failures >= 5 then 'skipped' when failures >= 2 then 'alone' else 'in-batch' end as state from n
""")
def poison_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.col("event_type").isin("error", "view").alias("failed"))
    return changes.ladder(attempts).select("key", F.col("batches").cast("bigint").alias("batches"), F.col("runs").cast("bigint").alias("runs"), "state")


@query("select min(doc_id) as doc_id, sha256(text) as hash from documents group by text")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text_hash(F.col("text")).alias("hash"))
    return changes.first_of_each(rows, ["hash"], ["doc_id"])


@query("""
with recursive d as (select source, doc_id, strlen(text) as n, row_number() over (partition by source order by doc_id) as k from documents),
w as (select source, k, doc_id, cast(0 as bigint) as batch, n as used from d where k = 1
  union all select d.source, d.k, d.doc_id, w.batch + case when w.used > 0 and w.used + d.n > 60000 then 1 else 0 end,
    case when w.used > 0 and w.used + d.n > 60000 then d.n else w.used + d.n end from w join d on d.source = w.source and d.k = w.k + 1)
select source, doc_id, batch from w
""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordered.greedy_batches(docs, ordered.BATCH_CHARS, "source", "doc_id", "cast(octet_length(text) as bigint)")


@query("select doc_id, (row_number() over (partition by lang order by doc_id) - 1) // 20 as chunk from documents")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.chunks(table(spark, sf_dir, "documents").select("doc_id", "lang"), 20, ["lang"], ["doc_id"]).select("doc_id", "chunk")


@query("""
select doc_id, case when row_number() over (partition by source order by doc_id) <= count(*) over (partition by source) // 2 then 0 else 1 end as half from documents
""")
def batch_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.halves(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"]).select("doc_id", "half")


@query("""
with p as (select a.conv_id, a.turn, b.turn as t, b.text,
    400 - coalesce(sum(length(b.text)) over (partition by a.conv_id, a.turn order by b.turn desc rows between unbounded preceding and 1 preceding), 0) as room
  from conversations a join conversations b on a.conv_id = b.conv_id and b.turn < a.turn)
select c.conv_id, c.turn, coalesce((select string_agg(left(p.text, cast(room as bigint)), chr(10) order by p.t desc) from p
  where p.conv_id = c.conv_id and p.turn = c.turn and p.room > 0 and p.text <> ''), '') as context from conversations c
""")
def thread_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.thread_context(table(spark, sf_dir, "conversations"), 400, "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query("""
with f as (select user_id || ':' || event_type as key, event_id as fact, (epoch_us(ts) // 1000) as t, event_id % 3 <> 0 as refused from events),
s as (select key, max({'t': t, 'p': fact}) as stored from f where not refused group by key),
m as (select f.*, s.stored, s.stored is not null and {'t': f.t, 'p': f.fact} < s.stored as stays from f left join s on f.key = s.key where refused),
n as (select *, row_number() over (partition by key, stays order by t, fact) - 1 as k from m)
select key, fact, case when not stays then k end as round, coalesce(not stays and k = 0 and stored is null, false) as loses_replaces from n
""")
def reapply_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    facts = events.select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_id").alias("fact"), epoch_ms(F.col("ts")).alias("time"), F.col("event_id").alias("place"), (F.col("event_id") % 3 != 0).alias("refused"))
    return ordered.reapply_rounds(facts)


@query("""
select p_partkey, case when n = 1 then p_name else p_name || '-' || n end as unique_key
from (select p_partkey, p_name, row_number() over (partition by p_brand, p_name order by p_partkey) as n from part)
""")
def section_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.suffixed_keys(table(spark, sf_dir, "part"), ["p_brand"], "p_name", ["p_partkey"]).select("p_partkey", "unique_key")


@query("""
with v as (select user_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k, min(event_id) as first from events group by 1, 2, 3)
select user_id, event_type, k, '[' || event_type || '-' || row_number() over (partition by user_id, event_type order by first, k) || ']' as placeholder from v
""")
def placeholder_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return ordered.placeholders(events, "user_id", "event_type", "k", "event_id")


@query("""
select event_id, user_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where event_type <> 'error')
where n > 3 and event_id % 50 <> 0
""")
def snapshot_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    taken = events.select("user_id", "event_id", F.col("event_id").alias("name"), F.col("ts").alias("taken_at"), (F.col("event_type") != "error").alias("own"), (F.col("event_id") % 50 == 0).alias("restored"))
    return ordered.rotated(taken, 3, ["user_id"]).select("event_id", "user_id")


@query("""
with recursive e as (select user_id, event_id, event_id * 200 as ms, row_number() over (partition by user_id order by event_id) as k from events),
w as (select user_id, k, event_id, [ms] as held, true as admitted, cast(0 as bigint) as wait_s from e where k = 1
  union all select e.user_id, e.k, e.event_id,
    case when len(list_filter(w.held, lambda t: e.ms - t < 60000)) >= 2 then list_filter(w.held, lambda t: e.ms - t < 60000)
      else list_append(list_filter(w.held, lambda t: e.ms - t < 60000), e.ms) end,
    len(list_filter(w.held, lambda t: e.ms - t < 60000)) < 2,
    case when len(list_filter(w.held, lambda t: e.ms - t < 60000)) >= 2
      then greatest(1, cast(ceil((list_filter(w.held, lambda t: e.ms - t < 60000)[1] + 60000 - e.ms) / 1000.0) as bigint)) else 0 end
  from w join e on e.user_id = w.user_id and e.k = w.k + 1)
select user_id, event_id, admitted, wait_s from w
""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.admitted(table(spark, sf_dir, "events"), 2, "user_id", "event_id", "cast(event_id * 200 as bigint)")


@query("""
with p as (select user_id as operation, row_number() over (partition by user_id order by event_id) as page, event_id % 4 as rows_, 't' || (event_id % 23) as token,
  case when event_id % 29 <> 0 then 't' || (event_id % 19) end as next from events),
r as (select *, case when rows_ = 0 then 'empty page' when next is null then 'no next'
    when list_contains(list(token) over (partition by operation order by page rows between unbounded preceding and current row), next) then 'repeated token'
    when page >= 10 then 'max pages' end as ended from p),
b as (select *, count(ended) over (partition by operation order by page rows between unbounded preceding and 1 preceding) as before from r)
select operation, page, ended from b where before = 0
""")
def walk_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    listed = e.select(F.col("user_id").alias("operation"), n.alias("page"), (F.col("event_id") % 4).alias("rows"), F.concat(F.lit("t"), F.col("event_id") % 23).alias("token"), F.when(F.col("event_id") % 29 != 0, F.concat(F.lit("t"), F.col("event_id") % 19)).alias("next"))
    return page_source.walked(listed, 10).select("operation", "page", "ended")


@query("""
select event_id from events e where not exists (select 1 from events o where o.user_id = e.user_id and o.event_type = 'signup' and o.event_id <= e.event_id and o.value < 5)
""")
def stop_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("age", F.when(F.col("event_type") == "signup", F.col("value")))
    return page_source.until_older(rows, "user_id", "event_id", "age", 5).select("event_id")


@query("""
select event_type as adapter, user_id as profile, count(distinct case when event_id % 3 <> 0 then event_id % 4 end) as live,
  case when count(distinct case when event_id % 3 <> 0 then event_id % 4 end) = 1 then min(case when event_id % 3 <> 0 then event_id % 4 end) end as connection
from events group by 1, 2
""")
def picked_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return page_source.picked_connection(e.select(F.col("event_type").alias("adapter"), F.col("user_id").alias("profile"), (F.col("event_id") % 4).alias("connection"), (F.col("event_id") % 3 == 0).alias("revoked")))


@query("""
select user_id, count(*) as events, case when count(*) filter (event_id % 13 = 0) = 0 then cast(sum(cast(round(value * 100) as bigint)) as bigint) end as poisoned,
  cast(coalesce(sum(case when event_id % 13 <> 0 then cast(round(value * 100) as bigint) end), 0) as bigint) as reported
from events group by user_id
""")
def null_poison_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.when(F.col("event_id") % 13 != 0, F.round(F.col("value") * 100).cast("bigint"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), poisoned_sum(cents).alias("poisoned"), reported_sum(cents).alias("reported"))


@query("""
select doc_id, case when doc_id % 50 = 0 then n_chars else (n_chars * ((doc_id * 7) % 1000) + 1000 // 2) // 1000 end as fixed_tokens from documents
""")
def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.when(F.col("doc_id") % 50 == 0, 0).otherwise(1000)
    return table(spark, sf_dir, "documents").select("doc_id", apportioned(F.col("n_chars"), F.col("doc_id") * 7 % 1000, whole).alias("fixed_tokens"))


@query(r"""
select doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as normal_hash, sha256(regexp_replace(text, '[\p{Cc}]', ' ', 'g')) as line_hash from documents
""")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(normal(F.col("text")), 256).alias("normal_hash"), F.sha2(one_line(F.col("text")), 256).alias("line_hash"))

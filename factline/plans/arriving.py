"""Queries about what arrives in parts: pages that name their next one, and answers in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factline.plans.registry import Registry, table
from factline.sources import walks
from factline.streaming import holdback

registry = Registry()
query = registry.query


# Events of a kind are the pages of a listing, and events of a user those of a child listing: each page names the next event's
# token, or none, or one that a walk had before, or one without a page; some pages are empty.
_PAGES = """
with w as (select 'list' || '/' || event_type as walk, event_id, row_number() over (partition by event_type order by event_id) as i from events
  union all select 'notes' || '/' || user_id, event_id, row_number() over (partition by user_id order by event_id) from events),
p as (
  select walk, i, case when i > 1 then 't' || event_id end as token, case when event_id % 997 = 5 then 0 else 1 + event_id % 3 end as rows_,
    case when event_id % 991 = 7 then null when event_id % 983 = 9 and i > 4 then lag('t' || event_id, 2) over w when event_id % 977 = 3 then 'nowhere'
      else lead('t' || event_id) over w end as next
  from w window w as (partition by walk order by i)),
e as (
  select *, case when rows_ = 0 then 'empty page' when next is null then 'no next' when next = 'nowhere' then 'missing page'
    when next is distinct from lead(token) over (partition by walk order by i) then 'repeated token' when i >= 1500 then 'max pages' end as ended from p)
"""


@query(f"""
{_PAGES}
select walk, i as page, token, rows_ as rows, ended, coalesce(ended = 'max pages' or ended = 'empty page' and next is not null, false) as unread
from (select *, count(ended) over (partition by walk order by i rows between unbounded preceding and 1 preceding) as before from e) where before = 0
""")
def walks_from_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    starts = pages.select("walk", F.lit(None).cast("string").alias("token")).distinct()
    return walks.walked(pages, starts, 1500)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user"))
    both = e.select(walks.child_walk("list", F.col("event_type")).alias("walk"), "event_id").unionByName(e.select(walks.child_walk("notes", F.col("user")).alias("walk"), "event_id"))
    w, token, i = Window.partitionBy("walk").orderBy("event_id"), F.concat(F.lit("t"), F.col("event_id")), F.row_number().over(Window.partitionBy("walk").orderBy("event_id"))
    n = F.col("event_id")
    following = F.when(n % 991 == 7, None).when((n % 983 == 9) & (F.col("i") > 4), F.lag("t", 2).over(w)).when(n % 977 == 3, "nowhere").otherwise(F.lead("t").over(w))
    numbered = both.withColumn("i", i).withColumn("t", token).withColumn("next", following)
    rows = F.when(n % 997 == 5, 0).otherwise(1 + n % 3)
    return numbered.select("walk", F.when(F.col("i") > 1, F.col("t")).alias("token"), rows.alias("rows"), "next").repartition(F.xxhash64("token"))


# Every document is an answer with placeholders around its text, cut into pieces of a size that its number gives.
_ANSWER = "'[Email-1] and [Name-' || doc_id || ']: ' || coalesce(text, '') || ' [=Email-1] [x [Email-1] [Phone-77] [open'"


@query(rf"""
with a as (select doc_id, {_ANSWER} as t, 29 + doc_id % 13 as size from documents),
p as (select doc_id, t, size, unnest(range(1, (length(t) + size - 1) // size + 1)) as k from a),
h as (select doc_id, k, t, size, case when k * size >= length(t) then '' else regexp_extract(substr(t, 1, k * size), '\[[^\[\]\s\x{{0B}}\x{{85}}\p{{Z}}]*$', 0) end as tail from p)
select doc_id, count(*) as pieces, count(*) filter (tail <> '' and strlen(tail) <= 128) as held, cast(max(case when strlen(tail) <= 128 then strlen(tail) else 0 end) as bigint) as longest,
  sha256(replace(replace(replace(replace(any_value(t), '[Email-1]', 'a@b.org'), '[Name-' || doc_id || ']', 'Rowan ' || doc_id), '[=Email-1]', '[Email-1]'), chr(0), '')) as restored_sha256,
  cast(1 as bigint) as unrestored
from h group by doc_id
""")
def held_back_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr(_ANSWER)
    size = (29 + F.col("doc_id") % 13).cast("int")
    answers = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), size.alias("size"))
    number = F.ceil(F.length("t") / F.col("size")).cast("int")
    cut = answers.select("doc_id", "t", "size", number.alias("n"), F.explode(F.sequence(F.lit(0), number - 1)).alias("seq"))
    piece = F.substring("t", F.col("seq") * F.col("size") + 1, F.col("size"))
    pieces = cut.select(F.col("doc_id").cast("string").alias("answer"), "seq", piece.alias("piece"), (F.col("seq") == F.col("n") - 1).alias("last"))
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("answer"))
    mapping = ids.select("answer", F.lit("[Email-1]").alias("placeholder"), F.lit("a@b.org").alias("value")).unionByName(
        ids.select("answer", F.concat(F.lit("[Name-"), "answer", F.lit("]")).alias("placeholder"), F.concat(F.lit("Rowan "), "answer").alias("value"))
    )
    shown = holdback.restored(holdback.held_back(pieces), mapping)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "shown"))), lambda s: s["shown"]), "")
    held = F.octet_length("held")
    return shown.groupBy("answer").agg(
        F.count("*").alias("pieces"), F.count_if(held > 0).alias("held"), F.max(held).cast("long").alias("longest"), F.sha2(whole, 256).alias("restored_sha256"), F.sum("unrestored").alias("unrestored")
    ).select(F.col("answer").cast("long").alias("doc_id"), "pieces", "held", "longest", "restored_sha256", "unrestored")

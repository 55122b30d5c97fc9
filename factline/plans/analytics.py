"""Queries that measure: quality, evaluation, spend, status, answer records, figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions.sums import micros
from factline.functions.times import epoch_ms
from factline.operators import analytics
from factline.plans.registry import Registry, table

registry = Registry()
query = registry.query


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact"))
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("fact"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("verdict"), F.col("doc_id").alias("ord"))
    return analytics.judged(facts, verdicts)


_JUDGED_SQL = "j as (select doc_id as fact, case quality when 1 then 'yes' when 0 then 'no' else 'unclear' end as verdict from documents left join labels using (doc_id))"


@query(f"with {_JUDGED_SQL} select fact, verdict from j")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


@query(f"""
with {_JUDGED_SQL},
c as (select count(*) as judged, count(*) filter (verdict = 'yes') as passed, count(*) filter (verdict = 'unclear') as unclear,
  cast(count(*) filter (verdict <> 'unclear') as double) as n, 1.96 * 1.96::double as z2 from j),
r as (select *, passed / n as rate from c)
select judged, passed, unclear, round(rate, 6) as rate,
  round((rate + z2 / (2 * n)) / (1 + z2 / n) - 1.96::double * sqrt(rate * (1 - rate) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) as lower,
  round((rate + z2 / (2 * n)) / (1 + z2 / n) + 1.96::double * sqrt(rate * (1 - rate) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) as upper from r
""")
def quality_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.quality(_judged(spark, sf_dir))


@query(r"""
with b as (select item_id as needle_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as t from benchmark),
d as (select doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as t from documents)
select needle_id, doc_id from b join d on contains(d.t, b.t) where b.t <> ''
""")
def eval_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    return analytics.containments(needles, table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""
select o_orderkey as "case", cast(2 as integer) as facts, cast(case when o_orderkey % 5 = 0 then 0 when o_orderkey % 2 = 0 then 2 else 1 end as integer) as facts_found,
  cast(1 as integer) as nodes, cast(case when o_orderkey % 5 <> 0 and o_orderkey % 3 = 0 then 1 else 0 end as integer) as nodes_found,
  o_orderkey % 5 <> 0 and o_orderkey % 2 = 0 and o_orderkey % 3 = 0 as passed from orders
""")
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    cases = o.select(F.col("o_orderkey").alias("case"), F.array(F.concat(F.lit("Order "), key, F.lit("  shipped")), F.lit("by RAIL")).alias("facts"), F.array(F.concat(F.lit("n"), key)).alias("nodes"))
    text = F.concat(F.lit("the order "), key, F.lit(" shipped "), F.when(F.col("o_orderkey") % 2 == 0, "by\nrail").otherwise("by road"))
    answers = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("case"), text.alias("text"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.concat(F.lit("n"), key))).otherwise(F.array(F.lit("n-1"))).alias("cited"))
    return analytics.eval_cases(cases, answers)


@query("select case event_id % 4 when 0 then 'pending' when 1 then 'approved' when 2 then 'rejected' else 'applied' end as status, count(*) as proposals from events group by 1")
def schema_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "approved", "rejected", "applied")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(status.alias("status")).agg(F.count("*").alias("proposals"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers: errors failed, clicks were closed by the client, the rest answered; latency from the value."""
    outcome = F.when(F.col("event_type") == "error", "model-failed").when(F.col("event_type") == "click", "client-closed").otherwise("answered")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), epoch_ms(F.col("ts")).alias("at_ms"), outcome.alias("outcome"), F.floor(F.col("value") * 1000).cast("bigint").alias("latency_ms"), F.col("value").alias("cost_usd"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 100).alias("tokens"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event votes, on the answer 500 before it, which may be none of ours."""
    return table(spark, sf_dir, "events").select(
        (F.floor(F.col("event_id") / 3) * 2 - 500).cast("bigint").alias("answer"), F.col("user_id").alias("reader"), F.when(F.col("event_id") % 2 == 0, "up").otherwise("down").alias("value"),
        epoch_ms(F.col("ts")).alias("at_ms"), F.col("event_id").alias("ord"),
    )


_ANSWERS_SQL = """
answers as (select event_id as id, (epoch_us(ts) // 1000) as at_ms, case event_type when 'error' then 'model-failed' when 'click' then 'client-closed' else 'answered' end as outcome,
  cast(floor(value * 1000) as bigint) as latency_ms, value as cost_usd, case when event_id % 13 <> 0 then event_id % 100 end as tokens from events),
votes as (select (event_id // 3) * 2 - 500 as answer, user_id as reader, case when event_id % 2 = 0 then 'up' else 'down' end as value, (epoch_us(ts) // 1000) as at_ms, event_id as ord from events)
"""


@query(f"""
with {_ANSWERS_SQL}
select strftime(epoch_ms(at_ms), '%Y-%m-%d') as day, cast(sum(cast(round(greatest(cost_usd, 0) * 1000000) as bigint)) as bigint) as spent_micros,
  case when count(*) = count(tokens) then cast(sum(tokens) as bigint) end as tokens from answers group by 1
""")
def daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily_spend(_answers(spark, sf_dir))


@query(f"""
with {_ANSWERS_SQL},
m as (select id, at_ms // 86400000 as day, at_ms, cast(round(greatest(cost_usd, 0) * 1000000) as bigint) as micros from answers),
s as (select id, cast(1000000000 - coalesce(sum(micros) over (partition by day order by at_ms, id rows between unbounded preceding and 1 preceding), 0) as bigint) as remaining from m)
select id, remaining, remaining > 0 as allowed from s
""")
def daily_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir).withColumn("day", F.floor(F.col("at_ms") / 86_400_000)).withColumn("micros", micros(F.col("cost_usd")))
    return analytics.daily_ceiling(a, 1_000_000_000).select("id", "remaining", "allowed")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "fetch-failed").when(F.col("event_type") == "view", "extraction-failed").otherwise("ran")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), outcome.alias("outcome"), epoch_ms(F.col("ts")).alias("at_ms"), F.col("event_id").alias("ord"))


_RUNS_SQL = "runs as (select user_id as source, case event_type when 'error' then 'fetch-failed' when 'view' then 'extraction-failed' else 'ran' end as outcome, (epoch_us(ts) // 1000) as at_ms, event_id as ord from events)"


@query(f"""
with {_RUNS_SQL}
select source, outcome, count(*) filter (real) as runs from (
  select source, outcome, true as real from runs union all
  select source, o, false from (select distinct source from runs), (values ('ran'), ('fetch-failed'), ('extraction-failed'), ('apply-refused')) v(o)) group by 1, 2
""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return analytics.outcome_counts(runs, runs.select("source").distinct())


@query(f"""
with {_RUNS_SQL}
select 'runs_total{{source="' || source || '",outcome="' || outcome || '"}} ' || count(*) filter (real) as line from (
  select source, outcome, true as real from runs union all
  select source, o, false from (select distinct source from runs), (values ('ran'), ('fetch-failed'), ('extraction-failed'), ('apply-refused')) v(o)) group by source, outcome
""")
def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.metric_lines(status_rollup(spark, sf_dir), "runs_total")


@query(f"with {_RUNS_SQL} select source, arg_max(outcome, {{'a': at_ms, 'o': ord}}) as last_outcome, max(at_ms) as last_run_at, count(*) as runs from runs group by source")
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.last_runs(_runs(spark, sf_dir))


@query(f"""
with {_RUNS_SQL}, g as (select source, max({{'a': at_ms, 'o': ord}}) filter (outcome = 'ran') as good from runs group by source)
select r.source, count(*) filter (outcome <> 'ran' and (good is null or {{'a': at_ms, 'o': ord}} > good)) as consecutive,
  count(*) filter (outcome <> 'ran' and (good is null or {{'a': at_ms, 'o': ord}} > good)) >= 2 as disabled from runs r join g on r.source = g.source group by r.source
""")
def disabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.disabled(_runs(spark, sf_dir))


@query(f"""
with {_ANSWERS_SQL}
select answer || ':' || reader as vote, answer, reader, arg_max(value, {{'a': at_ms, 'o': ord}}) as value, max(at_ms) as at_ms
from votes where answer in (select id from answers) group by answer, reader
""")
def vote_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.cast_votes(_votes(spark, sf_dir), _answers(spark, sf_dir))


_REVIEWS_SQL = f"""
with {_ANSWERS_SQL},
causes as (select id as answer, 'failed' as cause, at_ms from answers where outcome not in ('answered', 'client-closed')
  union all select id, 'slow', at_ms from answers where outcome <> 'client-closed' and latency_ms > 15000
  union all select answer, 'voted-down', at_ms from votes where value = 'down' and answer in (select id from answers)),
reviews as (select answer || ':' || cause as review, answer, cause, min(at_ms) as opened_at from causes group by answer, cause)
"""


@query(_REVIEWS_SQL + "select review, answer, cause, opened_at from reviews")
def open_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.review_causes(_answers(spark, sf_dir), _votes(spark, sf_dir), 15_000)


@query(_REVIEWS_SQL + """
select review, case when answer % 3 = 0 then 'Closed' else 'Open' end as state, case when answer % 3 = 0 then 'first' end as reason from reviews
""")
def closed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = open_reviews(spark, sf_dir)
    some = reviews.filter("answer % 3 = 0")
    closings = some.select("review", F.lit("later").alias("reason"), (F.col("opened_at") + 9).alias("at_ms")).unionByName(some.select("review", F.lit("first").alias("reason"), (F.col("opened_at") + 1).alias("at_ms")))
    return analytics.closed(reviews, closings).select("review", "state", "reason")


@query(f"with {_ANSWERS_SQL} select answer, reader, ord from votes where answer in (select id from answers where at_ms >= 1705276800000)")
def purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.purged(_answers(spark, sf_dir), _votes(spark, sf_dir), 1_705_276_800_000)[1].select("answer", "reader", "ord")


@query(_REVIEWS_SQL + "select review from reviews where answer % 3 = 0 and answer % 4 = 0 and answer % 5 <> 0")
def review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = open_reviews(spark, sf_dir)
    state = F.when(F.col("answer") % 3 == 0, "Closed").otherwise("Open")
    expected = F.when(F.col("answer") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    marked = reviews.withColumn("state", state).withColumn("expectations", expected)
    return analytics.new_cases(marked, reviews.filter("answer % 5 = 0").select("review")).select("review")


@query("""
with c as (select p_type || ' ' || p_size as label, count(*) as count from part group by 1), t as (select * from c order by count desc, label limit 50)
select label, count, greatest(count * 360 // max(count) over (), 1) as width from t
""")
def figure_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_type", "p_size").alias("label")).agg(F.count("*").alias("count"))
    return analytics.bars(counted, "label", "count")


@query("""
with n as (select 'c' || c_custkey as id from customer where c_custkey % 9 <> 0 union all select 'c1'),
e as (select 'c' || o_custkey as source, 'o' || o_orderkey as target from orders),
ends as (select source as id from e union select target from e)
select 'unknown end' as problem, id from ends where id not in (select id from n) union all select 'repeated id', id from n group by id having count(*) > 1
""")
def graph_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id")).unionAll(spark.createDataFrame([("c1",)], "id string"))
    edges = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("source"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("target"))
    return analytics.graph_problems(nodes, edges)

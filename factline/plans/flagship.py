"""The flagship: a structured import with its facts and what a second listing ends, counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.plans import lifecycle, mapping
from factline.plans.registry import Registry

registry = Registry()


@registry.query(
    lifecycle._OPS_SQL
    + """
select 'fact ' || p as step, cast(n as bigint) as rows_ from (select 'status' as p, count(*) as n from orders union all select 'total', count(*) from orders
  union all select 'ordered_at', count(*) from orders union all select 'priority', count(*) from orders union all select 'PLACED_BY', count(*) from orders)
union all select 'op ' || op, count(*) from ops group by op
"""
)
def import_and_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = mapping.map_order_facts(spark, sf_dir).select("predicate").unionAll(mapping.map_relations(spark, sf_dir).select("predicate"))
    counted = facts.groupBy("predicate").agg(F.count("*").alias("rows_")).select(F.concat(F.lit("fact "), F.col("predicate")).alias("step"), "rows_")
    ops = lifecycle.ended_ops(spark, sf_dir).groupBy("op").agg(F.count("*").alias("rows_"))
    return counted.unionByName(ops.select(F.concat(F.lit("op "), F.col("op")).alias("step"), "rows_"))

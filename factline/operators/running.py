"""Row numbers and running sums of groups without gathering any group: of a group of any size each task has a range.

Rows are dealt by ranges of (group, order), numbered and summed within each range, and the ranges' totals, a row for each range and group,
say what comes before each. A window over whole groups would sort each group in one task.

Defined cases: a null group is a group of its own; null values count as 0; rows of equal order stay in one range, in any order among
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.operators.tables import saved


def numbered(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``_number``, from 1 in each group, ``_of``, the rows of the group, and for each of ``sums`` its sum over the rows before."""
    sums = sums or {}
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    valued = rows.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_of_{name}") for name, c in sums.items()])
    ranged = valued.repartitionByRange(width, *group, *order).sortWithinPartitions(*group, *order)
    placed = saved(ranged.withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), "ranged")
    local = Window.partitionBy("_range", *group).orderBy("_place")
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", F.row_number().over(local).cast("long").alias("_nth"), *[F.coalesce(F.sum(f"_of_{s}").over(before), F.lit(0)).alias(f"_in_{s}") for s in sums])
    totals = placed.groupBy("_range", *group).agg(F.count("*").alias("_n"), *[F.sum(f"_of_{s}").alias(f"_all_{s}") for s in sums])
    across = Window.partitionBy(*group)  # a row for each range that has some of the group
    ahead = across.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"), F.sum("_n").over(across).alias("_of"),
        *[F.coalesce(F.sum(f"_all_{s}").over(ahead), F.lit(0)).alias(f"_ahead_{s}") for s in sums],
    )
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    met = inside.join(starts, same)
    return met.select(*rows.columns, (F.col("_first") + F.col("_nth")).alias("_number"), "_of", *[(F.col(f"_ahead_{s}") + F.col(f"_in_{s}")).alias(s) for s in sums])

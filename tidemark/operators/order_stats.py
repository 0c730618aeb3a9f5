"""Ranks and quantiles without one task that holds a whole column or group.

Values are counted first, then dealt by range: a partition holds a stretch of
values, how many rows stand before it is a sum over the partitions before, and the
rest is counted inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.core import finite
from tidemark.sources.shared import written


def _placed(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, _n (rows with it), _before (rows of the group with lesser values) and _all (rows of the group), for each distinct value."""
    ranged = values.groupBy(*by, value).agg(F.count("*").alias("_n")).repartitionByRange(*[F.col(c) for c in (*by, value)])
    counted = written(ranged.withColumn("_p", F.spark_partition_id()))
    # one row for each partition that a group runs over
    stretches = counted.groupBy(*by, "_p").agg(F.sum("_n").alias("_s"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    upto = F.sum("_s").over(group.orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow))
    stretches = stretches.withColumns({"_offset": upto - F.col("_s"), "_all": F.sum("_s").over(group)}).drop("_s")
    inside = W.partitionBy(*by, "_p").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = counted.withColumn("_upto", F.sum("_n").over(inside))
    left, right = local.alias("l"), stretches.alias("r")
    on = F.col("l._p") == F.col("r._p")
    for c in by:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, on).select(*[F.col(f"l.{c}").alias(c) for c in (*by, value)], "l._n", (F.col("_offset") + F.col("_upto") - F.col("_n")).alias("_before"), "_all")


def average_ranks(rows: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """by, value and the average rank (from 1) of the rows with that value, among those of the group; null values have none."""
    placed = _placed(rows.where(F.col(value).isNotNull()).select(*by, value), by, value)
    return placed.select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))


def grouped_quantiles(rows: DataFrame, by: Sequence[str], value: Column | str, quantiles: dict[str, float]) -> DataFrame:
    """by and a column for each of ``quantiles`` (name: share), between neighbours in proportion, as ``percentile`` gives them.

    Values that are null or not finite are left out; a group without others has no
    row.
    """
    v = finite(F.col(value) if isinstance(value, str) else value).alias("_v")
    placed = _placed(rows.select(*by, v).where("_v IS NOT NULL"), by, "_v")
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("at")) for n, q in quantiles.items()]))
    near = placed.select(*by, "_v", "_before", (F.col("_before") + F.col("_n") - 1).alias("_last"), wanted.alias("_q"))
    holds = lambda at: F.when((at >= F.col("_before")) & (at <= F.col("_last")), F.col("_v"))
    low, high, at = F.floor("_q.at"), F.ceil("_q.at"), F.col("_q.at")
    near = near.where((high >= F.col("_before")) & (low <= F.col("_last")))
    between = lambda n: F.max(F.when(F.col("_q.name") == n, holds(low))) + F.max(F.when(F.col("_q.name") == n, at - low)) * (F.max(F.when(F.col("_q.name") == n, holds(high))) - F.max(F.when(F.col("_q.name") == n, holds(low))))
    return near.groupBy(*by).agg(*[between(n).alias(n) for n in quantiles])

"""Places within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.sources.shared import kept


def placed(rows: DataFrame, groups: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place within their group, from 1, by order.

    A sort by range cuts groups anywhere. A row's place is its distance from the first row of its group in the same part, beside
    the rows that the group has in the parts before; the sums run over one row a part and group.
    """
    keys = [*[F.col(g).asc_nulls_first() for g in groups], *order]
    cut = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    cut = cut.withColumn("_part", F.shiftright("_at", 33))
    each = cut.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").toDF("_p", *[f"_g{i}" for i in range(len(groups))], "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return cut.join(each, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))

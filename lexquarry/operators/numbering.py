"""Row numbers in order, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.sources.shared import materialize


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows with rank (from 1, in order, within by) and total (rows of the group).

    Rows are dealt by ranges of the order; what stands before a range is a sum over the ranges, of which there are as many
    as partitions.
    """
    ranged = materialize(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_part")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy("_by")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("_by", "_part", before.alias("_before"), F.sum("_n").over(own).alias("total"))
    inside = ranged.withColumn("_inside", F.row_number().over(Window.partitionBy(by, "_range").orderBy(order)))
    out = inside.join(places, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_part")))
    return out.select(*(inside[c] for c in rows.columns), (F.col("_before") + F.col("_inside")).cast("long").alias("rank"), "total")

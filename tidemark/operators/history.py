"""Linking each visit of an entity to its earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def link_history(visits: DataFrame) -> DataFrame:
    """Adds prev_items, prev_gap, visit_ix, n_visits, visit_ix_items and n_items_visits.

    prev_items are those of the last earlier visit (by date, then rid) that has any; prev_gap is the number of days since.
    Ordinals begin at 0; visit_ix_items counts visits with items alone and is null for others. One shuffle, by entity.
    """
    entity = Window.partitionBy("pid")
    order = entity.orderBy("date", "rid")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("has_items"), F.struct("items", "date")), ignorenulls=True).over(earlier)
    return visits.withColumn("_last", last).select(
        *visits.columns, F.col("_last.items").alias("prev_items"), F.datediff("date", "_last.date").alias("prev_gap"),
        (F.row_number().over(order) - 1).alias("visit_ix"), F.count("*").over(entity).alias("n_visits"),
        F.when(F.col("has_items"), F.sum(F.col("has_items").cast("int")).over(so_far) - 1).alias("visit_ix_items"),
        F.sum(F.col("has_items").cast("int")).over(entity).alias("n_items_visits"),
    )


def is_followup():
    return F.coalesce(F.size("prev_items"), F.lit(0)) > 0

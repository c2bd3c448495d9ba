"""Which visits can be learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.visits import FATAL


def has_fatal(fatal=FATAL) -> Column:
    return F.arrays_overlap("flags", F.array(*map(F.lit, fatal)))


def is_gold(fatal=FATAL) -> Column:
    """Text, labels and items, and no fatal flag."""
    return (F.coalesce("text_short", F.lit("")) != "") & F.col("has_labels") & F.col("has_items") & ~has_fatal(fatal)


def is_label_only() -> Column:
    return (F.coalesce("text_short", F.lit("")) != "") & F.col("has_labels") & ~F.col("has_items")


def guarded_pool(pool: DataFrame, held: DataFrame, fatal=FATAL) -> DataFrame:
    """The rows of a pool that may join the training rows: no entity of `held`, no fatal flag."""
    return pool.where(~has_fatal(fatal)).join(held.select("pid").distinct(), "pid", "left_anti")

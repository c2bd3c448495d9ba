"""Profiles and contract checks over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sets import r6
from tidemark.operators.broadcasts import small


def match_counts(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """How often each string that matches a pattern occurs, and in how many rows."""
    found = rows.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)).alias("match"))
    return found.groupBy("match").agg(F.count("*").alias("n"), F.countDistinct(key).alias("docs"))


def pick_by_index(rows: DataFrame, keys: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """For each group the values at given places (from 0) of its sorted values; picks: name -> place, from the group's row count `c`.

    Values are counted before they are ordered, so that a window sees a row for each distinct value alone.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    order = w.orderBy(value)
    seen = counts.withColumns({"_to": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "c": F.sum("_n").over(w)})
    return seen.groupBy(*keys).agg(F.max("c").alias("c"), *[F.min(F.when(F.col("_to") > at, F.col(value))).alias(name) for name, at in picks.items()])


def length_profile(rows: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    """Rows, median and 99th percentile by index, the longest, and how many exceed a limit."""
    c = F.col("c")
    picked = pick_by_index(rows, keys, value, {"p50": F.expr("c div 2"), "p99": F.floor(c * 0.99)})
    rest = rows.groupBy(*keys).agg(F.max(value).alias("longest"), F.count_if(F.col(value) > limit).alias("over"))
    return picked.join(rest, keys).select(*keys, c.alias("docs"), "p50", "p99", "longest", "over")


def class_share(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


def stale_phrases(told: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, lines (that hold it) and stale (that do so without the value that is right): a line with both is a comparison, not a claim.

    told: text. phrases: phrase, correct (null if no value makes it right); a short list, which goes to where the lines are.
    """
    lines = told.select(F.explode(F.split("text", "\n")).alias("line"))
    hit = lines.join(small(phrases), F.contains("line", "phrase")).select("phrase", (F.col("correct").isNull() | ~F.contains("line", "correct")).alias("bad"))
    counts = hit.groupBy("phrase").agg(F.count("*").alias("lines"), F.count_if("bad").alias("stale"))
    return phrases.select("phrase").join(counts, "phrase", "left").select("phrase", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("stale", F.lit(0)).alias("stale"))


def numbers_stated(source: DataFrame, told: DataFrame) -> DataFrame:
    """For each literal of `source` (name, literal) whether any text of `told` (text) holds it.

    The distinct literals go to where the lines are, if their count allows; lines are never broadcast.
    """
    lines = told.select(F.explode(F.split("text", "\n")).alias("line"))
    hit = lines.join(small(source.select("literal").distinct()), F.contains("line", "literal")).select("literal").distinct().withColumn("hit", F.lit(True))
    return source.join(hit, "literal", "left").select("name", "literal", F.coalesce("hit", F.lit(False)).alias("stated"))

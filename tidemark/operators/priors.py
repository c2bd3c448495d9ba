"""Predictors from item frequencies by key, with fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sets import field_set
from tidemark.operators.broadcasts import small


#: Letters of a name that tell cells of the vocabulary apart.
PREFIX = 3


def top_items(rows: DataFrame, k: int | None = None, items: str = "items") -> DataFrame:
    """item, n and rank: most frequent first, ties by name. With k the first k alone, which needs no full sort.

    Without k, items are counted by their n and the first letters of their name; a rank begins where the cells before it
    end, so that no task ranks the whole vocabulary.
    """
    counts = rows.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    if k is not None:
        counts = counts.orderBy(F.desc("n"), "item").limit(k)
        return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "item")))
    cells = counts.withColumn("_p", F.substring("item", 1, PREFIX))
    sizes = cells.groupBy("n", "_p").agg(F.count("*").alias("_c"))
    before = sizes.select("n", "_p", (F.sum("_c").over(Window.orderBy(F.desc("n"), "_p")) - F.col("_c")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("n", "_p").orderBy("item"))
    return cells.withColumn("_local", local).join(before, ["n", "_p"]).select("item", "n", (F.col("_before") + F.col("_local")).alias("rank"))


def top_list(rows: DataFrame, k: int, items: str = "items") -> list[str]:
    """The k most frequent items, on the driver."""
    return [r["item"] for r in top_items(rows, k, items).orderBy("rank").collect()]


def literal(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def keyed_top(rows: DataFrame, key: Column, k: int, items: str = "items") -> DataFrame:
    """key and its k most frequent items in order (ties by name). Counts are pre-aggregated, and a key keeps k rows."""
    counts = rows.select(key.alias("key"), F.explode(items).alias("item")).groupBy("key", "item").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "item"))).where(F.col("r") <= k)
    return ranked.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "item"))), lambda x: x["item"]).alias("top"))


def padded(top: Column, fallback: Sequence[str], k: int) -> Column:
    """Exactly k items (if there are as many): the given ones, then those of the fallback that aren't among them."""
    return F.slice(F.array_distinct(F.concat(F.coalesce(top, F.array().cast("array<string>")), literal(fallback))), 1, k)


def predict(test: DataFrame, train: DataFrame, keys: Sequence[Column], k: int, pad: bool = True, items: str = "items") -> DataFrame:
    """Adds pred: the k most frequent training items of the first of `keys` that training knows, padded by the overall ones."""
    out, found = test, []
    for i, key in enumerate(keys):
        prior = keyed_top(train, key, k, items).select(F.col("key").alias(f"_k{i}"), F.col("top").alias(f"_t{i}"))
        out = out.withColumn(f"_q{i}", key).join(small(prior), F.col(f"_q{i}") == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_t{i}"))
    best = F.coalesce(*found) if found else F.lit(None).cast("array<string>")
    fallback = top_list(train, k, items) if pad else []
    return out.select(*test.columns, padded(best, fallback, k).alias("pred"))


# Keys of the predictors: what is known before labelling, and the labels themselves.


def key_const() -> Column:
    return F.array(F.lit("all"))


def key_codes() -> Column:
    return F.sort_array("codes")


def key_demo() -> Column:
    """Sex and decade of age, 80 at most; an unknown age counts as 0."""
    decade = F.least(F.floor(F.coalesce("age", F.lit(0)) / 10) * 10, F.lit(80))
    return F.array("sex", decade.cast("string"))


def key_codes_demo() -> Column:
    return F.concat(key_codes(), F.array(F.lit("|")), key_demo())


def key_field(field: str, labels: str = "labels") -> Column:
    return field_set(F.col(labels), field)


def key_pairs(labels: str = "labels") -> Column:
    pairs = F.transform(F.filter(F.col(labels), lambda x: x.pattern != ""), lambda x: F.concat(x.disease, F.lit("/"), x.pattern))
    return F.sort_array(F.array_distinct(pairs))


def label_prior(train: DataFrame, key: Column) -> DataFrame:
    """key and the most frequent label set of its rows (ties: the smaller), as `labels`."""
    counts = train.select(key.alias("key"), "labels").groupBy("key", "labels").agg(F.count("*").alias("n"))
    return counts.groupBy("key").agg(F.min_by("labels", F.struct((-F.col("n")).alias("m"), F.col("labels").alias("l"))).alias("labels"))


def predict_labels(test: DataFrame, train: DataFrame, key: Column) -> DataFrame:
    """Adds pred_labels: the label set of the key, or else the one most frequent overall."""
    prior = label_prior(train, key).select(F.col("key").alias("_k"), F.col("labels").alias("_own"))
    overall = label_prior(train, F.lit(1)).select(F.col("labels").alias("_all"))
    joined = test.withColumn("_q", key).join(small(prior), F.col("_q") == F.col("_k"), "left").crossJoin(F.broadcast(overall))
    return joined.select(*test.columns, F.coalesce("_own", "_all").alias("pred_labels"))


def argmax_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's most frequent value; ties by name."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(key, f"b.{value}", "b.n")

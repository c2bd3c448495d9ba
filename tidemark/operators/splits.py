"""Splitting rows and entities by hash, by time and into folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def order_hash(*keys: str, seed=SEED) -> Column:
    """A hash that orders rows in the same way on every engine: SHA-256 of the keys and the seed."""
    return F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))), 256)


def hash_rank(rows: DataFrame, *keys: str, seed=SEED, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds _rank (from 1) in the order of `order_hash`, and _n, the number of rows, over all rows or within groups.

    Rows are counted by the first three digits of the hash; ranks begin where the smaller prefixes end. So a window never
    holds more than a prefix's rows, and no task sees them all.
    """
    own = rows.withColumn("_p", F.substring(order_hash(*keys, seed=seed), 1, 3))
    counts = own.groupBy(*within, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*within)
    before = counts.select(*within, "_p", (F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    local = F.row_number().over(Window.partitionBy(*within, "_p").orderBy("_h", *keys))
    dealt = own.repartition(*within, "_p").withColumn("_h", order_hash(*keys, seed=seed))  # hashes don't compress, so they are made after the shuffle
    return dealt.withColumn("_local", local).join(before, [*within, "_p"]).withColumn("_rank", F.col("_before") + F.col("_local")).drop("_h", "_p", "_local", "_before")


def cut(ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), names: tuple[str, str, str] = ("train", "val", "test")) -> Column:
    """The split of a rank: whole numbers of rows for the first two, the rest for the third."""
    a, b = F.floor(F.col("_n") * ratios[0]), F.floor(F.col("_n") * ratios[1])
    return F.when(F.col("_rank") <= a, names[0]).when(F.col("_rank") <= a + b, names[1]).otherwise(names[2])


def entity_split(rows: DataFrame, entity: str = "pid", seed=SEED) -> DataFrame:
    """entity and split: an entity's rows are all on one side."""
    return hash_rank(rows.select(entity).distinct(), entity, seed=seed).select(entity, cut().alias("split"))


def by_entity(rows: DataFrame, entity: str = "pid", seed=SEED) -> DataFrame:
    return rows.join(entity_split(rows, entity, seed), entity)


def by_row(rows: DataFrame, key: str = "rid", seed=SEED) -> DataFrame:
    """The leaky control: rows of an entity fall on several sides."""
    return hash_rank(rows, key, seed=seed).withColumn("split", cut()).drop("_rank", "_n")


def by_time(rows: DataFrame, cutoff: str, entity: str = "pid", date: str = "date") -> DataFrame:
    """Training rows before the cutoff; test rows from then on, of entities that aren't in training."""
    train = rows.where(F.col(date) < F.to_date(F.lit(cutoff)))
    test = rows.where(F.col(date) >= F.to_date(F.lit(cutoff))).join(train.select(entity).distinct(), entity, "left_anti")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def folds(rows: DataFrame, key: str, n: int, seed=SEED) -> DataFrame:
    """Adds fold (from 0): ranks dealt in turn."""
    return hash_rank(rows, key, seed=seed).withColumn("fold", ((F.col("_rank") - 1) % n).cast("int")).drop("_rank", "_n")


def stratified(rows: DataFrame, stratum: str, key: str, total: int, seed=SEED) -> DataFrame:
    """About `total` rows, from each stratum its share (rounded half up)."""
    ranked = hash_rank(rows, key, seed=seed, within=(stratum,))
    everything = rows.groupBy(stratum).count().select(F.sum("count").alias("_all"))
    return ranked.crossJoin(F.broadcast(everything)).where(F.col("_rank") <= F.floor(F.col("_n") * total / F.col("_all") + 0.5)).drop("_rank", "_n", "_all")


def seen_share(rows: DataFrame, entity: str = "pid") -> DataFrame:
    """Of the test rows and entities, how many belong to entities of the training rows. rows has a column split."""
    train = rows.where("split = 'train'").select(entity).distinct().withColumn("seen", F.lit(True))
    test = rows.where("split = 'test'").join(train, entity, "left")
    return test.agg(F.count("*").alias("rows"), F.count("seen").alias("seen_rows"), F.countDistinct(entity).alias("entities"), F.countDistinct(F.when(F.col("seen"), F.col(entity))).alias("seen_entities"))

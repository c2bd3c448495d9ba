"""The visit tables that the operators work on, made from the relational fixture tables.

A visit: rid long, pid string, sex string, age int, text_short string, text_long string, codes array<string>,
labels array<struct<disease,pattern,goal>>, items array<string>, date date, has_labels boolean, has_items boolean,
flags array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parsing import hash_entity

#: Bounds beyond which a visit is flagged, and the flags that keep it out of training.
AGES, LENGTHS, FATAL = (18, 105), (3, 8), ("sex_outlier", "age_outlier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flags_of(ages: tuple[int, int] = AGES, lengths: tuple[int, int] = LENGTHS, sex_outlier: Column | None = None) -> Column:
    """Which quality flags a visit has."""
    n = F.size("items")
    equal = (F.col("text_short") != "") & (F.col("text_short") == F.col("text_long"))
    prefix = (F.col("text_short") != "") & F.startswith("text_long", "text_short")
    marks = [
        F.when((F.col("age") < ages[0]) | (F.col("age") > ages[1]), "age_outlier"),
        F.when(sex_outlier if sex_outlier is not None else F.lit(False), "sex_outlier"),
        F.when((n > 0) & ((n < lengths[0]) | (n > lengths[1])), "length_outlier"),
        F.when(equal, "text_equal").when(prefix, "text_prefix"),
    ]
    return F.array_compact(F.array(*marks))


def with_flags(visits: DataFrame, **bounds) -> DataFrame:
    """Adds has_labels, has_items and flags."""
    return visits.withColumns({"has_labels": F.size("labels") > 0, "has_items": F.size("items") > 0, "flags": flags_of(**bounds)})


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as visits: items are brands of larger lines, labels come from part type, return flag and line status.

    Lines are grouped once, by order; parts join before, and customers join the orders while these are narrow.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.concat(F.lit("s"), F.expr("p_size div 5").cast("string")).alias("size"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_quantity") > 10).alias("large"), (F.col("l_tax") > 0.06).alias("taxed"), "l_returnflag", "l_linestatus")
    token = F.concat(F.when(F.col("taxed"), "无").otherwise(""), "size")
    line = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", token.alias("t"), F.when(F.col("large"), F.col("p_brand")).alias("item"), "p_type", "l_returnflag", "l_linestatus")
    # plain rows are shuffled, as the lists of a partial aggregation are larger and seldom hold two lines of an order
    lists = line.repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "t", "item", "p_type", "l_returnflag", "l_linestatus")).alias("ls"))
    label = lambda x: F.struct(x.p_type.alias("disease"), F.concat_ws("-", x.p_type, x.l_returnflag).alias("pattern"), F.concat(x.l_returnflag, x.l_linestatus).alias("goal"))
    grouped = lists.select(
        "l_orderkey",
        F.sort_array(F.array_compact(F.array_distinct(F.transform("ls", lambda x: x.item)))).alias("items"),
        F.sort_array(F.array_distinct(F.transform("ls", label))).alias("labels"),
        F.sort_array(F.transform("ls", lambda x: F.struct(x.l_linenumber.alias("n"), x.t.alias("t")))).alias("tokens"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(grouped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    texts = F.coalesce(F.transform("tokens", lambda t: t.t), F.array().cast("array<string>"))
    out = joined.select(
        F.col("o_orderkey").alias("rid"), hash_entity(F.col("o_custkey")).alias("pid"), F.col("o_orderstatus").alias("sex"),
        (F.lit(10) + F.col("o_custkey") % 100).cast("int").alias("age"),
        F.when(F.col("o_orderkey") % 3 == 0, F.coalesce(F.get(texts, F.lit(0)), F.lit(""))).otherwise(F.col("o_orderpriority")).alias("text_short"),
        F.array_join(texts, "，").alias("text_long"), F.array("c_mktsegment", "o_orderpriority").alias("codes"),
        F.coalesce("labels", F.array().cast("array<struct<disease:string,pattern:string,goal:string>>")).alias("labels"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.to_date("o_orderdate").alias("date"),
    )
    return with_flags(out, sex_outlier=F.col("sex") == "P")


def item_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, dose_min, dose_max, capabilities, n_uses: the parts of each brand as its dictionary entry."""
    part = table(spark, sf_dir, "part")
    number = F.regexp_extract("p_brand", r"\d+", 0).cast("int")
    return part.groupBy(F.col("p_brand").alias("item")).agg(
        (F.min("p_size") / 10).alias("dose_min"), (F.max("p_size") / 4 + F.count("*") / 100).alias("dose_max"),
        F.sort_array(F.collect_set(F.when(((number + F.length("p_type")) % 3 == 0) & (number % 4 != 0), F.col("p_type")))).alias("capabilities"), F.count("*").alias("n_uses"),
    )


def dosed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, item and dose: the largest quantity of each brand of an order."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").where("l_quantity > 10")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("rid"), F.col("p_brand").alias("item")).agg(F.max("l_quantity").alias("dose"))

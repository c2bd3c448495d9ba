"""Reading and writing records: JSON Lines, raw tables, chat rows and predictions."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import parsing as P
from tidemark.functions.rendering import chat_is_sound
from tidemark.sources.visits import with_flags

# The columns of a raw table, in order.
RAW = ("pid", "pid_masked", "sex", "age_raw", "cc", "hpi", "wm_dx", "tcm_dx", "rx", "date_raw")
LABEL = T.StructType([T.StructField(c, T.StringType()) for c in ("disease", "pattern", "goal")])
VISIT = T.StructType([
    T.StructField("rid", T.LongType()), T.StructField("pid", T.StringType()), T.StructField("sex", T.StringType()), T.StructField("age", T.IntegerType()), T.StructField("text_short", T.StringType()),
    T.StructField("text_long", T.StringType()), T.StructField("codes", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(LABEL)), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("date", T.DateType()), T.StructField("has_labels", T.BooleanType()), T.StructField("has_items", T.BooleanType()), T.StructField("flags", T.ArrayType(T.StringType())),
])
CHAT = T.StructType([T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))])
PREDICTION = T.StructType([T.StructField("rid", T.LongType()), T.StructField("output", T.StringType())])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines with a schema; blank lines are skipped, a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", by: str | None = None) -> None:
    """JSON Lines with nulls written out; what lay there goes. by: a column whose values become folders."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A whole document as one row."""
    return spark.read.option("multiLine", True).json(path)


def write_json(value: object, path: str) -> None:
    """A small document, indented, from the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1)


def load_raw(spark: SparkSession, path: str, columns: tuple[str, ...] = RAW, **options: str) -> DataFrame:
    """A CSV or Parquet table whose columns, all strings, are renamed by position. Raises ValueError if their number is wrong."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.endswith((".xlsx", ".xls")):
        import pandas as pd

        df = spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda x: x.notna(), None))
    else:
        df = spark.read.options(header="true", **options).csv(path)
    if len(df.columns) != len(columns):
        raise ValueError(f"{len(columns)} columns were expected, and {len(df.columns)} found")
    return df.toDF(*columns).select(*[F.col(c).cast("string") for c in columns])


def build_visits(raw: DataFrame, rid: Column, **bounds) -> DataFrame:
    """Visits from a raw table: each field is parsed, ids are hashed, and flags are set. rid must come from the source, as row
    numbers would change with its partitions. Missing text is empty."""
    text = lambda c: P.strip(F.coalesce(F.col(c), F.lit("")))
    out = raw.select(
        rid.cast("long").alias("rid"), P.hash_entity(F.col("pid")).alias("pid"), F.col("sex"), P.parse_age(F.col("age_raw")).alias("age"), text("cc").alias("text_short"), text("hpi").alias("text_long"),
        P.parse_codes(F.col("wm_dx")).alias("codes"), P.parse_labels(F.col("tcm_dx")).alias("labels"), P.parse_items(F.col("rx")).alias("items"), P.parse_date(F.col("date_raw")).alias("date"),
    )
    return with_flags(out, **bounds)


def drop_suppressed(df: DataFrame, column: str = "Suppress") -> DataFrame:
    """Without the rows that a sheet marks as suppressed."""
    return df.where(~F.coalesce(F.col(column).try_cast("double") == 1, F.lit(False))) if column in df.columns else df


def unsound_chats(chats: DataFrame) -> DataFrame:
    """Rows whose messages aren't system, user and assistant in this order; none should be."""
    return chats.where(~chat_is_sound(F.col("messages")))


def redact_rows(df: DataFrame, pattern: str, placeholder: str, texts: tuple[str, ...] = (), arrays: tuple[str, ...] = (), messages: str | None = None) -> DataFrame:
    """df with a pattern replaced in text columns, arrays of text and message contents; redacted counts the hits.

    Spark can't overwrite what it reads: write to another path, then swap.
    """
    hits = [F.regexp_count(F.coalesce(c, F.lit("")), F.lit(pattern)) for c in texts]
    hits += [F.regexp_count(F.coalesce(F.array_join(c, "\n"), F.lit("")), F.lit(pattern)) for c in arrays]
    new = {c: P.redact(F.col(c), pattern, placeholder) for c in texts} | {c: F.transform(c, lambda x: P.redact(x, pattern, placeholder)) for c in arrays}
    if messages:
        hits.append(F.regexp_count(F.coalesce(F.array_join(F.transform(messages, lambda m: m.content), "\n"), F.lit("")), F.lit(pattern)))
        new[messages] = F.transform(messages, lambda m: F.struct(m.role.alias("role"), P.redact(m.content, pattern, placeholder).alias("content")))
    total = sum(hits[1:], hits[0]) if hits else F.lit(0)
    return df.withColumn("redacted", total).withColumns(new)


def markdown(df: DataFrame, title: str) -> str:
    """A small table (at most 1,000 rows) as a Markdown report."""
    rows = df.limit(1000).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}\n"
    return f"# {title}\n\n{head}" + "".join(f"| {' | '.join(str(x) for x in r)} |\n" for r in rows)

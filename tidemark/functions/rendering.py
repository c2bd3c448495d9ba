"""Texts made from visits, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.parsing import ITEM_HEADER, LABEL_HEADER

# Headings and phrases of the texts.
BASIC, SHORT, LONG, CODES, EARLIER = "【基本信息】", "【主诉】", "【现病史】", "【西医诊断】", "【既往处方】"
NO_EARLIER = EARLIER + "无（初诊）"


def given() -> Column:
    """The lines about a visit that a model is given; lines without content are left out."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit(BASIC), "sex", F.lit("，"), F.coalesce(F.col("age").cast("string"), F.lit("None")), F.lit("岁")),
        F.concat(F.lit(SHORT), "text_short"),
        F.when(F.col("text_long") != "", F.concat(F.lit(LONG), "text_long")),
        F.when(F.size("codes") > 0, F.concat(F.lit(CODES), F.array_join("codes", ","))),
    )


def given_with_history() -> Column:
    """The same with a line on the entity's previous items."""
    gap = F.when(F.col("prev_gap").isNotNull(), F.concat(F.lit("，间隔 "), F.col("prev_gap").cast("string"), F.lit(" 天"))).otherwise("")
    line = F.concat(F.lit(EARLIER + "第 "), F.coalesce("visit_ix", F.lit(0)).cast("string"), F.lit(" 次复诊"), gap, F.lit("，上次处方："), F.array_join("prev_items", " "))
    return F.concat_ws("\n", given(), F.when(F.coalesce(F.size("prev_items"), F.lit(0)) > 0, line).otherwise(NO_EARLIER))


def label_lines(labels: Column) -> Column:
    """A line for each label; empty levels are left out."""
    return F.array_join(F.transform(labels, lambda x: F.array_join(F.filter(F.array(x.disease, x.pattern, x.goal), lambda v: v != ""), "·")), "\n")


def target(labels: Column, items: Column) -> Column:
    """The text that a model is to give: headed labels and items."""
    return F.concat(F.lit(LABEL_HEADER + "\n"), label_lines(labels), F.lit("\n" + ITEM_HEADER + "\n"), F.array_join(items, " "))


def chat(system: str, user: Column, assistant: Column) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", F.lit(system)), ("user", user), ("assistant", assistant))])


def chat_is_sound(messages: Column) -> Column:
    return F.coalesce(F.transform(messages, lambda m: m.role) == F.array(*map(F.lit, ("system", "user", "assistant"))), F.lit(False))

"""Associations of tokens with items, their concentration in time, and votes of items for labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import clauses
from tidemark.functions.sets import field_set, micro_prf, overlap, r6, safe_ratio
from tidemark.operators.broadcasts import held, small

#: Clauses that are charting phrases rather than findings.
CHARTING = ("病史同前", "病史同", "同前", "同上", "无特殊", "无不适", "无明显不适", "无其他不适", "无其他特殊", "一般情况可", "一般可", "尚可", "可", "无")


def token_vocab(rows: DataFrame, min_count: int, stop: tuple[str, ...] = CHARTING, text: str = "text_long") -> DataFrame:
    """token and n (occurrences, not visits) of tokens that are frequent enough and no charting phrase."""
    counts = rows.select(F.explode(clauses(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= min_count) & ~F.col("token").isin(*stop))


def with_tokens(rows: DataFrame, vocab: DataFrame, text: str = "text_long") -> DataFrame:
    """rid, pid, date and each distinct token of the vocabulary that a row has."""
    return rows.select("rid", "pid", "date", F.explode(F.array_distinct(clauses(F.col(text)))).alias("token")).join(small(vocab.select("token")), "token")


def month(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def time_concentration(rows: DataFrame, key: str) -> DataFrame:
    """The largest share of a key's rows that falls in one month."""
    by_month = rows.groupBy(key, month().alias("month")).agg(F.count("*").alias("n"))
    return by_month.groupBy(key).agg(F.sum("n").alias("n"), r6(F.max("n") / F.sum("n")).alias("concentration"))


def time_entropy(rows: DataFrame, key: str, months: Column | int, n: int) -> DataFrame:
    """The n keys whose rows are spread least over the months: entropy over that of an even spread (null for one month)."""
    by_month = rows.groupBy(key, month().alias("month")).agg(F.count("*").alias("n"))
    total = by_month.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    entropy = F.try_divide(F.ln("total") - F.col("s") / F.col("total"), F.ln(F.lit(months).cast("double")))
    return total.select(key, F.col("total").alias("n"), r6(entropy).alias("entropy")).orderBy("entropy", key).limit(n)


def associations(rows: DataFrame, tokens: DataFrame, min_rows: int, min_token: int, min_visits: int, min_entities: int, min_lift: float, min_share: float, n: int) -> DataFrame:
    """stratum, token, item, visits, entities, share P(item|token), lift, concentration and suspicious of the n best rows of each stratum.

    rows (rid, pid, date, items, strata): a visit counts in each of its strata; strata of fewer than `min_rows` visits are left out. All rates and
    lifts are those within the stratum, so what only the stratum explains isn't an association. Of an item's tokens the best row stays: not suspicious (few visits per entity, spread over months) first, then by
    entities per visit and lift. Counts by token, by item and by both are grouped apart and joined, so none meets a pair of
    visits.
    """
    rows = held(rows.select("rid", "pid", "date", "items", F.explode("strata").alias("stratum")))
    total = rows.groupBy("stratum").agg(F.count("*").alias("total")).where(F.col("total") >= min_rows)
    items = rows.select("stratum", "rid", "pid", "date", F.explode("items").alias("item"))
    by_month = items.groupBy("stratum", "item", month().alias("month")).agg(F.count("*").alias("n"))
    per_item = by_month.groupBy("stratum", "item").agg(F.sum("n").alias("n_item"), r6(F.max("n") / F.sum("n")).alias("concentration"))
    of_row = tokens.groupBy("rid").agg(F.collect_list("token").alias("tokens"))
    told = rows.join(of_row, "rid").select("stratum", "pid", "items", F.explode("tokens").alias("token"))
    per_token = told.groupBy("stratum", "token").agg(F.count("*").alias("n_token")).where(F.col("n_token") >= min_token)
    both = told.select("stratum", "pid", "token", F.explode("items").alias("item")).groupBy("stratum", "token", "item", "pid").agg(F.count("*").alias("c"))
    both = both.groupBy("stratum", "token", "item").agg(F.sum("c").alias("visits"), F.count("*").alias("entities")).where(F.col("visits") >= min_visits)
    joined = both.join(small(per_token), ["stratum", "token"]).join(small(per_item), ["stratum", "item"]).join(small(total), "stratum")
    share = F.col("visits") / F.col("n_token")
    scored = joined.withColumns({"share": share, "lift": share / (F.col("n_item") / F.col("total"))}).where((F.col("entities") >= min_entities) & (F.round("lift", 9) >= min_lift) & (F.col("share") >= min_share))
    scored = scored.withColumn("suspicious", (F.col("visits") / F.col("entities") > 5) | (F.col("concentration") > 0.5))
    order = [F.col("suspicious"), F.round(-F.col("entities") / F.col("visits"), 9), F.round(-F.col("lift"), 9), F.col("token")]
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("stratum", "item").orderBy(*order))).where("r = 1")
    first = best.withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy(*order[:3], "item"))).where(F.col("r") <= n)
    return first.select("stratum", "token", "item", "visits", "entities", r6(F.col("share")).alias("share"), r6(F.col("lift")).alias("lift"), "concentration", "suspicious")


def goal_vote(train: DataFrame, test: DataFrame, votes: int = 3) -> DataFrame:
    """Micro precision, recall and F1 of the goals with the largest sums of P(goal|item) over a row's items."""
    pairs = train.select(F.explode("items").alias("item"), field_set(F.col("labels"), "goal").alias("goals"))
    n = pairs.groupBy("item").agg(F.count("*").alias("n"))
    p = pairs.select("item", F.explode("goals").alias("goal")).groupBy("item", "goal").agg(F.count("*").alias("c")).join(n, "item").select("item", "goal", (F.col("c") / F.col("n")).alias("p"))
    summed = test.select("rid", F.explode("items").alias("item")).join(small(p), "item").groupBy("rid", "goal").agg(F.round(F.sum("p"), 9).alias("s"))
    top = summed.withColumn("r", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("s"), "goal"))).where(F.col("r") <= votes)
    guess = top.groupBy("rid").agg(F.collect_list("goal").alias("guess"))
    rows = test.select("rid", field_set(F.col("labels"), "goal").alias("goals")).join(guess, "rid", "left")
    rows = rows.withColumn("guess", F.coalesce("guess", F.array().cast("array<string>")))
    tp, a, b = F.sum(overlap(F.col("guess"), F.col("goals"))), F.sum(F.size("guess")), F.sum(F.size("goals"))
    prec, rec, f1 = micro_prf(tp, a - tp, b - tp)
    return rows.agg(F.count("*").alias("n"), r6(prec).alias("precision"), r6(rec).alias("recall"), r6(f1).alias("f1"))


def weighted_coverage(rows: DataFrame, weight: str, tests: dict[str, Column]) -> DataFrame:
    """Of each test the share of rows that pass, and that of their weights."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), c.alias("ok")) for name, c in tests.items()])
    out = rows.select(F.col(weight).alias("w"), F.explode(each).alias("t"))
    return out.groupBy(F.col("t.field").alias("field")).agg(F.count_if("t.ok").alias("n"), r6(F.avg(F.col("t.ok").cast("int"))).alias("share"), r6(safe_ratio(F.sum(F.when(F.col("t.ok"), F.col("w")).otherwise(0)), F.sum("w"))).alias("weighted"))

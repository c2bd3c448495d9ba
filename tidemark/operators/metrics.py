"""Metrics of predicted item and label sets, by subset, and gates on them.

All of them are single aggregates over rows with array columns; results are long tables (metric, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sets import field_set, jaccard, micro_prf, overlap, r6, safe_ratio
from tidemark.operators.checks import pick_by_index
from tidemark.operators.priors import literal

#: Rows that a subset needs, and references that a label needs for the macro average.
MIN_SUBSET, MIN_SUPPORT = 30, 20


def long(wide: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, metric and value of a table with a column for each metric; values rounded to six places."""
    names = [c for c in wide.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), r6(F.col(c).cast("double")).alias("value")) for c in names])
    return wide.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*")


def item_metrics(rows: DataFrame, key_items: Sequence[str], vocabulary: Sequence[str], keys: Sequence[str] = (), raw: str = "pred") -> DataFrame:
    """Precision, recall, F1, Jaccard (mean and upper median), exact matches, recall of key items, and rates of empty,
    unknown and repeated predictions, of `rows` (pred, items), by `keys`. Repeats are counted in the column `raw`."""
    p, g, k = F.array_distinct("pred"), F.array_distinct("items"), literal(key_items)
    known = F.array_intersect(g, k)
    one = rows.select(
        *keys, overlap(p, g).alias("tp"), F.size(p).alias("p"), F.size(g).alias("g"), jaccard(p, g).alias("j"), overlap(F.array_intersect(p, k), known).alias("hit"), F.size(known).alias("known"),
        F.size(F.array_except(p, literal(vocabulary))).alias("unknown"), F.size(raw).alias("raw"), (F.size(raw) - F.size(F.array_distinct(raw))).alias("again"),
    )
    s = F.sum
    tp, np_, ng = s("tp"), s("p"), s("g")
    prec, rec, f1 = micro_prf(tp, np_ - tp, ng - tp)
    wide = one.groupBy(*keys).agg(
        F.count("*").alias("n"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), F.avg("j").alias("jaccard"),
        F.avg(((F.col("tp") == F.col("p")) & (F.col("tp") == F.col("g")) & (F.col("g") > 0)).cast("int")).alias("exact"),
        safe_ratio(s("hit"), s("known")).alias("key_recall"), F.avg((F.col("p") == 0).cast("int")).alias("empty_rate"), safe_ratio(s("unknown"), np_).alias("unknown_rate"),
        safe_ratio(s("again"), s("raw")).alias("repeat_rate"), F.avg("p").alias("mean_predicted"), F.avg("g").alias("mean_true"),
    )
    median = pick_by_index(one, list(keys), "j", {"jaccard_median": F.expr("c div 2")})
    both = long(wide, keys).unionByName(long(median.select(*keys, "jaccard_median"), keys))
    return both


def field_metrics(rows: DataFrame, fields: Sequence[str] = ("disease", "pattern", "goal")) -> DataFrame:
    """Micro precision, recall and F1 of each level of the labels, and the share of rows whose label sets agree."""
    sums = []
    for f in fields:
        a, b = field_set(F.col("pred_labels"), f), field_set(F.col("labels"), f)
        sums += [F.sum(overlap(a, b)).alias(f"{f}_tp"), F.sum(F.size(a)).alias(f"{f}_p"), F.sum(F.size(b)).alias(f"{f}_g")]
    same = (F.sort_array(F.array_distinct("pred_labels")) == F.sort_array(F.array_distinct("labels"))) & (F.size("labels") > 0)
    total = rows.agg(*sums, F.avg(same.cast("int")).alias("exact"))
    out = []
    for f in fields:
        tp = F.col(f"{f}_tp")
        for name, c in zip(("precision", "recall", "f1"), micro_prf(tp, F.col(f"{f}_p") - tp, F.col(f"{f}_g") - tp), strict=True):
            out.append(c.alias(f"{f}_{name}"))
    return long(total.select(*out, "exact"))


def macro_f1(rows: DataFrame, pred: Column, ref: Column, min_support: int = MIN_SUPPORT) -> DataFrame:
    """The mean F1 over values with enough references, and their number."""
    each = rows.select(F.explode(F.array_union(pred, ref)).alias("value"), pred.alias("a"), ref.alias("b"))
    hit = each.select("value", F.array_contains("a", F.col("value")).alias("a"), F.array_contains("b", F.col("value")).alias("b"))
    counts = hit.groupBy("value").agg(F.count_if(F.col("a") & F.col("b")).alias("tp"), F.count_if(F.col("a") & ~F.col("b")).alias("fp"), F.count_if(~F.col("a") & F.col("b")).alias("fn"))
    f1 = micro_prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    return counts.where(F.col("tp") + F.col("fn") >= min_support).agg(r6(F.coalesce(F.avg(f1), F.lit(0.0))).alias("macro_f1"), F.count("*").alias("n"))


def safety_rates(rows: DataFrame, toxic: Sequence[str], cold: Sequence[str], hot: Sequence[str], most: int) -> DataFrame:
    """Shares of predictions (and of references) with a toxic item, with cold and hot items together, and of overlong ones."""
    def has(c, names):
        return F.arrays_overlap(c, literal(names))

    out = []
    for name, c in (("pred", "pred"), ("true", "items")):
        out += [F.avg(has(c, toxic).cast("int")).alias(f"toxic_{name}"), F.avg((has(c, cold) & has(c, hot)).cast("int")).alias(f"mixed_{name}")]
    return long(rows.agg(*out, F.avg((F.size(F.array_distinct("pred")) > most).cast("int")).alias("overlong")))


def subsets(rows: DataFrame) -> Column:
    """Names of the overlapping subsets of a row, which needs columns _same (rows with its item text) and _visits (rows of its entity)."""
    first = F.coalesce(F.size("prev_items"), F.lit(0)) == 0
    flag = lambda *names: F.arrays_overlap("flags", literal(names))
    masks = {
        "all": F.lit(True), "first": first, "followup": ~first, "repeated_items": F.col("_same") > 1, "unique_items": F.col("_same") == 1, "many_visits": F.col("_visits") > 1,
        "one_visit": F.col("_visits") == 1, "usual_length": ~flag("length_outlier"), "odd_length": flag("length_outlier"), "text_differs": ~flag("text_prefix", "text_equal"),
    }
    return F.array_compact(F.array(*[F.when(m, name) for name, m in masks.items()]))


def with_subsets(rows: DataFrame) -> DataFrame:
    """Each row once for every subset that it is in, as column subset.

    The counts behind two of the masks are grouped and joined back rather than windowed, so a very common item text is
    one row before it meets the others.
    """
    same = rows.groupBy(F.array_join("items", " ").alias("_text")).agg(F.count("*").alias("_same"))
    many = rows.groupBy(F.col("pid").alias("_pid")).agg(F.count("*").alias("_visits"))
    joined = rows.withColumn("_own", F.array_join("items", " ")).join(same, F.col("_own") == F.col("_text")).join(many, F.col("pid") == F.col("_pid"))
    return joined.withColumn("subset", F.explode(subsets(joined))).drop("_own", "_text", "_pid", "_same", "_visits")


def subset_metrics(rows: DataFrame, min_rows: int = MIN_SUBSET) -> DataFrame:
    """n, mean Jaccard, micro recall and exact matches of each subset with enough rows."""
    tp, g = overlap(F.col("pred"), F.col("items")), F.size(F.array_distinct("items"))
    exact = F.sort_array(F.array_distinct("pred")) == F.sort_array(F.array_distinct("items"))
    out = with_subsets(rows).groupBy("subset").agg(F.count("*").alias("n"), r6(F.avg(jaccard(F.col("pred"), F.col("items")))).alias("jaccard"), r6(safe_ratio(F.sum(tp), F.sum(g))).alias("recall"), r6(F.avg(exact.cast("int"))).alias("exact"))
    return out.where(F.col("n") >= min_rows)


def gate_status(metrics: DataFrame, gates: Sequence[tuple[str, float, float, str]]) -> DataFrame:
    """metric, value and status (target, must, fail) against gates of (metric, must, target, '>=' or '<=')."""
    table = metrics.sparkSession.createDataFrame(list(gates), "metric string, must double, target double, direction string")
    up = F.col("direction") == ">="
    meets = lambda c: F.when(up, F.col("value") >= F.col(c)).otherwise(F.col("value") <= F.col(c))
    status = F.when(meets("target"), "target").when(meets("must"), "must").otherwise("fail")
    return metrics.join(F.broadcast(table), "metric").select("metric", "value", status.alias("status"))


def balanced(by_subset: DataFrame, value: str, parts: Sequence[str] = ("first", "followup")) -> DataFrame:
    """The unweighted mean over some subsets."""
    return by_subset.where(F.col("subset").isin(*parts)).agg(r6(F.avg(value)).alias("balanced"), F.count("*").alias("parts"))


def missing(refs: DataFrame, preds: DataFrame, key: str = "rid") -> DataFrame:
    return refs.select(key).join(preds.select(key), key, "left_anti")


def last_of_each(preds: DataFrame, key: str = "rid", order: str = "seq") -> DataFrame:
    """Of predictions with the same key the last one."""
    others = [c for c in preds.columns if c != key]
    return preds.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("p")).select(key, "p.*")



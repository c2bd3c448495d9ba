"""Queries on linked visits."""

from pyspark.sql import functions as F

from tidemark.functions.sets import changed, jaccard, overlap, r6, safe_ratio
from tidemark.operators.history import is_followup, link_history
from tidemark.plans.catalog import jaccard as jac
from tidemark.plans.catalog import query, with_visits
from tidemark.sources.visits import visits


@query(with_visits("""SELECT rid, pid, visit_ix, n_visits, visit_ix_items, n_items_visits, coalesce(array_to_string(prev_items, ' '), '-') AS prev_items, prev_gap FROM linked"""))
def visit_history(spark, sf_dir):
    return link_history(visits(spark, sf_dir)).select("rid", "pid", "visit_ix", "n_visits", "visit_ix_items", "n_items_visits", F.coalesce(F.array_join("prev_items", " "), F.lit("-")).alias("prev_items"), "prev_gap")


@query(with_visits(f""", f AS (SELECT len(list_intersect(items, prev_items)) AS tp, len(prev_items) AS p, len(items) AS r, {jac('items', 'prev_items')} AS j FROM linked WHERE has_items AND followup)
SELECT count(*) AS n, round(avg(j), 6) AS jaccard, round(sum(tp) / sum(p), 6) AS "precision", round(sum(tp) / sum(r), 6) AS recall FROM f"""))
def copy_previous_metrics(spark, sf_dir):
    """How well an entity's previous items predict its present ones: one window, array functions, one aggregate."""
    linked = link_history(visits(spark, sf_dir)).where(F.col("has_items") & is_followup())
    tp = F.sum(overlap(F.col("items"), F.col("prev_items")))
    return linked.agg(F.count("*").alias("n"), r6(F.avg(jaccard(F.col("items"), F.col("prev_items")))).alias("jaccard"), r6(safe_ratio(tp, F.sum(F.size("prev_items")))).alias("precision"), r6(safe_ratio(tp, F.sum(F.size("items")))).alias("recall"))


@query(with_visits("""SELECT count(*) AS n, round(avg((list_sort(items) = list_sort(prev_items))::INT), 6) AS share FROM linked WHERE has_items AND followup"""))
def unchanged_share(spark, sf_dir):
    linked = link_history(visits(spark, sf_dir)).where(F.col("has_items") & is_followup())
    return linked.agg(F.count("*").alias("n"), r6(F.avg((F.sort_array("items") == F.sort_array("prev_items")).cast("int"))).alias("share"))


@query(with_visits(f"""SELECT rid, array_to_string(list_filter(items, lambda x: list_contains(prev_items, x)), ' ') AS kept, array_to_string(list_filter(items, lambda x: NOT list_contains(prev_items, x)), ' ') AS added,
array_to_string(list_filter(prev_items, lambda x: NOT list_contains(items, x)), ' ') AS removed, round({jac('items', 'prev_items')}, 6) AS jaccard FROM linked WHERE has_items AND followup"""))
def item_diff(spark, sf_dir):
    linked = link_history(visits(spark, sf_dir)).where(F.col("has_items") & is_followup())
    c = linked.select("rid", changed(F.col("items"), F.col("prev_items")).alias("c"))
    return c.select("rid", *[F.array_join(f"c.{x}", " ").alias(x) for x in ("kept", "added", "removed")], r6(F.col("c.jaccard")).alias("jaccard"))


@query(with_visits("""SELECT date_part('year', date)::INT AS year, count(*) AS n, round(avg(followup::INT), 6) AS share FROM linked WHERE has_items GROUP BY 1"""))
def followup_share(spark, sf_dir):
    linked = link_history(visits(spark, sf_dir)).where("has_items")
    return linked.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), r6(F.avg(is_followup().cast("int"))).alias("share"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
 last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events)
SELECT event_id, user_id, coalesce(prev, '-') AS prev_type, date_diff('day', CAST(before AS DATE), CAST(ts AS DATE)) AS gap FROM e""")
def event_history(spark, sf_dir):
    """The same as-of link over the event stream: the last earlier event of another type than a view."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.last(F.when(F.col("event_type") != "view", F.col("event_type")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", F.coalesce(last, F.lit("-")).alias("prev_type"), F.datediff(F.to_date("ts"), F.to_date(F.lag("ts").over(w))).alias("gap"))

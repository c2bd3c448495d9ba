"""Queries on pools, splits and samples."""

from pyspark.sql import functions as F

from tidemark.functions.sets import r6
from tidemark.operators import pools, splits
from tidemark.operators.history import is_followup, link_history
from tidemark.plans.catalog import query, with_visits
from tidemark.sources.visits import visits

CUTOFF = "1999-01-01"


def gold(spark, sf_dir):
    return link_history(visits(spark, sf_dir)).where(pools.is_gold())


@query(with_visits("""SELECT sex, count(*) AS n, count(DISTINCT pid) AS entities FROM gold GROUP BY sex"""))
def gold_pool(spark, sf_dir):
    return gold(spark, sf_dir).groupBy("sex").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("entities"))


@query(with_visits("""SELECT rid, pid FROM visits WHERE text_short <> '' AND has_labels AND NOT has_items"""))
def label_only_pool(spark, sf_dir):
    return visits(spark, sf_dir).where(pools.is_label_only()).select("rid", "pid")


@query(with_visits(""", pool AS (SELECT rid, pid FROM visits WHERE text_short <> '' AND has_labels AND NOT has_items AND NOT list_has_any(flags, ['sex_outlier', 'age_outlier']) AND pid NOT IN (SELECT pid FROM split WHERE split <> 'train'))
SELECT rid, pid, 'pool' AS origin FROM pool UNION ALL SELECT rid, pid, 'train' FROM train"""))
def contamination_guard(spark, sf_dir):
    """Training rows and the label-only rows that may join them."""
    v = visits(spark, sf_dir)
    parts = splits.by_entity(v.where(pools.is_gold()))
    pool = pools.guarded_pool(v.where(pools.is_label_only()), parts.where("split <> 'train'"))
    return pool.select("rid", "pid", F.lit("pool").alias("origin")).unionByName(parts.where("split = 'train'").select("rid", "pid", F.lit("train").alias("origin")))


@query(with_visits("""SELECT split, count(*) AS n, count(DISTINCT pid) AS entities, round(avg(followup::INT), 6) AS followup_share FROM split GROUP BY split"""))
def entity_split_counts(spark, sf_dir):
    return splits.by_entity(gold(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("entities"), r6(F.avg(is_followup().cast("int"))).alias("followup_share"))


@query(with_visits("""SELECT rid, split FROM split"""))
def entity_split_rows(spark, sf_dir):
    return splits.by_entity(gold(spark, sf_dir)).select("rid", "split")


@query(with_visits("""SELECT a.split AS a, b.split AS b, count(*) AS shared FROM entity_split a JOIN entity_split b ON a.pid = b.pid AND a.split <> b.split GROUP BY ALL UNION ALL SELECT 'any', 'any', 0"""))
def split_overlap(spark, sf_dir):
    """Entities on two sides: none, so that the count of the last row is all there is."""
    s = splits.by_entity(gold(spark, sf_dir)).select("pid", "split").distinct()
    both = s.alias("x").join(s.alias("y"), "pid").where("x.split <> y.split").groupBy(F.col("x.split").alias("a"), F.col("y.split").alias("b")).agg(F.count("*").alias("shared"))
    return both.unionByName(s.sparkSession.range(1).select(F.lit("any").alias("a"), F.lit("any").alias("b"), F.lit(0).cast("long").alias("shared")))


@query(with_visits(f""", early AS (SELECT * FROM gold WHERE date < DATE '{CUTOFF}'), late AS (SELECT * FROM gold WHERE date >= DATE '{CUTOFF}' AND pid NOT IN (SELECT pid FROM early))
SELECT rid, 'train' AS split FROM early UNION ALL SELECT rid, 'test' FROM late"""))
def time_split(spark, sf_dir):
    return splits.by_time(gold(spark, sf_dir), CUTOFF).select("rid", "split")


ROW_SPLIT = """, row_ranked AS (SELECT *, row_number() OVER (ORDER BY sha256(rid || ':42'), rid) AS rr, count(*) OVER () AS rn FROM gold),
row_split AS (SELECT *, CASE WHEN rr <= floor(rn * 0.8) THEN 'train' WHEN rr <= floor(rn * 0.8) + floor(rn * 0.1) THEN 'val' ELSE 'test' END AS split FROM row_ranked)
"""


@query(with_visits(ROW_SPLIT + """SELECT count(*) AS rows, count(*) FILTER (pid IN (SELECT pid FROM row_split WHERE split = 'train')) AS seen_rows, count(DISTINCT pid) AS entities,
count(DISTINCT pid) FILTER (pid IN (SELECT pid FROM row_split WHERE split = 'train')) AS seen_entities FROM row_split WHERE split = 'test'"""))
def row_split_leak(spark, sf_dir):
    """What a split by rows leaks, by rows and by entities."""
    return splits.seen_share(splits.by_row(gold(spark, sf_dir)))


@query(with_visits(""", s AS (SELECT rid, followup, row_number() OVER (PARTITION BY followup ORDER BY sha256(rid || ':42'), rid) AS r, count(*) OVER (PARTITION BY followup) AS n, count(*) OVER () AS c FROM gold)
SELECT rid, followup FROM s WHERE r <= floor(n * 300 / c + 0.5)"""))
def stratified_sample(spark, sf_dir):
    g = gold(spark, sf_dir).select("rid", is_followup().alias("followup"))
    return splits.stratified(g, "followup", "rid", 300).select("rid", "followup")


@query(with_visits("""SELECT rid, CAST((row_number() OVER (ORDER BY sha256(rid || ':42'), rid) - 1) % 5 AS INT) AS fold FROM gold"""))
def fold_assignment(spark, sf_dir):
    return splits.folds(gold(spark, sf_dir).select("rid"), "rid", 5)


@query(with_visits("""SELECT rid, followup FROM test WHERE followup ORDER BY rid LIMIT 100"""))
def prediction_subset(spark, sf_dir):
    """The first test rows of one kind, as a prediction run takes them."""
    t = splits.by_entity(gold(spark, sf_dir)).where((F.col("split") == "test") & is_followup())
    return t.orderBy("rid").limit(100).select("rid", is_followup().alias("followup"))


@query(with_visits("""SELECT split, count(*) AS chats, count(*) AS refs, count(*) FILTER (followup) AS followups, CAST(floor(count(*) / 16) AS BIGINT) * 2 AS steps FROM split GROUP BY split"""))
def training_steps(spark, sf_dir):
    """Rows of chat and reference tables by split, and the optimizer steps of two epochs in batches of 16."""
    s = splits.by_entity(gold(spark, sf_dir))
    return s.groupBy("split").agg(F.count("*").alias("chats"), F.count("rid").alias("refs"), F.count_if(is_followup()).alias("followups"), (F.floor(F.count("*") / 16) * 2).alias("steps"))

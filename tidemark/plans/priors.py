"""Queries on item frequencies and the predictors made of them."""

from pyspark.sql import functions as F

from tidemark.functions.sets import jaccard, r6
from tidemark.operators import priors as K
from tidemark.operators import splits
from tidemark.operators.broadcasts import held
from tidemark.operators.history import is_followup
from tidemark.plans.catalog import field, query, with_visits
from tidemark.plans.catalog import jaccard as jac
from tidemark.plans.pools import gold
from tidemark.sources.visits import visits

TOP = 4


def sides(spark, sf_dir):
    s = held(splits.by_entity(gold(spark, sf_dir)))
    return s.where("split = 'train'"), s.where("split = 'test'")


def prior_sql(keys: list[str], k: int = TOP, name: str = "pred", pad: bool = True) -> str:
    """CTEs that end in `name`: test rows with the k most frequent items of the first key that training knows."""
    out = ""
    for i, key in enumerate(keys):
        out += f""", {name}_c{i} AS (SELECT {key} AS key, item, count(*) AS n FROM (SELECT *, unnest(items) AS item FROM train) GROUP BY ALL),
{name}_t{i} AS (SELECT key, list(item ORDER BY n DESC, item) AS top FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, item) AS r FROM {name}_c{i}) WHERE r <= {k} GROUP BY key)
"""
    tops = ", ".join(f"t{i}.top" for i in range(len(keys))) or "NULL"
    joins = " ".join(f"LEFT JOIN {name}_t{i} t{i} ON t{i}.key = {key}" for i, key in enumerate(keys))
    rest = f"(SELECT list(item ORDER BY r) FROM top_items WHERE r <= {k})" if pad else "[]"
    return out + f""", {name}_raw AS (SELECT test.*, list_concat(coalesce({tops}, []), {rest}) AS merged FROM test {joins}),
{name} AS (SELECT * EXCLUDE (merged), list_slice(list_filter(merged, lambda v, k: list_position(merged, v) = k), 1, {k}) AS pred FROM {name}_raw)
"""


CONST, CODES = "['all']", "list_sort(codes)"
DEMO = "[sex, CAST(least(floor(coalesce(age, 0) / 10) * 10, 80) AS BIGINT)::VARCHAR]"
CODES_DEMO = f"list_concat(list_concat({CODES}, ['|']), {DEMO})"
PATTERN, DISEASE, GOAL = (field("labels", f) for f in ("pattern", "disease", "goal"))
PAIRS = "list_sort(list_distinct(list_transform(list_filter(labels, lambda z: z.pattern <> ''), lambda z: z.disease || '/' || z.pattern)))"
PREDICTORS = {
    "b1_constant": ([K.key_const], [CONST]), "b2_codes": ([K.key_codes], [CODES]), "b3_demographic": ([K.key_demo], [DEMO]), "b4_codes_demo": ([K.key_codes_demo], [CODES_DEMO]),
    "o1_pattern": ([lambda: K.key_field("pattern")], [PATTERN]), "o2_disease": ([lambda: K.key_field("disease")], [DISEASE]), "o3_pairs": ([K.key_pairs], [PAIRS]),
    "o4_goal": ([lambda: K.key_field("goal")], [GOAL]), "o5_fallback": ([K.key_pairs, lambda: K.key_field("pattern")], [PAIRS, PATTERN]),
}


def _register(name, keys, sql_keys):
    def run(spark, sf_dir):
        train, test = sides(spark, sf_dir)
        out = K.predict(test, train, [k() for k in keys], TOP)
        return out.select("rid", F.array_join("pred", " ").alias("pred"), r6(jaccard(F.col("pred"), F.col("items"))).alias("jaccard"))

    run.__name__ = name
    query(with_visits(prior_sql(sql_keys) + f"SELECT rid, array_to_string(pred, ' ') AS pred, round({jac('pred', 'items')}, 6) AS jaccard FROM pred"))(run)


for _name, (_keys, _sql) in PREDICTORS.items():
    _register(_name, _keys, _sql)


@query(with_visits("""SELECT item, n, r AS rank FROM top_items WHERE r <= 15"""))
def top_items(spark, sf_dir):
    train, _ = sides(spark, sf_dir)
    return K.top_items(train, 15).select("item", "n", F.col("rank").cast("long").alias("rank"))


@query(with_visits(""", every AS (SELECT item, count(*) AS n FROM (SELECT unnest(items) AS item FROM visits) GROUP BY item)
SELECT every.item, every.n, row_number() OVER (ORDER BY every.n DESC, every.item) AS rank, coalesce(top_items.r <= 10, FALSE) AS is_key FROM every LEFT JOIN top_items ON every.item = top_items.item"""))
def vocab_rank(spark, sf_dir):
    """The vocabulary of all visits; what counts as a key item is decided by the training rows."""
    train, _ = sides(spark, sf_dir)
    key = K.top_items(train, 10).select("item", F.lit(True).alias("is_key"))
    return K.top_items(visits(spark, sf_dir)).join(F.broadcast(key), "item", "left").select("item", "n", F.col("rank").cast("long").alias("rank"), F.coalesce("is_key", F.lit(False)).alias("is_key"))


@query(with_visits(prior_sql([PATTERN]) + """SELECT array_to_string(key, '+') AS key, array_to_string(top, ' ') AS top FROM pred_t0"""))
def prior_topk(spark, sf_dir):
    train, _ = sides(spark, sf_dir)
    return K.keyed_top(train, K.key_field("pattern"), TOP).select(F.array_join("key", "+").alias("key"), F.array_join("top", " ").alias("top"))


def label_sql(key: str, name: str = "lab") -> str:
    return f""", {name}_c AS (SELECT {key} AS key, labels, count(*) AS n FROM train GROUP BY ALL),
{name}_k AS (SELECT key, labels FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, labels) AS r FROM {name}_c) WHERE r = 1),
{name}_a AS (SELECT labels FROM (SELECT labels, row_number() OVER (ORDER BY count(*) DESC, labels) AS r FROM train GROUP BY labels) WHERE r = 1),
{name} AS (SELECT test.*, coalesce(k.labels, (SELECT labels FROM {name}_a)) AS pred_labels FROM test LEFT JOIN {name}_k k ON k.key = {key})
"""


LABEL_KEYS = {"d1_constant": (K.key_const, CONST), "d2_codes": (K.key_codes, CODES), "d3_demographic": (K.key_demo, DEMO)}


def _register_labels(name, key, sql_key):
    def run(spark, sf_dir):
        train, test = sides(spark, sf_dir)
        out = K.predict_labels(test, train, key())
        return out.select("rid", F.array_join(F.transform("pred_labels", lambda x: F.concat_ws("·", x.disease, x.pattern, x.goal)), ";").alias("pred"))

    run.__name__ = name
    query(with_visits(label_sql(sql_key) + "SELECT rid, array_to_string(list_transform(pred_labels, lambda x: x.disease || '·' || x.pattern || '·' || x.goal), ';') AS pred FROM lab"))(run)


for _name, (_key, _sql) in LABEL_KEYS.items():
    _register_labels(_name, _key, _sql)


def pattern_f1(rows, labels="labels", pred="pred_labels"):
    from tidemark.functions.sets import field_set, micro_prf, overlap

    a, b = field_set(F.col(pred), "pattern"), field_set(F.col(labels), "pattern")
    tp, p, r = F.sum(overlap(a, b)), F.sum(F.size(a)), F.sum(F.size(b))
    return rows.agg(micro_prf(tp, p - tp, r - tp)[2].alias("f1")).first().f1


R0_SQL = "".join(label_sql(sql, name) for name, (_, sql) in LABEL_KEYS.items()) + ", scored AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS name, sum(len(list_intersect({field('pred_labels', 'pattern')}, {PATTERN}))) AS tp, sum(len({field('pred_labels', 'pattern')})) AS p, sum(len({PATTERN})) AS r FROM {name}" for name in LABEL_KEYS
) + """), picked AS (SELECT name FROM scored ORDER BY round(2 * tp / (p + r), 9) DESC, name LIMIT 1),
guessed AS (""" + " UNION ALL ".join(f"SELECT '{name}' AS name, * FROM {name}" for name in LABEL_KEYS) + f"""),
r0_c AS (SELECT {PATTERN} AS key, item, count(*) AS n FROM (SELECT *, unnest(items) AS item FROM train) GROUP BY ALL),
r0_t AS (SELECT key, list(item ORDER BY n DESC, item) AS top FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, item) AS r FROM r0_c) WHERE r <= {TOP} GROUP BY key),
r0_raw AS (SELECT g.rid, g.items, g.name, list_concat(coalesce(t.top, []), (SELECT list(item ORDER BY r) FROM top_items WHERE r <= {TOP})) AS merged FROM guessed g JOIN picked USING (name) LEFT JOIN r0_t t ON t.key = {field('g.pred_labels', 'pattern')}),
r0 AS (SELECT rid, items, name, list_slice(list_filter(merged, lambda v, k: list_position(merged, v) = k), 1, {TOP}) AS pred FROM r0_raw)
"""


@query(with_visits(R0_SQL + f"SELECT rid, name AS labeller, array_to_string(pred, ' ') AS pred, round({jac('pred', 'items')}, 6) AS jaccard FROM r0"))
def r0_end_to_end(spark, sf_dir):
    """Items from predicted labels: the labeller with the best pattern F1, then the prior of the predicted patterns."""
    train, test = sides(spark, sf_dir)
    tried = {name: K.predict_labels(test, train, key()) for name, (key, _) in LABEL_KEYS.items()}
    best = min(tried, key=lambda name: (-round(pattern_f1(tried[name]), 9), name))
    prior = K.keyed_top(train, K.key_field("pattern"), TOP)
    joined = tried[best].withColumn("_q", K.key_field("pattern", "pred_labels")).join(K.small(prior), F.col("_q") == F.col("key"), "left")
    out = joined.withColumn("pred", K.padded(F.col("top"), K.top_list(train, TOP), TOP))
    return out.select("rid", F.lit(best).alias("labeller"), F.array_join("pred", " ").alias("pred"), r6(jaccard(F.col("pred"), F.col("items"))).alias("jaccard"))


@query(with_visits(f"""SELECT rid, array_to_string(prev_items, ' ') AS pred, round({jac('prev_items', 'items')}, 6) AS jaccard FROM test WHERE followup"""))
def x1_copy(spark, sf_dir):
    _, test = sides(spark, sf_dir)
    return test.where(is_followup()).select("rid", F.array_join("prev_items", " ").alias("pred"), r6(jaccard(F.col("prev_items"), F.col("items"))).alias("jaccard"))


@query(with_visits(prior_sql([PAIRS, PATTERN]) + f""", x AS (SELECT rid, items, CASE WHEN followup THEN prev_items ELSE pred END AS p FROM pred)
SELECT rid, array_to_string(p, ' ') AS pred, round({jac('p', 'items')}, 6) AS jaccard FROM x"""))
def x2_combo(spark, sf_dir):
    """Previous items where there are any, else the prior with fallback."""
    train, test = sides(spark, sf_dir)
    out = K.predict(test, train, [K.key_pairs(), K.key_field("pattern")], TOP)
    p = F.when(is_followup(), F.col("prev_items")).otherwise(F.col("pred"))
    return out.select("rid", F.array_join(p, " ").alias("pred"), r6(jaccard(p, F.col("items"))).alias("jaccard"))


K_SWEEP = (2, 4, 6, 8)


@query(with_visits("".join(prior_sql([PATTERN], k, f"p{k}") for k in K_SWEEP) + " UNION ALL ".join(f"SELECT {k} AS k, round(avg({jac('pred', 'items')}), 6) AS jaccard FROM p{k}" for k in K_SWEEP)))
def k_sweep(spark, sf_dir):
    """One prior of the largest k, cut to each k."""
    train, test = sides(spark, sf_dir)
    most = max(K_SWEEP)
    prior, rest = K.keyed_top(train, K.key_field("pattern"), most), K.top_list(train, most)
    joined = test.withColumn("_q", K.key_field("pattern")).join(K.small(prior), F.col("_q") == F.col("key"), "left")
    each = joined.withColumn("k", F.explode(F.array(*map(F.lit, K_SWEEP))))
    lists = F.concat(F.slice(F.coalesce("top", K.literal([])), F.lit(1), F.col("k")), F.slice(K.literal(rest), F.lit(1), F.col("k")))
    pred = F.slice(F.array_distinct(lists), F.lit(1), F.col("k"))
    return each.groupBy("k").agg(r6(F.avg(jaccard(pred, F.col("items")))).alias("jaccard"))


@query(with_visits(""", g AS (SELECT l.pattern, l.goal, count(*) AS n FROM (SELECT unnest(labels) AS l FROM train) GROUP BY ALL)
SELECT pattern, goal, n FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, goal) AS r FROM g) WHERE r = 1"""))
def argmax_goal(spark, sf_dir):
    train, _ = sides(spark, sf_dir)
    return K.argmax_by(train.select(F.explode("labels").alias("l")).select("l.*"), "pattern", "goal")

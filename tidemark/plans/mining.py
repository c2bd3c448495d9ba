"""Queries on resampling, associations, naive Bayes scores and retrieval."""

from pyspark.sql import functions as F

from tidemark.functions.parsing import clauses
from tidemark.functions.sets import field_set, jaccard
from tidemark.operators import bayes, mining, retrieval, splits
from tidemark.operators import priors as K
from tidemark.operators.broadcasts import held, stored
from tidemark.operators import resample as R
from tidemark.operators.history import is_followup, link_history
from tidemark.operators.pools import is_gold
from tidemark.plans.catalog import field, query, ratio, with_visits
from tidemark.plans.catalog import jaccard as jac
from tidemark.plans.metrics import SUBSETS
from tidemark.plans.pools import gold
from tidemark.plans.priors import PAIRS, PATTERN, TOP, prior_sql, sides
from tidemark.sources.visits import table, visits

TIMES = 1000


def hashed(parts: str) -> str:
    return f"CAST('0x' || substr(sha256({parts}), 1, 8) AS BIGINT)"


def boot_sql(values: str, name: str, seed: int = 7) -> str:
    """CTEs to the means of resampled `values` (rid, v): {name}_m (b, mean)."""
    bounds = R.poisson_bounds()
    count = "CASE " + " ".join(f"WHEN s < '{x}' THEN {k}" for k, x in enumerate(bounds)) + f" ELSE {len(bounds)} END"
    return f""", {name}_h AS (SELECT v, g, sha256(rid || ':' || g || ':{seed}') AS h FROM {values}, range(0, {-(-TIMES // R.DRAWS)}) AS r(g)),
{name}_d AS (SELECT g * {R.DRAWS} + j AS b, v, substr(h, CAST(8 * j + 1 AS INT), 8) AS s FROM {name}_h, range(0, {R.DRAWS}) AS e(j)),
{name}_m AS (SELECT b, round(sum(c * v) / nullif(sum(c), 0), 9) AS mean FROM (SELECT b, v, {count} AS c FROM {name}_d) WHERE b < {TIMES} GROUP BY b)
"""


def ci_sql(name: str) -> str:
    low, high = int(TIMES * 0.025), min(TIMES - 1, int(TIMES * 0.975))
    return f"round((SELECT list_sort(list(mean))[{low + 1}] FROM {name}_m), 6) AS low, round((SELECT list_sort(list(mean))[{high + 1}] FROM {name}_m), 6) AS high"


COPY_SQL = f", vals AS (SELECT rid, {jac('items', 'prev_items')} AS v FROM linked WHERE has_items AND followup)"


@query(with_visits(COPY_SQL + boot_sql("vals", "x") + f"SELECT count(*) AS n, round(avg(v), 6) AS mean, {ci_sql('x')} FROM vals"))
def bootstrap_ci(spark, sf_dir):
    rows = link_history(visits(spark, sf_dir)).where(F.col("has_items") & is_followup())
    return R.bootstrap_ci(rows.select("rid", jaccard(F.col("items"), F.col("prev_items")).alias("v")), "rid", "v", TIMES)


TWO_SQL = prior_sql([PATTERN], name="pa") + prior_sql([PAIRS], name="pb") + f", two AS (SELECT pa.rid, pa.followup, pa.flags, {jac('pa.pred', 'pa.items')} - {jac('pb.pred', 'pb.items')} AS v FROM pa JOIN pb USING (rid))"


def two_runs(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    a = K.predict(test, train, [K.key_field("pattern")], TOP).select("rid", "flags", is_followup().alias("followup"), jaccard(F.col("pred"), F.col("items")).alias("a"))
    b = K.predict(test, train, [K.key_pairs()], TOP).select("rid", jaccard(F.col("pred"), F.col("items")).alias("b"))
    return a.join(b, "rid")


@query(with_visits(TWO_SQL + boot_sql("two", "x") + f"SELECT count(*) AS n, round(avg(v), 6) AS mean, {ci_sql('x')}, round((SELECT avg((mean <= 0)::INT) FROM x_m), 6) AS p FROM two"))
def paired_bootstrap(spark, sf_dir):
    return R.paired_bootstrap(two_runs(spark, sf_dir), "rid", "a", "b", TIMES)


STRATA = ("first", "followup", "usual_length")


@query(with_visits(TWO_SQL + "".join(f", two_{s} AS (SELECT * FROM two WHERE {SUBSETS[s]})" + boot_sql(f"two_{s}", s) for s in STRATA) + " UNION ALL ".join(f"SELECT '{s}' AS subset, count(*) AS n, round(avg(v), 6) AS mean, {ci_sql(s)}, round((SELECT avg((mean <= 0)::INT) FROM {s}_m), 6) AS p FROM two_{s}" for s in STRATA)))
def paired_bootstrap_subset(spark, sf_dir):
    rows = held(two_runs(spark, sf_dir))
    masks = {"first": ~F.col("followup"), "followup": F.col("followup"), "usual_length": ~F.array_contains("flags", "length_outlier")}
    out = None
    for name in STRATA:
        one = R.paired_bootstrap(rows.where(masks[name]), "rid", "a", "b", TIMES).select(F.lit(name).alias("subset"), "*")
        out = one if out is None else out.unionByName(one)
    return out


PERMS, PERM_TOP, PERM_GOAL, PERM_TOKEN = 200, 15, "AF", "s3"
TOKENS = "list_filter(list_transform(list_filter(string_split(text_long, '，'), lambda p: p <> ''), lambda p: CASE WHEN regexp_matches(p, '^(无|未|不)') THEN '无' || substr(p, 2) ELSE p END), lambda p: TRUE)"


@query(with_visits(f""", base AS (SELECT rid, items, list_contains({TOKENS}, '{PERM_TOKEN}') AS m FROM gold WHERE list_contains({field('labels', 'goal')}, '{PERM_GOAL}')), nm AS (SELECT count(*) FILTER (m) AS n FROM base),
perm AS (SELECT b, items, row_number() OVER (PARTITION BY b ORDER BY sha256(rid || ':' || b || ':perm'), rid || ':' || b) <= (SELECT n FROM nm) AS m FROM base, range(0, {PERMS}) AS bs(b)),
every AS (SELECT -1 AS b, items, m FROM base UNION ALL SELECT b, items, m FROM perm), cnt AS (SELECT b, m, item, count(*) AS n FROM (SELECT b, m, unnest(items) AS item FROM every) GROUP BY ALL),
tops AS (SELECT b, m, list(item ORDER BY n DESC, item) AS top FROM (SELECT *, row_number() OVER (PARTITION BY b, m ORDER BY n DESC, item) AS r FROM cnt) WHERE r <= {PERM_TOP} GROUP BY b, m),
js AS (SELECT x.b, round({jac('x.top', 'y.top')}, 9) AS j FROM tops x JOIN tops y ON x.b = y.b AND x.m AND NOT y.m), o AS (SELECT j AS observed FROM js WHERE b = -1)
SELECT round(observed, 6) AS observed, (SELECT n FROM nm) AS marked, round(avg(j), 6) AS expected, round(avg((j <= observed)::INT), 6) AS p, round((count(*) FILTER (j <= observed) + 1) / (count(*) + 1), 6) AS p_corrected FROM js, o WHERE b >= 0 GROUP BY observed"""))
def permutation_style(spark, sf_dir):
    rows = gold(spark, sf_dir).where(F.array_contains(field_set(F.col("labels"), "goal"), PERM_GOAL))
    return R.style_effect(rows.withColumn("t", clauses(F.col("text_long"))), F.array_contains("t", PERM_TOKEN), PERM_TOP, PERMS)


VOCAB_SQL = f", toks AS (SELECT rid, pid, date, unnest({TOKENS}) AS token FROM gold), vocab AS (SELECT token, count(*) AS n FROM toks WHERE token NOT IN ('可', '无') GROUP BY token HAVING count(*) >= 150), vt AS (SELECT DISTINCT rid, pid, date, token FROM toks JOIN vocab USING (token))"


@query(with_visits(VOCAB_SQL + "SELECT token, n FROM vocab"))
def token_vocab(spark, sf_dir):
    return mining.token_vocab(gold(spark, sf_dir), 150)


LEAST = {"min_rows": 500, "min_token": 200, "min_visits": 25, "min_entities": 20, "min_lift": 1.0, "min_share": 0.1, "n": 14}


@query(with_visits(VOCAB_SQL + f""", gs AS (SELECT rid, pid, date, items, unnest({field('labels', 'goal')}) AS stratum FROM gold), sn AS (SELECT stratum, count(*) AS total FROM gs GROUP BY stratum HAVING count(*) >= 500),
it AS (SELECT stratum, rid, pid, date, unnest(items) AS item FROM gs), im AS (SELECT stratum, item, strftime(date, '%Y-%m') AS mo, count(*) AS n FROM it GROUP BY ALL),
pi AS (SELECT stratum, item, sum(n) AS n_item, round(max(n) / sum(n), 6) AS concentration FROM im GROUP BY ALL), st AS (SELECT stratum, gs.rid, gs.pid, token FROM gs JOIN vt USING (rid)),
pt AS (SELECT stratum, token, count(*) AS n_token FROM st GROUP BY ALL HAVING count(*) >= 200),
b AS (SELECT stratum, token, item, count(*) AS visits, count(DISTINCT st.pid) AS entities FROM st JOIN it USING (stratum, rid) GROUP BY ALL HAVING count(*) >= 25),
s AS (SELECT *, visits / n_token AS share, (visits / n_token) / (n_item / total) AS lift, visits / entities > 5 OR concentration > 0.5 AS suspicious FROM b JOIN pt USING (stratum, token) JOIN pi USING (stratum, item) JOIN sn USING (stratum)),
f AS (SELECT *, row_number() OVER (PARTITION BY stratum, item ORDER BY suspicious, round(-entities / visits, 9), round(-lift, 9), token) AS r FROM s WHERE entities >= 20 AND round(lift, 9) >= 1.0 AND share >= 0.1),
t AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY suspicious, round(-entities / visits, 9), round(-lift, 9), item) AS z FROM f WHERE r = 1)
SELECT stratum, token, item, visits, entities, round(share, 6) AS share, round(lift, 6) AS lift, concentration, suspicious FROM t WHERE z <= 14"""))
def assoc_rules(spark, sf_dir):
    g = held(gold(spark, sf_dir))
    rows = g.withColumn("strata", field_set(F.col("labels"), "goal"))
    return mining.associations(rows, mining.with_tokens(g, mining.token_vocab(g, 150)), **LEAST)


@query(with_visits("""SELECT item, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS concentration FROM (SELECT item, strftime(date, '%Y-%m') AS mo, count(*) AS n FROM (SELECT date, unnest(items) AS item FROM gold) GROUP BY ALL) GROUP BY item"""))
def time_concentration(spark, sf_dir):
    return mining.time_concentration(gold(spark, sf_dir).select("date", F.explode("items").alias("item")), "item")


@query(with_visits(VOCAB_SQL + """, m AS (SELECT token, strftime(date, '%Y-%m') AS mo, count(*) AS n FROM vt GROUP BY ALL), t AS (SELECT token, sum(n) AS total, sum(n * ln(n)) AS s FROM m GROUP BY token)
SELECT token, CAST(total AS BIGINT) AS n, round((ln(total) - s / total) / ln((SELECT count(DISTINCT strftime(date, '%Y-%m')) FROM gold)), 6) AS entropy FROM t ORDER BY 3, 1 LIMIT 25"""))
def token_entropy(spark, sf_dir):
    g = gold(spark, sf_dir)
    months = g.select(F.countDistinct(mining.month()).alias("n")).first().n
    return mining.time_entropy(mining.with_tokens(g, mining.token_vocab(g, 150)), "token", months, 25)


@query(with_visits(f""", p AS (SELECT item, {field('labels', 'goal')} AS goals FROM (SELECT *, unnest(items) AS item FROM train)), n AS (SELECT item, count(*) AS n FROM p GROUP BY item),
pg AS (SELECT item, goal, c / n AS p FROM (SELECT item, goal, count(*) AS c FROM (SELECT item, unnest(goals) AS goal FROM p) GROUP BY ALL) JOIN n USING (item)),
s AS (SELECT rid, goal, round(sum(p), 9) AS s FROM (SELECT rid, unnest(items) AS item FROM test) JOIN pg USING (item) GROUP BY ALL),
g AS (SELECT rid, list(goal) AS guess FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY s DESC, goal) AS r FROM s) WHERE r <= 3 GROUP BY rid),
x AS (SELECT coalesce(guess, []) AS guess, {field('labels', 'goal')} AS goals FROM test LEFT JOIN g USING (rid)), w AS (SELECT count(*) AS n, sum(len(list_intersect(guess, goals))) AS tp, sum(len(guess)) AS a, sum(len(goals)) AS b FROM x)
SELECT n, round({ratio('tp', 'a')}, 6) AS "precision", round({ratio('tp', 'b')}, 6) AS recall, round({ratio('2 * tp', 'a + b')}, 6) AS f1 FROM w"""))
def goal_vote(spark, sf_dir):
    return mining.goal_vote(*sides(spark, sf_dir))


@query("""WITH s AS (SELECT lang, round(len(regexp_extract_all(text, '[A-Z]')) / greatest(length(text), 1), 9) AS score, 1 - quality AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, score, count(*) AS n, sum(y) AS n1 FROM s GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY score ROWS UNBOUNDED PRECEDING) - (n - 1) / 2 AS rank FROM c), t AS (SELECT lang, sum(n) AS n, sum(n1) AS n1, sum(rank * n1) AS r FROM r GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n, CAST(n1 AS BIGINT) AS positives, round((r - n1 * (n1 + 1) / 2) / nullif(n1 * (n - n1), 0), 6) AS auc FROM t""")
def label_auc(spark, sf_dir):
    """AUC of the share of capitals as a sign of low quality, with ties averaged."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    score = F.round(F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.length("text"), F.lit(1)), 9)
    return bayes.auc(d.select("lang", score.alias("score"), (1 - F.col("quality")).alias("y")), ["lang"])


def nb_sql(features: str) -> str:
    """CTEs from `features` (level, rid, feature) to nb (level, item, n, positives, auc)."""
    return f""", base AS (SELECT rid, items, CAST((row_number() OVER (ORDER BY sha256(rid || ':42'), rid) - 1) % 5 AS INT) AS fold FROM gold), feats AS (SELECT DISTINCT level, rid, feature FROM {features}),
flat AS (SELECT rid, fold, unnest(items) AS item FROM base), nall AS (SELECT count(*) AS n FROM base), nfold AS (SELECT fold, (SELECT n FROM nall) - count(*) AS n_train FROM base GROUP BY fold),
pos AS (SELECT item, count(*) AS positives FROM flat GROUP BY item HAVING count(*) >= 50 AND (SELECT n FROM nall) - count(*) >= 50),
models AS (SELECT pos.item, nfold.fold, positives - coalesce(pf, 0) AS n1, n_train - (positives - coalesce(pf, 0)) AS n0 FROM pos CROSS JOIN nfold LEFT JOIN (SELECT item, fold, count(*) AS pf FROM flat GROUP BY ALL) q ON q.item = pos.item AND q.fold = nfold.fold),
seen AS (SELECT level, rid, feature, fold FROM feats JOIN base USING (rid)), ff AS (SELECT level, feature, fold, count(*) AS cf FROM seen GROUP BY ALL), fa AS (SELECT level, feature, sum(cf) AS ca FROM ff GROUP BY ALL),
gf AS (SELECT level, feature, item, seen.fold, count(*) AS cf1 FROM seen JOIN flat USING (rid) GROUP BY ALL), ga AS (SELECT level, feature, item, sum(cf1) AS ca1 FROM gf GROUP BY ALL),
cell AS (SELECT fa.level, fa.feature, m.item, m.fold, m.n1, m.n0, coalesce(ca1, 0) - coalesce(cf1, 0) AS c1, ca - coalesce(cf, 0) - (coalesce(ca1, 0) - coalesce(cf1, 0)) AS c0 FROM fa CROSS JOIN models m
 LEFT JOIN ff ON ff.level = fa.level AND ff.feature = fa.feature AND ff.fold = m.fold LEFT JOIN ga ON ga.level = fa.level AND ga.feature = fa.feature AND ga.item = m.item LEFT JOIN gf ON gf.level = fa.level AND gf.feature = fa.feature AND gf.item = m.item AND gf.fold = m.fold),
lr AS (SELECT level, feature, item, fold, n1, n0, ln((1 - (c1 + 1) / (n1 + 2)) / (1 - (c0 + 1) / (n0 + 2))) AS absent, ln(((c1 + 1) / (n1 + 2)) / ((c0 + 1) / (n0 + 2))) AS here FROM cell),
cons AS (SELECT level, item, fold, ln(any_value(n1) / any_value(n0)) + sum(absent) AS c FROM lr GROUP BY ALL),
pres AS (SELECT seen.level, rid, item, sum(here - absent) AS s FROM seen JOIN lr ON lr.level = seen.level AND lr.feature = seen.feature AND lr.fold = seen.fold GROUP BY ALL),
sc AS (SELECT cons.level, cons.item, round(c + coalesce(s, 0), 9) AS score, list_contains(items, cons.item)::INT AS y FROM base JOIN cons USING (fold) LEFT JOIN pres ON pres.level = cons.level AND pres.rid = base.rid AND pres.item = cons.item),
sn AS (SELECT level, item, score, count(*) AS n, sum(y) AS n1 FROM sc GROUP BY ALL), sr AS (SELECT *, sum(n) OVER (PARTITION BY level, item ORDER BY score ROWS UNBOUNDED PRECEDING) - (n - 1) / 2 AS rank FROM sn),
st AS (SELECT level, item, sum(n) AS n, sum(n1) AS n1, sum(rank * n1) AS r FROM sr GROUP BY ALL),
nb AS (SELECT level, item, CAST(n AS BIGINT) AS n, CAST(n1 AS BIGINT) AS positives, round((r - n1 * (n1 + 1) / 2) / nullif(n1 * (n - n1), 0), 6) AS auc FROM st)
"""


FAMILIES = {
    "sex": ("unnest([sex])", lambda: F.array("sex")), "age": ("unnest([CAST(age // 10 AS VARCHAR)])", lambda: F.array(F.expr("age div 10").cast("string"))),
    "codes": ("unnest(codes)", lambda: F.col("codes")), "tokens": (f"unnest({TOKENS})", None), "goal": (f"unnest({field('labels', 'goal')})", lambda: F.col("goal")),
    "before": ("unnest(coalesce(prev_items, []))", lambda: F.coalesce("prev_items", F.array().cast("array<string>"))),
}


def family_sql(names) -> str:
    return ", feat AS (" + " UNION ALL ".join(f"SELECT {level} AS level, rid, '{name}=' || feature AS feature FROM (SELECT rid, {FAMILIES[name][0]} AS feature FROM gold)" for level in range(len(names)) for name in names[: level + 1]) + ")"


def family_table(spark, sf_dir, names):
    """rid, items and a column of features for each family of the gold visits, stored; only what these take is linked.

    Visits are stored before they are linked too, so that the shuffles of both don't take disk at the same time.
    """
    v = visits(spark, sf_dir).withColumn("goal", field_set(F.col("labels"), "goal")).withColumn("gold", is_gold())
    rows = link_history(stored(v.select("rid", "pid", "date", "sex", "age", "codes", "text_long", "goal", "items", "has_items", "gold"))).where("gold")
    values = {name: clauses(F.col("text_long")) if name == "tokens" else FAMILIES[name][1]() for name in names}
    return stored(rows.select("rid", "items", *[c.alias(f"of_{name}") for name, c in values.items()]))


def family_auc(spark, sf_dir, names):
    return bayes.naive_bayes_auc(family_table(spark, sf_dir, names), [f"of_{name}" for name in names])


@query(with_visits(f", feat AS (SELECT 0 AS level, rid, 'tokens=' || feature AS feature FROM (SELECT rid, unnest({TOKENS}) AS feature FROM gold))" + nb_sql("feat") + "SELECT level, item, n, positives, auc FROM nb"))
def nb_auc(spark, sf_dir):
    return family_auc(spark, sf_dir, ["tokens"])


def _levels(names):
    return with_visits(family_sql(names) + nb_sql("feat") + ", mean AS (SELECT level, count(*) AS items, round(avg(auc), 6) AS macro_auc FROM nb WHERE auc IS NOT NULL GROUP BY level) SELECT *, round(macro_auc - lag(macro_auc) OVER (ORDER BY level), 6) AS gain FROM mean")


@query(_levels(["codes", "tokens"]))
def info_gain(spark, sf_dir):
    """What the tokens of the text add to the codes."""
    return bayes.macro_by_level(family_auc(spark, sf_dir, ["codes", "tokens"]))


@query(_levels(list(FAMILIES)))
def ablation_levels(spark, sf_dir):
    """Six levels, each with one more family of features."""
    return bayes.macro_by_level(family_auc(spark, sf_dir, list(FAMILIES)))


N_PAIRS = 200_000


@query(with_visits(f""", num AS (SELECT row_number() OVER (ORDER BY sha256(rid || ':42'), rid) - 1 AS ix, items, {PATTERN} AS patterns, {field('labels', 'disease')} AS diseases FROM gold), nn AS (SELECT count(*) AS n FROM gold),
pairs AS (SELECT {hashed("i || ':a:3'")} % n AS a, {hashed("i || ':b:3'")} % n AS b FROM range(0, {N_PAIRS}) AS r(i), nn),
j AS (SELECT {jac('x.items', 'y.items')} AS j, list_has_any(x.patterns, y.patterns) AS same, list_has_any(x.diseases, y.diseases) AS dis FROM pairs JOIN num x ON x.ix = a JOIN num y ON y.ix = b WHERE a <> b),
k AS (SELECT j, 'all' AS kind FROM j UNION ALL SELECT j, CASE WHEN same THEN 'same' ELSE 'different' END FROM j UNION ALL SELECT j, 'same_both' FROM j WHERE same AND dis)
SELECT kind, count(*) AS n, round(avg(j), 6) AS jaccard FROM k GROUP BY kind"""))
def pair_similarity(spark, sf_dir):
    return retrieval.pair_similarity(gold(spark, sf_dir), N_PAIRS)


#: Candidates kept, pool size below which it is widened, and at how many queries the SQL stops (the code asks with all).
CAP, ENOUGH, KS, SAMPLE = 400, 50, (1, 5, 10, 20), 800


@query(with_visits(f""", prof AS (SELECT rid, split, items, list_distinct({TOKENS}) AS tokens, {PATTERN} AS patterns, {field('labels', 'disease')} AS diseases FROM split), q AS (SELECT rid AS q, items AS qi, tokens AS qt, patterns, diseases FROM prof WHERE split = 'test' ORDER BY sha256(rid || ':q'), rid LIMIT {SAMPLE}),
pool AS (SELECT * FROM prof WHERE split = 'train'), p1 AS (SELECT DISTINCT q, rid FROM (SELECT q, unnest(patterns) AS k FROM q) JOIN (SELECT rid, unnest(patterns) AS k FROM pool) USING (k)),
few AS (SELECT q FROM q LEFT JOIN (SELECT q, count(*) AS n FROM p1 GROUP BY q) USING (q) WHERE coalesce(n, 0) < {ENOUGH}),
p2 AS (SELECT DISTINCT q, rid FROM (SELECT q, unnest(diseases) AS k FROM q WHERE q IN (SELECT q FROM few)) JOIN (SELECT rid, unnest(diseases) AS k FROM pool) USING (k)), pairs AS (SELECT * FROM p1 UNION SELECT * FROM p2),
s AS (SELECT pairs.q, pairs.rid, round({jac('tokens', 'qt')}, 9) AS sim, round({jac('items', 'qi')}, 9) AS j, len(qi) - len(list_intersect(qi, items)) AS adds, len(items) - len(list_intersect(qi, items)) AS deletes FROM pairs JOIN pool USING (rid) JOIN q USING (q)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, rid) AS rank FROM s),
b AS (SELECT * FROM (SELECT k, q, j, adds, deletes, row_number() OVER (PARTITION BY k, q ORDER BY j DESC, rank) AS z FROM r JOIN (SELECT unnest([1, 5, 10, 20]) AS k) ON rank <= k) WHERE z = 1)
SELECT k, count(*) AS queries, round(list_sort(list(j))[CAST(count(*) // 2 AS INT) + 1], 6) AS median, round(avg(j), 6) AS mean, round(avg((j >= 0.5)::INT), 6) AS half, round(avg((j >= 0.7)::INT), 6) AS most, round(avg(adds), 6) AS adds, round(avg(deletes), 6) AS deletes FROM b GROUP BY k"""))
def retrieval_ceiling(spark, sf_dir):
    """All test visits ask. Only what is compared is stored and split; history isn't needed for that. No candidate behind the last of KS is looked at."""
    rows = stored(splits.by_entity(stored(retrieval.profile(visits(spark, sf_dir).where(is_gold()), "pid"))))
    return retrieval.ceiling(retrieval.nearest(rows.where("split = 'test'"), rows.where("split = 'train'"), min(CAP, max(KS)), ENOUGH), KS)

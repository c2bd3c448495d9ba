"""Queries on the knowledge base and the rule checker."""

from pyspark.sql import functions as F

from tidemark.functions.sets import field_set, r6
from tidemark.operators import checks, knowledge, mining
from tidemark.operators import rules as V
from tidemark.operators.broadcasts import held
from tidemark.plans.catalog import distinct, field, query, with_visits
from tidemark.plans.pools import gold
from tidemark.sources.visits import dosed_items, item_dictionary, table

RULES = V.Rules(
    vocabulary=[f"Brand#{i}" for i in range(1, 25)], pairs=[("Brand#2", "Brand#1"), ("Brand#3", "Brand#4"), ("Brand#10", "Brand#11")], downgraded={("Brand#3", "Brand#4"): "warn"},
    forbidden=["Brand#5", "Brand#6"], caution=["Brand#7"], caps={"Brand#8": 30.0, "Brand#9": 45.0}, over=2.5, toxic=["Brand#12", "Brand#13"], opposing={"AF": "PROMO|SMALL", "NO": "LARGE", "RO": "STANDARD|MEDIUM"},
)
GOALS = ["AF", "AO", "NF", "NO", "RF", "RO"]
GOAL_MAP = {"AF": ["STANDARD", "ECONOMY"], "AO": ["MEDIUM"], "NF": ["LARGE", "PROMO"], "NO": ["SMALL"], "RF": ["ECONOMY", "SMALL", "LARGE"], "RO": ["PROMO"]}


def inputs(spark, sf_dir):
    """rid, items with doses, goals and restricted of the gold visits."""
    doses = dosed_items(spark, sf_dir).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("item", "dose"))).alias("items"))
    g = gold(spark, sf_dir).select("rid", field_set(F.col("labels"), "goal").alias("goals"), (F.col("sex") == "F").alias("restricted"))
    return held(g.join(doses, "rid").select("rid", "items", "goals", "restricted"))


def goal_map(spark):
    return spark.createDataFrame(sorted(GOAL_MAP.items()), "goal string, wanted array<string>")


def q(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


GOLD_INPUT = f""", doses AS (SELECT l_orderkey AS rid, p_brand AS item, max(l_quantity) AS dose FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 10 GROUP BY ALL),
inp AS (SELECT rid, items, {field('labels', 'goal')} AS goals, sex = 'F' AS restricted FROM gold),
"""
CHECKS_SQL = f"""gmap AS (SELECT * FROM (VALUES {', '.join(f"('{g}', {q(w)})" for g, w in sorted(GOAL_MAP.items()))}) t(goal, wanted)),
f_illegal AS (SELECT rid, 'block' AS level, 'ILLEGAL_ITEM' AS code, array_to_string(list_sort(bad), ',') AS detail FROM (SELECT rid, list_filter(items, lambda x: NOT list_contains({q(RULES.vocabulary)}, x)) AS bad FROM inp) WHERE len(bad) > 0),
prs AS (SELECT * FROM (VALUES {', '.join(f"('{min(p)}', '{max(p)}', '{RULES.downgraded.get(tuple(sorted(p)), 'block')}')" for p in RULES.pairs)}) t(a, b, level)),
f_pair AS (SELECT rid, level, 'INCOMPATIBLE' AS code, a || '+' || b AS detail FROM inp JOIN prs ON list_contains(items, a) AND list_contains(items, b)),
f_restricted AS (SELECT rid, 'block' AS level, 'RESTRICTED_FORBIDDEN' AS code, array_to_string(list_sort(list_intersect(items, {q(RULES.forbidden)})), ',') AS detail FROM inp WHERE restricted AND list_has_any(items, {q(RULES.forbidden)})
 UNION ALL SELECT rid, 'warn', 'RESTRICTED_CAUTION', array_to_string(list_sort(list_intersect(items, {q(RULES.caution)})), ',') FROM inp WHERE restricted AND list_has_any(items, {q(RULES.caution)})),
f_dose AS (SELECT rid, CASE WHEN code = 'DOSE_CAP' THEN 'block' ELSE 'warn' END AS level, code, item AS detail FROM (SELECT rid, doses.item, CASE WHEN dose > cap THEN 'DOSE_CAP' WHEN dose > dose_max * {RULES.over} THEN 'DOSE_EXCEEDED' END AS code
 FROM doses JOIN inp USING (rid) LEFT JOIN dictionary USING (item) LEFT JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in RULES.caps.items())}) c(item, cap) ON c.item = doses.item) WHERE code IS NOT NULL),
has AS (SELECT rid, list_sort(list(DISTINCT capability)) AS capabilities FROM (SELECT rid, unnest(capabilities) AS capability FROM (SELECT rid, unnest(items) AS item FROM inp) JOIN dictionary USING (item)) GROUP BY rid),
gl AS (SELECT rid, goal, capabilities, coalesce(list_has_any(capabilities, wanted), FALSE) AS met FROM (SELECT rid, unnest(goals) AS goal FROM inp) JOIN has USING (rid) LEFT JOIN gmap USING (goal)),
cov AS (SELECT rid, count(*) AS n, count(*) FILTER (met) AS m, count(*) FILTER (met) / count(*) AS share, coalesce(array_to_string(list_sort(list(goal) FILTER (NOT met)), ','), '') AS missing FROM gl GROUP BY rid),
f_cov AS (SELECT rid, CASE WHEN share < {RULES.warn_below} THEN 'warn' ELSE 'note' END AS level, CASE WHEN share = 0 THEN 'COVERAGE_ZERO' WHEN share < {RULES.warn_below} THEN 'COVERAGE_LOW' ELSE 'COVERAGE_PARTIAL' END AS code, missing AS detail FROM cov WHERE share < {RULES.note_below}),
f_contra AS (SELECT rid, 'warn' AS level, 'CONTRADICTION' AS code, goal || ':' || array_to_string(against, ',') AS detail FROM (SELECT rid, goal, list_filter(capabilities, lambda c: regexp_matches(c, pattern)) AS against FROM gl
 JOIN (VALUES {', '.join(f"('{g}', '{p}')" for g, p in RULES.opposing.items())}) o(goal, pattern) USING (goal) WHERE NOT met) WHERE len(against) > 0),
conf AS (SELECT rid, avg((coalesce(len(capabilities), 0) > 0)::INT) AS share, list_sort(list(DISTINCT item) FILTER (coalesce(len(capabilities), 0) = 0)) AS unknown FROM (SELECT rid, unnest(items) AS item FROM inp) LEFT JOIN dictionary USING (item) GROUP BY rid),
f_conf AS (SELECT rid, 'info' AS level, 'UNKNOWN_ITEM' AS code, array_to_string(unknown, ',') AS detail FROM conf WHERE len(unknown) > 0 UNION ALL SELECT rid, 'note', 'LOW_CONFIDENCE', CAST(CAST(share AS DECIMAL(6,4)) AS VARCHAR) FROM conf WHERE share < {RULES.low_confidence}),
found AS (SELECT * FROM f_illegal UNION ALL SELECT * FROM f_pair UNION ALL SELECT * FROM f_restricted UNION ALL SELECT * FROM f_dose UNION ALL SELECT * FROM f_cov UNION ALL SELECT * FROM f_contra UNION ALL SELECT * FROM f_conf),
lev AS (SELECT *, list_position(['info', 'ok', 'note', 'warn', 'block'], level) AS rank FROM found),
verdict AS (SELECT inp.rid, ['info', 'ok', 'note', 'warn', 'block'][greatest(coalesce(max(rank), 2), 2)] AS verdict, count(rank) AS n_findings, coalesce(string_agg(code, ',' ORDER BY -rank, code, detail), '') AS codes FROM inp LEFT JOIN lev USING (rid) GROUP BY inp.rid)
"""

INPUT_SQL = GOLD_INPUT + CHECKS_SQL


def _check(name, source, run):
    def f(spark, sf_dir):
        return run(inputs(spark, sf_dir), item_dictionary(spark, sf_dir), goal_map(spark))

    f.__name__ = name
    query(with_visits(INPUT_SQL + f"SELECT * FROM {source}"))(f)


_check("rule_illegal", "f_illegal", lambda r, d, m: V.illegal(r, RULES))
_check("rule_incompat", "f_pair", lambda r, d, m: V.incompatible(r, RULES))
_check("rule_restricted", "f_restricted", lambda r, d, m: V.restricted(r, RULES))
_check("rule_dose", "f_dose", lambda r, d, m: V.doses(r, RULES, d))
_check("rule_alerts", f"(SELECT rid, array_to_string(list_sort(list_intersect(items, {q(RULES.toxic)})), ',') AS alerts FROM inp WHERE list_has_any(items, {q(RULES.toxic)}))", lambda r, d, m: V.alerts(r, RULES))
_check("rule_coverage", "f_cov", lambda r, d, m: V.coverage(r, RULES, d, m))
_check("rule_contra", "f_contra", lambda r, d, m: V.contradiction(r, RULES, d, m))
_check("rule_confidence", "f_conf", lambda r, d, m: V.confidence(r, RULES, d))
_check("finding_texts", "(SELECT v.rid, verdict || ' (' || n_findings || ')' || coalesce(chr(10) || string_agg('- [' || level || '] ' || code || ': ' || detail, chr(10) ORDER BY -rank, code, detail), '') AS text FROM verdict v LEFT JOIN lev USING (rid) GROUP BY v.rid, verdict, n_findings)", lambda r, d, m: V.rendered(r, V.findings(r, RULES, d, m)))
_check("verdicts", "verdict", lambda r, d, m: V.verdicts(r, V.findings(r, RULES, d, m)))


@query(with_visits(INPUT_SQL + """, c AS (SELECT verdict, count(*) AS n, list_sort(list(n_findings)) AS s FROM verdict GROUP BY verdict)
SELECT verdict, n, s[CAST(n // 2 AS INT) + 1] AS median_findings, s[CAST(floor(n * 0.05) AS INT) + 1] AS p05_findings FROM c"""))
def verdict_distribution(spark, sf_dir):
    r = inputs(spark, sf_dir)
    v = V.verdicts(r, V.findings(r, RULES, item_dictionary(spark, sf_dir), goal_map(spark)))
    p = checks.pick_by_index(v, ["verdict"], "n_findings", {"median_findings": F.expr("c div 2"), "p05_findings": F.floor(F.col("c") * 0.05)})
    return p.select("verdict", F.col("c").alias("n"), "median_findings", "p05_findings")


def negative_sql() -> str:
    """The planted cases as the input of CHECKS_SQL, and the share of each kind that is found."""
    a, b = sorted(RULES.pairs[0])
    cap = sorted(RULES.caps)[0]
    names, goals, flag = "items", "goals", "restricted"
    kinds = [
        ("swapped_goal", names, f"list_slice(list_filter({q(GOALS)}, lambda g: NOT list_contains(goals, g)), 1, 1)", flag, ("COVERAGE_ZERO", "CONTRADICTION")),
        ("stripped", "list_filter(items, lambda x: NOT list_contains(strong, x))", goals, flag, ("LOW_CONFIDENCE", "COVERAGE_ZERO", "COVERAGE_LOW")),
        ("pair", f"list_concat(list_filter(items, lambda x: x NOT IN ('{a}', '{b}')), {q((a, b))})", goals, flag, ("INCOMPATIBLE",)),
        ("illegal", "list_concat(items, ['No such item'])", goals, flag, ("ILLEGAL_ITEM",)),
        ("restricted", f"list_concat(items, ['{RULES.forbidden[0]}'])", goals, "TRUE", ("RESTRICTED_FORBIDDEN",)),
        ("dose", f"list_concat(items, ['{cap}'])", goals, flag, ("DOSE_CAP",)),
    ]
    each = " UNION ALL ".join(f"SELECT rid * 10 + {k} AS rid, rid AS of_rid, {i} AS items, {g} AS goals, {r} AS restricted, '{n}' AS case_type, {q(c)} AS expected FROM inp0" for k, (n, i, g, r, c) in enumerate(kinds))
    base = GOLD_INPUT.replace("doses AS", "doses0 AS").replace("inp AS", "plain AS")
    return base + f"""inp0 AS (SELECT plain.*, (SELECT list(item) FROM dictionary WHERE len(capabilities) > 0) AS strong FROM plain), inp AS ({each}),
doses AS (SELECT inp.rid, item, dose FROM inp JOIN doses0 ON doses0.rid = of_rid WHERE list_contains(items, item) AND NOT (case_type = 'pair' AND item IN ('{a}', '{b}')) UNION ALL SELECT rid, '{cap}', {RULES.caps[cap] * 10} FROM inp WHERE case_type = 'dose'),
""" + CHECKS_SQL + """, got AS (SELECT rid, list(DISTINCT code) AS got FROM found GROUP BY rid)
SELECT case_type, count(*) AS n, round(avg(coalesce(list_has_any(got, expected), FALSE)::INT), 6) AS detected FROM inp LEFT JOIN got USING (rid) GROUP BY case_type"""


@query(with_visits(negative_sql()))
def negative_detection(spark, sf_dir):
    """Violations of six kinds planted in every visit, and how many the checks find."""
    d, m = item_dictionary(spark, sf_dir), goal_map(spark)
    cases = held(V.negatives(inputs(spark, sf_dir), RULES, d, GOALS))
    return V.detection(cases, V.findings(cases, RULES, d, m))


DOSE_SQL = f"CASE WHEN item IN {tuple(RULES.toxic)} THEN dose_min ELSE least(greatest(round_even((dose_min + dose_max) / 2, 0), dose_min), dose_max) END"


@query(with_visits(f""", e AS (SELECT rid, item, {DOSE_SQL} AS dose FROM (SELECT rid, unnest(items) AS item FROM gold) LEFT JOIN dictionary USING (item))
SELECT rid, count(*) AS n, count(dose) AS n_filled, round(coalesce(sum(dose), 0.0), 4) AS total, bool_or(item IN {tuple(RULES.toxic)}) AS any_toxic FROM e GROUP BY rid"""))
def dose_fill(spark, sf_dir):
    return V.fill_doses(gold(spark, sf_dir), item_dictionary(spark, sf_dir), RULES.toxic)


def repair_sql() -> str:
    out, last = f", r0 AS (SELECT rid, list_filter(items, lambda x: list_contains({q(RULES.vocabulary)}, x)) AS h FROM gold)", "r0"
    for i, (a, b) in enumerate(RULES.pairs, 1):
        later = f"CASE WHEN list_position(h, '{a}') > list_position(h, '{b}') THEN '{a}' ELSE '{b}' END"
        out += f", r{i} AS (SELECT rid, CASE WHEN list_contains(h, '{a}') AND list_contains(h, '{b}') THEN list_filter(h, lambda x: x <> {later}) ELSE h END AS h FROM {last})"
        last = f"r{i}"
    return out + f" SELECT rid, array_to_string(h, ' ') AS items FROM {last}"


@query(with_visits(repair_sql()))
def repair_pairs(spark, sf_dir):
    return gold(spark, sf_dir).select("rid", F.array_join(V.repair(F.col("items"), RULES), " ").alias("items"))


@query(with_visits(f"SELECT rid, len(list_filter(items, lambda x: NOT list_contains({q(RULES.vocabulary)}, x))) = 0 AS is_legal FROM gold"))
def vocab_grammar(spark, sf_dir):
    """Whether a list is in the language of the vocabulary, told by the generated pattern."""
    return gold(spark, sf_dir).select("rid", F.array_join("items", " ").rlike(V.grammar(RULES.vocabulary)).alias("is_legal"))


@query(with_visits(f"SELECT rid, len(items) BETWEEN 1 AND 6 AND len(list_distinct(items)) = len(items) AND len(list_filter(items, lambda x: NOT list_contains({q(RULES.vocabulary)}, x))) = 0 AS fits FROM gold"))
def schema_fit(spark, sf_dir):
    """Whether a list is what the schema of generated lists asks for."""
    return gold(spark, sf_dir).select("rid", V.fits_schema(F.col("items"), V.schema(RULES.vocabulary, 1, 6)).alias("fits"))


def rounds_sql(rounds: int = 3) -> str:
    pairs = "[" + ", ".join(f"{{'a': '{a}', 'b': '{b}'}}" for a, b in RULES.pairs if RULES.downgraded.get(tuple(sorted((a, b)))) is None) + "]"
    bans = f"list_transform(list_filter({pairs}, lambda p: list_contains(h, p.a) AND list_contains(h, p.b)), lambda p: CASE WHEN list_position(h, p.a) > list_position(h, p.b) THEN p.a ELSE p.b END)"
    out = f", g0 AS (SELECT rid, items AS h, 1 AS attempts FROM gold), b0 AS (SELECT *, {bans} AS bans FROM g0)"
    for k in range(rounds):
        out += f", g{k + 1} AS (SELECT rid, list_filter(h, lambda x: NOT list_contains(bans, x)) AS h, attempts + (len(bans) > 0)::INT AS attempts FROM b{k}), b{k + 1} AS (SELECT *, {bans} AS bans FROM g{k + 1})"
    return out + f" SELECT rid, array_to_string(h, ' ') AS items, CAST(attempts AS INT) AS attempts, len(bans) > 0 AS failed FROM b{rounds}"


@query(with_visits(rounds_sql()))
def repair_rounds(spark, sf_dir):
    """Lists that are checked, cut and checked again until no pair blocks."""
    out = gold(spark, sf_dir).select("rid", V.validated(F.col("items"), RULES).alias("v"))
    return out.select("rid", F.array_join("v.items", " ").alias("items"), "v.attempts", "v.failed")


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT * FROM (VALUES ('The ', 'and'), ('er ', NULL), ('no such phrase', 'x')) AS t(phrase, correct))
SELECT p.phrase, count(line) AS lines, count(line) FILTER (correct IS NULL OR NOT contains(line, correct)) AS stale FROM p LEFT JOIN l ON contains(line, p.phrase) GROUP BY p.phrase""")
def stale_phrases(spark, sf_dir):
    phrases = spark.createDataFrame([("The ", "and"), ("er ", None), ("no such phrase", "x")], "phrase string, correct string")
    return checks.stale_phrases(table(spark, sf_dir, "documents"), phrases)


# Names to resolve: part names with a process in front and a form behind.
PATTERNS = ["^(raw|aged) ", "^(east|west) ", " (slice|root)$"]
NAME = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'raw east ' || p_name || ' slice' WHEN 2 THEN 'aged ' || p_name WHEN 3 THEN 'odd ' || p_name || ' root' END"


def _expand_sql(rounds: int = 3) -> str:
    out = f", nm AS (SELECT DISTINCT {NAME} AS name FROM part), e0 AS (SELECT name, [name] AS c FROM nm)"
    for i in range(1, rounds + 1):
        new = "flatten(list_transform(c, lambda x: [" + ", ".join(f"regexp_replace(x, '{p}', '')" for p in PATTERNS) + "]))"
        out += f", e{i} AS (SELECT name, {distinct('l')} AS c FROM (SELECT name, list_concat(c, list_filter({new}, lambda x: x <> '')) AS l FROM e{i - 1}))"
    return out


KNOWN_SQL = ", known AS (SELECT DISTINCT p_name AS alias, p_name AS target, CASE WHEN p_size < 25 THEN 0 ELSE 2 END AS tier FROM part WHERE p_name NOT LIKE '%bolt' UNION SELECT DISTINCT 'odd ' || p_name, p_name, 3 FROM part WHERE p_name LIKE '%ring')"


def name_tables(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    name = F.when(k == 0, n).when(k == 1, F.concat(F.lit("raw east "), n, F.lit(" slice"))).when(k == 2, F.concat(F.lit("aged "), n)).otherwise(F.concat(F.lit("odd "), n, F.lit(" root")))
    known = p.where(~n.endswith("bolt")).select(n.alias("alias"), n.alias("target"), F.when(F.col("p_size") < 25, 0).otherwise(2).alias("tier"))
    odd = p.where(n.endswith("ring")).select(F.concat(F.lit("odd "), n).alias("alias"), n.alias("target"), F.lit(3).alias("tier"))
    return p.select(name.alias("name")).distinct(), known.unionByName(odd).distinct()


RESOLVED_SQL = _expand_sql() + KNOWN_SQL + """, hit AS (SELECT name, step - 1 AS step, target, tier, row_number() OVER (PARTITION BY name ORDER BY step, tier, target) AS r FROM (SELECT name, unnest(c) AS alias, generate_subscripts(c, 1) AS step FROM e3) JOIN known USING (alias)),
resolved AS (SELECT nm.name, target, tier, CAST(step AS INT) AS step FROM nm LEFT JOIN hit ON hit.name = nm.name AND r = 1)
"""


@query("WITH one AS (SELECT 1)" + RESOLVED_SQL + "SELECT * FROM resolved")
def resolve_names(spark, sf_dir):
    return knowledge.resolve(*name_tables(spark, sf_dir), PATTERNS)


@query("WITH one AS (SELECT 1)" + RESOLVED_SQL + """, x AS (SELECT name, target, count(*) AS freq FROM resolved JOIN (SELECT """ + NAME + """ AS name FROM part) USING (name) GROUP BY ALL)
SELECT 'resolved' AS field, count(*) FILTER (target IS NOT NULL) AS n, round(avg((target IS NOT NULL)::INT), 6) AS share, round(sum(freq) FILTER (target IS NOT NULL) / sum(freq), 6) AS weighted FROM x
UNION ALL SELECT 'unchanged', count(*) FILTER (coalesce(target = name, FALSE)), round(avg(coalesce(target = name, FALSE)::INT), 6), round(sum(freq) FILTER (target = name) / sum(freq), 6) FROM x""")
def weighted_coverage(spark, sf_dir):
    names, known = name_tables(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    raw = p.select(F.when(k == 0, n).when(k == 1, F.concat(F.lit("raw east "), n, F.lit(" slice"))).when(k == 2, F.concat(F.lit("aged "), n)).otherwise(F.concat(F.lit("odd "), n, F.lit(" root"))).alias("name"))
    rows = raw.groupBy("name").agg(F.count("*").alias("freq")).join(knowledge.resolve(names, known, PATTERNS), "name")
    return mining.weighted_coverage(rows, "freq", {"resolved": F.col("target").isNotNull(), "unchanged": F.coalesce(F.col("target") == F.col("name"), F.lit(False))})


LEGAL = {"small ring": "ring, small", "red widget": "red widget", "blue bolt": "bolt, blue", "red ring": "ring, red", "blue widget": "widget, blue"}
STRIP = ["^(raw|aged) ", "^(east|west) ", " (slice|root)$"]


def _strip_sql() -> str:
    lookup = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEGAL.items()) + " END"
    out, c = f", s AS (SELECT p_partkey, {NAME} AS n0 FROM part), s0 AS (SELECT *", "n0"
    tries = [lookup("n0")]
    for i in range(1, 4):
        for p in STRIP:
            c = f"regexp_replace({c}, '{p}', '')"
        out += f", {c} AS n{i}"
        tries.append(lookup(f"n{i}"))
    return "WITH one AS (SELECT 1)" + out + f" FROM s) SELECT p_partkey, coalesce({', '.join(tries)}, n0) AS item FROM s0"


@query(_strip_sql())
def strip_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    name = F.when(k == 0, n).when(k == 1, F.concat(F.lit("raw east "), n, F.lit(" slice"))).when(k == 2, F.concat(F.lit("aged "), n)).otherwise(F.concat(F.lit("odd "), n, F.lit(" root")))
    return p.select("p_partkey", knowledge.strip_name(name, STRIP, LEGAL).alias("item"))


UNITS = {"A": "ECONOMY|STANDARD", "N": "^(LARGE|SMALL)$", "R": "PROMO", "F": "M$|E$", "O": "MEDIUM"}


@query("WITH u AS (SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{p}')" for u, p in UNITS.items()) + ") t(unit, pattern)), c AS (SELECT DISTINCT p_type AS capability FROM part) SELECT unit, array_to_string(list_sort(list(capability)), ',') AS capabilities FROM u JOIN c ON regexp_matches(capability, pattern) GROUP BY unit")
def unit_capabilities(spark, sf_dir):
    u, c = unit_tables(spark, sf_dir)
    return knowledge.unit_capabilities(u, c).select("unit", F.array_join("capabilities", ",").alias("capabilities"))


def unit_tables(spark, sf_dir):
    return spark.createDataFrame(list(UNITS.items()), "unit string, pattern string"), table(spark, sf_dir, "part").select(F.col("p_type").alias("capability")).distinct()


UNIT_SQL = ", u AS (SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{p}')" for u, p in UNITS.items()) + ") t(unit, pattern)), uc AS (SELECT DISTINCT unit, p_type AS capability FROM u JOIN part ON regexp_matches(p_type, pattern)), gs AS (SELECT DISTINCT l.goal AS goal FROM (SELECT unnest(labels) AS l FROM gold)), rules AS (SELECT DISTINCT goal, capability FROM (SELECT goal, unnest(string_split(goal, '')) AS unit FROM gs) JOIN uc USING (unit))"


def goal_rules_of(spark, sf_dir):
    g = gold(spark, sf_dir)
    goals = g.select(F.explode(field_set(F.col("labels"), "goal")).alias("goal")).distinct()
    u, c = unit_tables(spark, sf_dir)
    return g, knowledge.goal_rules(goals, list(UNITS), knowledge.unit_capabilities(u, c))


@query(with_visits(UNIT_SQL + "SELECT goal, string_agg(capability, ',' ORDER BY capability) AS capabilities FROM rules GROUP BY goal"))
def goal_rules(spark, sf_dir):
    return goal_rules_of(spark, sf_dir)[1].select("goal", F.array_join("capabilities", ",").alias("capabilities"))


@query("""WITH g AS (SELECT DISTINCT p_name AS goal FROM part), t AS (SELECT string_agg(p_type, ',' ORDER BY p_type) AS t FROM (SELECT DISTINCT lower(p_type) AS p_type FROM part))
SELECT goal, len(list_filter(list_transform(range(1, length(goal)), lambda i: substr(goal, i, 2)), lambda b: contains((SELECT 'economy,large,medium,promo,small,standard'), b))) > 0 AS hit FROM g""".replace("(SELECT 'economy,large,medium,promo,small,standard')", "'economy,large,medium,promo,small,standard'"))
def bigram_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    types = p.agg(F.array_join(F.sort_array(F.collect_set(F.lower("p_type"))), ",").alias("types"))
    goals = p.select(F.col("p_name").alias("goal")).distinct().crossJoin(F.broadcast(types))
    return goals.select("goal", knowledge.bigram_hit(F.col("goal"), F.col("types")).alias("hit"))


@query(with_visits(INPUT_SQL + """SELECT goal, count(*) AS n, count(*) FILTER (met) AS met, round(avg(met::INT), 6) AS share FROM gl GROUP BY goal UNION ALL SELECT 'visits', count(*), count(*) FILTER (share = 1), round(avg(share), 6) FROM cov"""))
def goal_coverage(spark, sf_dir):
    """How many visits meet each goal, and of all visits how many meet all, with the mean share."""
    r = inputs(spark, sf_dir)
    has = knowledge.visit_capabilities(r.select("rid", V.names().alias("items")), item_dictionary(spark, sf_dir))
    each = knowledge.goal_coverage(r.select("rid", F.explode("goals").alias("goal")), has, goal_map(spark))
    by_goal = each.groupBy("goal").agg(F.count("*").alias("n"), F.count_if("covered").alias("met"), r6(F.avg(F.col("covered").cast("int"))).alias("share"))
    by_visit = each.groupBy("rid").agg(F.avg(F.col("covered").cast("int")).alias("s")).agg(F.lit("visits").alias("goal"), F.count("*").alias("n"), F.count_if(F.col("s") == 1).alias("met"), r6(F.avg("s")).alias("share"))
    return by_goal.unionByName(by_visit)


MINED_SQL = INPUT_SQL + """, base AS (SELECT capability, count(*) AS n_cap FROM (SELECT unnest(capabilities) AS capability FROM has) GROUP BY ALL), pg AS (SELECT goal, count(*) AS n_goal FROM gl GROUP BY goal HAVING count(*) >= 40),
bb AS (SELECT goal, capability, count(*) AS visits FROM (SELECT goal, unnest(capabilities) AS capability FROM gl) GROUP BY ALL),
ms AS (SELECT goal, capability, visits, visits / n_goal AS share, round((visits / n_goal) / (n_cap / (SELECT count(*) FROM has)), 9) AS lift FROM bb JOIN pg USING (goal) JOIN base USING (capability)),
mined AS (SELECT goal, capability, visits, round(share, 6) AS share, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY lift DESC, capability) AS r FROM ms WHERE share >= 0.2 AND lift >= 1.0) WHERE r <= 12)
"""


def mined(spark, sf_dir):
    r = inputs(spark, sf_dir)
    has = knowledge.visit_capabilities(r.select("rid", V.names().alias("items")), item_dictionary(spark, sf_dir))
    return knowledge.mined_capabilities(r.select("rid", F.explode("goals").alias("goal")), has, 40, 0.2, 1.0, 12)


@query(with_visits(MINED_SQL + "SELECT * FROM mined"))
def mined_capabilities(spark, sf_dir):
    return mined(spark, sf_dir)


@query(with_visits(MINED_SQL + UNIT_SQL + "SELECT goal, capability, 'rule' AS source FROM rules UNION ALL SELECT goal, capability, 'data' FROM mined WHERE lift >= 1.0 AND (goal, capability) NOT IN (SELECT (goal, capability) FROM rules)"))
def merged_goal_map(spark, sf_dir):
    return knowledge.merged_map(goal_rules_of(spark, sf_dir)[1], mined(spark, sf_dir), 1.0)


SOURCE_A, SOURCE_B = "p_size < 20", "p_size >= 15 AND p_name LIKE '%ring'"


@query("WITH one AS (SELECT 1)" + RESOLVED_SQL + f""", a AS (SELECT p_name AS target, min(p_type) AS category, CAST(min(p_size) AS DOUBLE) AS dose_min, CAST(max(p_size) AS DOUBLE) AS dose_max FROM part WHERE {SOURCE_A} AND p_name NOT LIKE 'red%' GROUP BY 1),
b AS (SELECT p_name AS target, max(p_type) AS category, CAST(min(p_size) AS DOUBLE) AS dose_min, CAST(max(p_size) AS DOUBLE) AS dose_max FROM part WHERE {SOURCE_B} GROUP BY 1)
SELECT r.name, r.target, CASE WHEN a.target IS NOT NULL AND b.target IS NOT NULL THEN 'both' WHEN a.target IS NOT NULL THEN 'first' WHEN b.target IS NOT NULL THEN 'second' ELSE 'unmapped' END AS source,
coalesce(a.category, b.category) AS category, coalesce(a.dose_min, b.dose_min) AS dose_min, coalesce(a.dose_max, b.dose_max) AS dose_max FROM resolved r LEFT JOIN a ON a.target = r.target LEFT JOIN b ON b.target = r.target""")
def merged_dictionary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    dose = [F.min("p_size").cast("double").alias("dose_min"), F.max("p_size").cast("double").alias("dose_max")]
    a = p.where(SOURCE_A).where("p_name not like 'red%'").groupBy(F.col("p_name").alias("target")).agg(F.min("p_type").alias("category"), *dose)
    b = p.where(SOURCE_B).groupBy(F.col("p_name").alias("target")).agg(F.max("p_type").alias("category"), *dose)
    return knowledge.merged_dictionary(knowledge.resolve(*name_tables(spark, sf_dir), PATTERNS).select("name", "target"), a, b)


@query("""WITH f AS (SELECT l_orderkey AS formula, list({'n': l_linenumber, 'k': l_partkey, 'r': l_returnflag} ORDER BY l_linenumber, l_partkey, l_returnflag) AS c FROM lineitem GROUP BY 1),
e AS (SELECT formula, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM f) SELECT formula, string_agg(p_name || '/' || x.r, ',' ORDER BY pos) AS composition FROM e JOIN part ON p_partkey = x.k GROUP BY formula""")
def formula_names(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    f = lines.groupBy(F.col("l_orderkey").alias("formula")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("role")))).alias("c"))
    f = f.select("formula", F.transform("c", lambda x: F.struct(x.key.cast("string").alias("key"), x.role.alias("role"))).alias("composition"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("name"))
    out = knowledge.named_composition(f, names)
    return out.select("formula", F.array_join(F.transform("composition", lambda x: F.concat_ws("/", x["name"], x["role"])), ",").alias("composition"))


@query("""SELECT count(*) AS formulas, count(*) FILTER (has_role) AS with_role, count(*) FILTER (all_role) AS all_roles FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS has_role, bool_and(l_returnflag <> 'N') AS all_role FROM lineitem GROUP BY 1)""")
def formula_roles(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("roles"))
    return f.agg(F.count("*").alias("formulas"), F.count_if(F.exists("roles", lambda r: r == "R")).alias("with_role"), F.count_if(F.forall("roles", lambda r: r != "N")).alias("all_roles"))


@query("""SELECT p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY p_type""")
def class_distribution(spark, sf_dir):
    return checks.class_share(table(spark, sf_dir, "part"), "p_type")


@query("""SELECT p_partkey AS name, CAST(p_size AS VARCHAR) || '0 units' AS literal, p_size % 5 = 0 AS stated FROM part""")
def number_consistency(spark, sf_dir):
    """Which literals the narrative texts hold; these texts state the multiples of five."""
    p = table(spark, sf_dir, "part")
    source = p.select(F.col("p_partkey").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit("0 units")).alias("literal"))
    told = p.where("p_size % 5 = 0").select(F.concat(F.lit("report\nit has "), F.col("p_size").cast("string"), F.lit("0 units.\n")).alias("text")).distinct()
    told = told.withColumn("text", F.regexp_replace("text", " has ", " has: "))
    return checks.numbers_stated(source, told)



"""Queries on parsing, normalising and rendering."""

from pyspark.sql import functions as F

from tidemark.functions import parsing as P
from tidemark.functions import rendering as R
from tidemark.operators import checks
from tidemark.operators.history import link_history
from tidemark.plans.catalog import distinct, query, with_visits
from tidemark.sources.visits import table, visits

E_MAIL, PLACEHOLDER = r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+", "[contact]"
UNITS = ["AF", "AO", "NF", "NO", "RF", "RO", "A", "N"]

#: The pattern of a dose suffix and of punctuation for RE2 (which has no possessive quantifiers).
DOSE, PUNCT = r"(?:\d+(?:\.\d+)?\s*(?:g|G|克|mg|ml|ML)?)+$", r"[\s.．。、,，;；:：\-—_/\\]+"
RAW_ITEMS = "' ' || p_type || CAST(p_size AS VARCHAR) || 'g1.000, ' || p_name || '. ,' || p_type || '12.5 mg,,' || p_brand"


def norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim({x}), '{DOSE}', ''), '{PUNCT}', '', 'g')"


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit(" "), "p_type", F.col("p_size").cast("string"), F.lit("g1.000, "), "p_name", F.lit(". ,"), "p_type", F.lit("12.5 mg,,"), "p_brand")
    return p.withColumn("raw", raw)


@query(f"""SELECT p_partkey, {norm("p_name || CAST(p_size AS VARCHAR) || 'g1.000'")} AS item, {norm("p_type || CAST(p_size AS VARCHAR) || 'g.'")} AS late,
regexp_matches({norm("p_type || CAST(p_size AS VARCHAR) || 'g.'")}, '[0-9]') AS late_is_dosed FROM part""")
def normalize_item(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    late = P.normalize_item(F.concat("p_type", size, F.lit("g.")))
    return p.select("p_partkey", P.normalize_item(F.concat("p_name", size, F.lit("g1.000"))).alias("item"), late.alias("late"), late.rlike("[0-9]").alias("late_is_dosed"))


@query(f"""WITH x AS (SELECT p_partkey, list_filter(list_transform(string_split({RAW_ITEMS}, ','), lambda h: {norm('h')}), lambda h: h <> '') AS h FROM part)
SELECT p_partkey, array_to_string({distinct('h')}, '|') AS items, len({distinct('h')}) AS n FROM x""")
def parse_items(spark, sf_dir):
    items = P.parse_items(F.col("raw"))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(items, "|").alias("items"), F.size(items).cast("long").alias("n"))


LABEL_RAW = "p_type || '/' || p_name || '/' || p_brand || ',' || p_type || ' / ' || p_name || '/' || p_brand || ',' || p_type || '/' || p_brand || ',' || p_type || '//' || p_name || ', ' || p_brand || '/' || p_type || '/x '"


@query(f"""WITH s AS (SELECT p_partkey, list_transform(string_split({LABEL_RAW}, ','), lambda s: list_transform(string_split(trim(s), '/'), lambda p: trim(p))) AS s FROM part),
k AS (SELECT p_partkey, list_transform(list_filter(s, lambda p: len(p) = 3 AND NOT list_contains(p, '')), lambda p: array_to_string(p, '/')) AS s FROM s)
SELECT p_partkey, array_to_string({distinct('s')}, ',') AS labels FROM k""")
def parse_labels(spark, sf_dir):
    t, n, b = F.col("p_type"), F.col("p_name"), F.col("p_brand")
    raw = F.concat(t, F.lit("/"), n, F.lit("/"), b, F.lit(","), t, F.lit(" / "), n, F.lit("/"), b, F.lit(","), t, F.lit("/"), b, F.lit(","), t, F.lit("//"), n, F.lit(", "), b, F.lit("/"), t, F.lit("/x "))
    out = F.transform(P.parse_labels(raw), lambda x: F.concat_ws("/", x.disease, x.pattern, x.goal))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(out, ",").alias("labels"))


@query(f"""WITH s AS (SELECT c_custkey, list_filter(list_transform(regexp_split_to_array(c_mktsegment || ', ' || c_name || '；' || c_mktsegment || ';;x', '[,，;；]'), lambda p: trim(p)), lambda p: p <> '') AS s FROM customer)
SELECT c_custkey, array_to_string({distinct('s')}, '|') AS codes FROM s""")
def parse_codes(spark, sf_dir):
    raw = F.concat("c_mktsegment", F.lit(", "), "c_name", F.lit("；"), "c_mktsegment", F.lit(";;x"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(P.parse_codes(raw), "|").alias("codes"))


@query("""SELECT p_partkey, TRY_CAST(regexp_extract(p_type || CASE WHEN p_size % 4 > 0 THEN p_size || '岁' ELSE '' END || p_name, '\\d+') AS INT) AS age FROM part""")
def parse_age(spark, sf_dir):
    raw = F.concat("p_type", F.when(F.col("p_size") % 4 > 0, F.concat(F.col("p_size").cast("string"), F.lit("岁"))).otherwise(""), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", P.parse_age(raw).alias("age"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS day FROM orders""")
def parse_date(spark, sf_dir):
    d = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.year(d).cast("string"), F.lit("-13-45"))).otherwise(F.concat(F.year(d).cast("string"), F.lit("-"), F.month(d).cast("string"), F.lit("/"), F.day(d).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.parse_date(raw).cast("string").alias("day"))


@query("""SELECT c_custkey, 'P' || substr(sha256('tidemark::' || c_custkey), 1, 12) AS pid FROM customer""")
def hash_entity(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", P.hash_entity(F.col("c_custkey")).alias("pid"))


@query(with_visits("""SELECT f AS flag, count(*) AS n, count(DISTINCT pid) AS entities FROM (SELECT pid, unnest(flags) AS f FROM visits) GROUP BY f"""))
def quality_flags(spark, sf_dir):
    return visits(spark, sf_dir).select("pid", F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("entities"))


@query("""WITH r AS (SELECT p_partkey, replace(p_name, ' ', '') || p_size || 'g, ' || p_type || ' ' || (p_size / 4.0) || ', ' || p_type AS t FROM part)
SELECT p_partkey, array_to_string(regexp_extract_all(t, '([一-鿿A-Za-z]+)\\s*(\\d+(?:\\.\\d+)?)?\\s*(?:g|G|克)?', 1), '|') AS items,
round(CAST(list_sum(list_transform(regexp_extract_all(t, '([一-鿿A-Za-z]+)\\s*(\\d+(?:\\.\\d+)?)?\\s*(?:g|G|克)?', 2), lambda d: TRY_CAST(d AS DOUBLE))) AS DOUBLE), 4) AS dose FROM r""")
def parse_dosed_list(spark, sf_dir):
    raw = F.concat(F.translate("p_name", " ", ""), F.col("p_size").cast("string"), F.lit("g, "), "p_type", F.lit(" "), (F.col("p_size") / 4).cast("string"), F.lit(", "), "p_type")
    out = P.parse_dosed(raw)
    doses = F.aggregate(F.filter(F.transform(out, lambda x: x.dose), lambda d: d.isNotNull()), F.lit(0.0), lambda a, d: a + d)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(out, lambda x: x["item"]), "|").alias("items"), F.round(doses, 4).alias("dose"))


@query(with_visits(f"""SELECT rid, array_to_string(list_transform(labels, lambda x: x.disease || '·' || x.pattern || '·' || x.goal), ';') AS labels, array_to_string({distinct("list_transform(items, lambda x: regexp_replace(x, '[0-9]+$', ''))")}, ' ') AS items FROM gold"""))
def headed_text_parse(spark, sf_dir):
    """Visits rendered as headed text, and parsed again; item names lose the digits that look like doses."""
    text = visits(spark, sf_dir).where(_gold()).select("rid", R.target(F.col("labels"), F.col("items")).alias("t"))
    labels, items = P.parse_headed(F.col("t"))
    out = text.select("rid", labels.alias("l"), items.alias("items"))
    return out.select("rid", F.array_join(F.transform("l", lambda x: F.concat_ws("·", x.disease, x.pattern, x.goal)), ";").alias("labels"), F.array_join("items", " ").alias("items"))


@query(with_visits("""SELECT count(*) AS n, count(*) AS same_labels, count(*) AS same_items FROM gold"""))
def headed_text_roundtrip(spark, sf_dir):
    """Rendering and parsing give back labels and items, for names that don't end in what looks like a dose."""
    named = F.transform("items", lambda x: F.translate(x, "#0123456789", "-abcdefghij"))
    named = F.transform(named, lambda x: F.translate(x, "-", "x"))
    v = visits(spark, sf_dir).where(_gold()).withColumn("items", named)
    labels, items = P.parse_headed(R.target(F.col("labels"), F.col("items")))
    v = v.withColumns({"l": labels, "i": items})
    plain = F.transform("labels", lambda x: F.concat_ws("·", x.disease, x.pattern, x.goal))
    again = F.transform("l", lambda x: F.concat_ws("·", x.disease, x.pattern, x.goal))
    return v.agg(F.count("*").alias("n"), F.count_if(plain == again).alias("same_labels"), F.count_if(F.col("i") == F.col("items")).alias("same_items"))


def _gold():
    from tidemark.operators.pools import is_gold

    return is_gold()


@query(f"""SELECT m AS match, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{E_MAIL}')) AS m FROM documents) GROUP BY m""")
def redact_counts(spark, sf_dir):
    return checks.match_counts(table(spark, sf_dir, "documents"), "doc_id", "text", E_MAIL)


@query(f"""SELECT doc_id, md5(regexp_replace(text, '{E_MAIL}', '{PLACEHOLDER}', 'g')) AS redacted, TRUE AS is_stable FROM documents WHERE regexp_matches(text, '{E_MAIL}')""")
def redact_text(spark, sf_dir):
    once = P.redact(F.col("text"), E_MAIL, PLACEHOLDER)
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(E_MAIL))
    return d.select("doc_id", F.md5(once).alias("redacted"), (P.redact(once, E_MAIL, PLACEHOLDER) == once).alias("is_stable"))


@query("""WITH t AS (SELECT lang, greatest(1, CAST(floor(length(text) * 0.8) AS BIGINT)) AS n FROM documents), r AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY lang) AS c FROM t)
SELECT lang, max(c) AS docs, max(CASE WHEN k = c // 2 THEN n END) AS p50, max(CASE WHEN k = CAST(floor(c * 0.99) AS BIGINT) THEN n END) AS p99, max(n) AS longest, count(*) FILTER (n > 4096) AS over FROM r GROUP BY lang""")
def token_estimate(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("lang", P.estimate_tokens(F.col("text")).alias("n"))
    return checks.length_profile(t, ["lang"], "n", 4096)


@query("""SELECT conv_id, turn, trim(regexp_replace(text || '<think>' || role || chr(10) || text || '</think> end', '<think>.*?</think>', '', 'gs')) = trim(text || ' end') AS stripped FROM conversations""")
def think_strip(spark, sf_dir):
    t = F.concat("text", F.lit("<think>"), "role", F.lit("\n"), "text", F.lit("</think> end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.trim(P.strip_think(t)) == F.trim(F.concat("text", F.lit(" end")))).alias("stripped"))


@query("""SELECT conv_id, count(*) AS turns, coalesce(array_to_string(list(role ORDER BY turn), '>') = 'system>user>assistant', FALSE) AS is_sound FROM conversations GROUP BY conv_id""")
def chat_contract(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", "turns", R.chat_is_sound(F.col("m")).alias("is_sound"))


@query(with_visits("""SELECT rid, md5('【基本信息】' || sex || '，' || age || '岁' || chr(10) || '【主诉】' || text_short || CASE WHEN text_long <> '' THEN chr(10) || '【现病史】' || text_long ELSE '' END || chr(10) || '【西医诊断】' || array_to_string(codes, ',') || chr(10) ||
 CASE WHEN followup THEN '【既往处方】第 ' || visit_ix || ' 次复诊' || coalesce('，间隔 ' || prev_gap || ' 天', '') || '，上次处方：' || array_to_string(prev_items, ' ') ELSE '【既往处方】无（初诊）' END) AS asked,
 md5('【中医诊断】' || chr(10) || array_to_string(list_transform(labels, lambda x: x.disease || '·' || x.pattern || '·' || x.goal), chr(10)) || chr(10) || '【中药处方】' || chr(10) || array_to_string(items, ' ')) AS answered, TRUE AS is_sound FROM gold"""))
def chat_rows(spark, sf_dir):
    v = link_history(visits(spark, sf_dir)).where(_gold())
    m = v.select("rid", R.chat("x", R.given_with_history(), R.target(F.col("labels"), F.col("items"))).alias("messages"))
    return m.select("rid", F.md5(F.col("messages")[1].content).alias("asked"), F.md5(F.col("messages")[2].content).alias("answered"), R.chat_is_sound(F.col("messages")).alias("is_sound"))


@query(with_visits("""SELECT rid, pid, sex, age, CAST(date AS VARCHAR) AS date, array_to_string(items, ' ') AS items, array_to_string(flags, ',') AS flags, len(coalesce(prev_items, [])) AS n_prev FROM gold"""))
def ref_projection(spark, sf_dir):
    v = link_history(visits(spark, sf_dir)).where(_gold())
    return v.select("rid", "pid", "sex", "age", F.col("date").cast("string").alias("date"), F.array_join("items", " ").alias("items"), F.array_join("flags", ",").alias("flags"), F.coalesce(F.size("prev_items"), F.lit(0)).cast("long").alias("n_prev"))


@query(f"""SELECT p_partkey, array_to_string(regexp_extract_all(p_type || 'AFNOxARO' || p_brand, '({"|".join(sorted(UNITS, key=lambda u: (-len(u), u)))})', 1), '|') AS units FROM part""")
def segment_goals(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(P.segment(F.concat("p_type", F.lit("AFNOxARO"), "p_brand"), UNITS), "|").alias("units"))


@query(f"""WITH s AS (SELECT p_partkey, list_filter(regexp_split_to_array(p_name || '、' || p_type || '；; ' || p_name, '[\\s,，、;；]+'), lambda g: g <> '') AS s FROM part)
SELECT p_partkey, array_to_string({distinct('s')}, '|') AS goals FROM s""")
def parse_goals(spark, sf_dir):
    raw = F.concat("p_name", F.lit("、"), "p_type", F.lit("；; "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(P.split_goals(raw), "|").alias("goals"))


@query(with_visits(f"""SELECT rid, array_to_string(list_transform(list_filter(string_split(text_long, '，'), lambda p: p <> ''), lambda p: CASE WHEN regexp_matches(p, '^(无|未|不)') THEN '无' || substr(p, 2) ELSE p END), ' ') AS tokens FROM visits"""))
def clause_tokens(spark, sf_dir):
    return visits(spark, sf_dir).select("rid", F.array_join(P.clauses(F.col("text_long")), " ").alias("tokens"))


@query(with_visits("""SELECT 'labels' AS field, CAST(sum(len(labels)) AS BIGINT) AS n, CAST(sum(len(list_filter(labels, lambda x: x.goal <> 'AF'))) AS BIGINT) AS kept FROM visits
UNION ALL SELECT 'items', CAST(sum(len(items)) AS BIGINT), CAST(sum(len(items)) AS BIGINT) FROM visits"""))
def segment_loss(spark, sf_dir):
    """How many label segments a parser keeps, of texts in which some are broken."""
    v = visits(spark, sf_dir)
    text = F.array_join(F.transform("labels", lambda x: F.concat_ws("/", x.disease, x.pattern, F.when(x.goal == "AF", "").otherwise(x.goal))), ",")
    kept = F.size(P.parse_labels(text))
    a = v.agg(F.lit("labels").alias("field"), F.sum(F.size("labels")).alias("n"), F.sum(kept).alias("kept"))
    return a.unionByName(v.agg(F.lit("items").alias("field"), F.sum(F.size("items")).alias("n"), F.sum(F.size("items")).alias("kept")))


@query("""SELECT count(DISTINCT p_name || p_size || 'g') AS raw_names, count(DISTINCT p_name) AS names FROM part""")
def names_merged(spark, sf_dir):
    raw = F.concat("p_name", F.col("p_size").cast("string"), F.lit("g"))
    return table(spark, sf_dir, "part").agg(F.countDistinct(raw).alias("raw_names"), F.countDistinct(F.regexp_replace(raw, P.DOSE_SUFFIX, "")).alias("names"))

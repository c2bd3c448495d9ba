"""The registry of named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {union} = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / {union}::DOUBLE END)"


def distinct(a: str) -> str:
    """Each value of a list where it comes first."""
    return f"list_filter({a}, lambda v, k: list_position({a}, v) = k)"


def field(labels: str, name: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform({labels}, lambda z: z.{name}), lambda z: z <> '')))"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(({b})::DOUBLE, 0), 0.0)"


#: CTEs of the visits and what is built on them; those that a query doesn't name aren't run.
VISITS = """
WITH line_sets AS (
  SELECT l_orderkey, list_sort(list(DISTINCT p_brand) FILTER (l_quantity > 10)) AS items,
    list_sort(list(DISTINCT {'disease': p_type, 'pattern': p_type || '-' || l_returnflag, 'goal': l_returnflag || l_linestatus})) AS labels,
    list_sort(list({'n': l_linenumber, 't': (CASE WHEN l_tax > 0.06 THEN '无' ELSE '' END) || 's' || CAST(p_size // 5 AS VARCHAR)})) AS tokens
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
raw_visits AS (
  SELECT o_orderkey AS rid, 'P' || substr(sha256('tidemark::' || o_custkey), 1, 12) AS pid, o_orderstatus AS sex, CAST(10 + o_custkey % 100 AS INT) AS age,
    CASE WHEN o_orderkey % 3 = 0 THEN coalesce(tokens[1].t, '') ELSE o_orderpriority END AS text_short,
    coalesce(array_to_string(list_transform(tokens, lambda x: x.t), '，'), '') AS text_long, [c_mktsegment, o_orderpriority] AS codes,
    coalesce(labels, []) AS labels, coalesce(items, []) AS items, CAST(o_orderdate AS DATE) AS date
  FROM orders LEFT JOIN line_sets ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey),
visits AS (
  SELECT *, len(labels) > 0 AS has_labels, len(items) > 0 AS has_items, list_filter([
    CASE WHEN age < 18 OR age > 105 THEN 'age_outlier' END, CASE WHEN sex = 'P' THEN 'sex_outlier' END,
    CASE WHEN len(items) > 0 AND (len(items) < 3 OR len(items) > 8) THEN 'length_outlier' END,
    CASE WHEN text_short <> '' AND text_short = text_long THEN 'text_equal' WHEN text_short <> '' AND starts_with(text_long, text_short) THEN 'text_prefix' END
    ], lambda f: f IS NOT NULL) AS flags
  FROM raw_visits),
ordered AS (
  SELECT *, row_number() OVER w - 1 AS visit_ix, count(*) OVER (PARTITION BY pid) AS n_visits,
    CASE WHEN has_items THEN CAST(sum(has_items::INT) OVER w AS BIGINT) - 1 END AS visit_ix_items,
    CAST(sum(has_items::INT) OVER (PARTITION BY pid) AS BIGINT) AS n_items_visits,
    last_value(CASE WHEN has_items THEN {'i': items, 'd': date} END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY date, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM visits WINDOW w AS (PARTITION BY pid ORDER BY date, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
linked AS (SELECT *, prev.i AS prev_items, date_diff('day', prev.d, date) AS prev_gap, prev.i IS NOT NULL AS followup FROM ordered),
gold AS (SELECT * FROM linked WHERE text_short <> '' AND has_labels AND has_items AND NOT list_has_any(flags, ['sex_outlier', 'age_outlier'])),
ranked AS (SELECT pid, row_number() OVER (ORDER BY sha256(pid || ':42'), pid) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT pid FROM gold)),
entity_split AS (SELECT pid, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM ranked),
split AS (SELECT gold.*, entity_split.split FROM gold JOIN entity_split USING (pid)),
train AS (SELECT * FROM split WHERE split = 'train'),
test AS (SELECT * FROM split WHERE split = 'test'),
top_items AS (SELECT item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item) AS r FROM (SELECT unnest(items) AS item FROM train) GROUP BY item),
dictionary AS (SELECT p_brand AS item, min(p_size) / 10.0 AS dose_min, max(p_size) / 4.0 + count(*) / 100.0 AS dose_max,
  coalesce(list_sort(list(DISTINCT p_type) FILTER ((CAST(regexp_extract(p_brand, '[0-9]+') AS INT) + length(p_type)) % 3 = 0 AND CAST(regexp_extract(p_brand, '[0-9]+') AS INT) % 4 <> 0)), []) AS capabilities, count(*) AS n_uses FROM part GROUP BY p_brand)
"""


def with_visits(sql: str) -> str:
    """SQL behind the CTEs of VISITS; it may go on with more CTEs, each begun by a comma."""
    return VISITS + sql
